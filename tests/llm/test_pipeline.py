"""The pipeline's stages on small documents, one after the other."""

import random
from pathlib import Path

import pytest

import corpus_pipeline
from lodegraph.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["tho", "re", "nd", "ing", "sh", "ou"]) for _ in range(3))
    prose = [" ".join(word() for _ in range(60)) for _ in range(8)]
    item = " ".join(word() for _ in range(25))
    rows = [(i, t, "en", f"s{i}") for i, t in enumerate(prose)]
    rows += [(20, prose[0], "en", "s9"), (21, prose[1] + " more", "en", "s9"), (22, prose[2][:100] + "\n" + item + " " + prose[3][:80], "en", "s9"), (23, "12 34 56", "en", "s9"), (24, None, "en", "s9")]
    rows += [(25, " ".join(word() for _ in range(40)) + " token = q8Zk2LmP0xWv7RtY4sBn", "en", "s9")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
    assert [23 in k or 24 in k for k in kept] == [False] * 4
    assert kept[1] == [*range(8), 22, 25] and kept[2] == kept[3] == [*range(8), 25]
    assert docs.where("doc_id = 25").first()["text"].endswith("[SECRET]")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == kept[3] and all(len(r["ids"]) == r["n_tokens"] > 0 for r in out)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["op2_chat_format", "op8_warc", "op9_minhash_dedup"])
def test_registered_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert key(df.select(columns).collect()) == key(found.fetchall())
