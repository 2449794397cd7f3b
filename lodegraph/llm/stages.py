"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir).  ``run`` writes each stage's rows to
the shared folder and hands the next one the table read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodegraph.llm import decontaminate, langid, minhash, pieces, secrets
from lodegraph.llm.scratch import bounded_batches, written

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told; learns from those that name theirs.

    A text that is null, empty or without a letter goes; other columns, nulls
    in them and repeated rows pass unchanged.
    """
    bounded_batches(spark)
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least doc_id, of each group linked by 0.8 of their five-word shingles.

    A text without words is linked with nothing and stays; rows with no
    doc_id, or a repeated one, are grouped like any other.
    """
    bounded_batches(spark)
    return minhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which an item of ``benchmark`` occurs; a null or empty text stays."""
    bounded_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def credentials(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live-looking secrets in the texts; keeps all documents, a null or empty text as it is."""
    bounded_batches(spark)
    return secrets.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_tokens, score, losses, others)`` of every document; a null or empty text has no ids."""
    bounded_batches(spark)
    return pieces.encode(docs, pieces.Vocabulary.load(TOKENIZER))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("credentials", credentials),
    ("tokens", tokens),
]

#: Ranks, minima, walks and lattices have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
