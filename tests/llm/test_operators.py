"""Each operator against brute force, a round trip or held-out accuracy, and on awkward tables."""

import hashlib
import itertools
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import chat, ctw, decontaminate, langid, minhash, pieces, pii, png, secrets, warc
from lodegraph.llm.components import connected_components
from lodegraph.llm.words import shingles, utf8, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, score string, found string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", "y", "z") for i, t, lang, s in rows], SCHEMA)


LONG = "lorem ipsum dolor sit amet consectetur " * 3000
AWKWARD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, "same words here again", "en", "a"), (4, "same words here again", "en", "a"), (5, "same words here again", None, "b"), (None, "no id at all", "en", None), (6, LONG, "en", "c"), (7, "12 34 !!", "en", "c"), (8, "\U0001f600 数据 é", "xx", "d")]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def split(t):
    return re.findall("[^\x20\x09-\x0d]+", lower(t or ""))


def texts(n, seed=1):
    rng = random.Random(seed)
    base = ["the", "of", "and", "shore", "Rent", "thing", "over", "under", "é", "数据", "x1"]
    return [" ".join(rng.choice(base) for _ in range(rng.randint(0, 60))) for _ in range(n)]


# Words


def test_long_words_are_told_apart():
    """A Thue-Morse word and its complement have one polynomial hash modulo 2**64, whatever the base."""
    for n in (1 << 10, 1 << 11, 1 << 13):
        one = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        w = words(*utf8(pa.array([one, one.translate(str.maketrans("ab", "ba")), one.upper(), f"x {one}"])))
        assert w.hashes[0] != w.hashes[1] and w.hashes[0] == w.hashes[2] == w.hashes[4]


def test_words_and_shingles_equal_python():
    rows = [*texts(50), None, "", " a\x0bB  c d\n", "One"]
    flat, offsets = utf8(pa.array(rows, pa.string()).slice(0))
    w = words(flat, offsets)
    names = {}
    for i, t in enumerate(rows):
        own = w.hashes[w.bounds[i] : w.bounds[i + 1]].tolist()
        assert len(own) == len(split(t))
        for h, x in zip(own, split(t)):
            assert names.setdefault(h, x) == x
    assert len(names) == len({x for t in rows for x in split(t)})
    for k in (1, 3, 5):
        values, bounds = shingles(w, k)
        for i, t in enumerate(rows):
            s = split(t)
            want = {tuple(s[j : j + k]) for j in range(max(1, len(s) - k + 1))} if s else set()
            assert len(set(values[bounds[i] : bounds[i + 1]].tolist())) == len(want)


# 9 MinHash


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        s = split(t)
        sets[i] = {tuple(s[j : j + k]) for j in range(max(1, len(s) - k + 1))} if s else set()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            label[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed=2):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 90))]
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append(" ".join(t))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    rows = near_copies()
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.NearDedup(k, percent)).collect()
    want = brute_components(rows, k, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    assert len(set(want.values())) < len(rows)


def test_near_duplicates_of_awkward_rows(spark):
    out = minhash.near_duplicates(table(spark, AWKWARD), minhash.NearDedup(3, 85)).collect()
    assert len(out) == len(AWKWARD)
    got = {r["doc_id"]: r for r in out}
    assert [got[i]["n_shingles"] for i in (1, 2, 3)] == [0, 0, 0] and all(got[i]["kept"] for i in (1, 2, 3))
    assert (got[5]["component_id"], got[5]["kept"], got[None]["component_id"], got[None]["kept"]) == (4, False, None, True)
    assert minhash.near_duplicates(table(spark, []), minhash.NearDedup()).count() == 0
    kept = minhash.keep_one(table(spark, AWKWARD))
    assert kept.columns == table(spark, []).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]  # the repeated row of 4 once


def test_one_row_of_a_group_stays(spark):
    rows = [(3, "one two three four five six"), (1, "one two three four five six"), (1, "one two three four five six"), (None, "One two three four five six"), (None, "nine eight seven six five four"), (None, "nine eight seven six five four"), (7, None), (7, ""), (8, "x"), (9, "x")]
    docs = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], "doc_id long, text string, _kept_id int, row int, ROW_ int")
    left = minhash.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(1, rows[0][1]), (None, rows[4][1]), (7, None), (7, ""), (8, "x")], key=str)
    unique = docs.where("doc_id in (3, 8, 9)")
    assert sorted(r["doc_id"] for r in minhash.keep_one(unique).collect()) == [3, 8]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in found} == label and len(found) == len(label)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 4 Language


def test_language(spark):
    rng = random.Random(6)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["eau", "oi", "ou", "que"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(20)), lang, "s") for i, lang in enumerate(itertools.islice(itertools.cycle(syllables), 120))]
    docs = table(spark, rows)
    test = langid.held_out(2, 4)
    profiles = langid.fit(docs.where(~test), size=50)
    found = {r["doc_id"]: r for r in langid.identify(docs, profiles).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and all(found[i]["lang_pred"] == lang for i, _, lang, _ in held)
    assert all(0 <= r["score"] <= 1 for r in found.values())
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.identify(table(spark, AWKWARD), profiles).collect()}
    assert [odd[i] for i in (1, 2, 3, 7)] == ["und"] * 4
    assert langid.fit(table(spark, [])).predict("text") == ("und", 0.0)
    assert langid.accepted(table(spark, AWKWARD), profiles, 0.0).count() == 6


def test_out_of_place_distance():
    p = langid.Profiles(["x"], np.array([97, 98]), np.array([[0, 1]]), 4)
    assert sorted(langid.ngrams("A1b").tolist()) == sorted([97, 98, 32 << 21 | 97, 97 << 21 | 32, 32 << 21 | 98, 98 << 21 | 32, (32 << 42) | (97 << 21) | 32, (32 << 42) | (98 << 21) | 32])
    assert p.predict("ab")[0] == "x"


# 6 Decontamination


def distance(a, b):
    """Least edits between ``a`` and any stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_exact_match_equals_dynamic_programming():
    rng = random.Random(7)
    for _ in range(150):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, n))) for n in (9, 30))
        d, x, y = decontaminate.best_match(a.encode(), b.encode())
        assert d == distance(a, b) and distance(a, b[x:y]) == d


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in ("tho", "re", "in", "st") for b in ("nd", "er", "ou") for c in ("ing", "ha", "ed")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(15, 40)))) for i in range(12)] + [(50, None), (51, "  ")]
    rows, want = [], set()
    for d in range(80):
        t = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if d % 2:
            i, item = items[rng.randrange(12)]
            w = item.upper().split() if d % 3 else item.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            t[len(t) // 2 : len(t) // 2] = w
        rows.append((d, "\n".join(t)))
        text = decontaminate.plain(rows[-1][1])
        for i, item in items[:12]:
            body = decontaminate.plain(item)
            if distance(body, text) <= int(0.2 * len(body) + 1e-9):
                want.add((d, i))
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) >= 40
    for r in found:
        body = decontaminate.plain(dict(items)[r["item_id"]])
        assert distance(body, decontaminate.plain(dict(rows)[r["doc_id"]][r["start"] : r["end"]])) <= r["distance"]


def test_walks_agree_more_than_chance():
    """Two walks by the same bits fall back into step after edits: coordinates meet where those of other texts don't."""
    rng = random.Random(3)
    a, c = (bytes(rng.choice(b"etaoinshrdlu ") for _ in range(2000)) for _ in range(2))
    b = decontaminate.changed(a, len(a) // 12, rng)
    steps = [decontaminate.walk(k, 6) for k in range(10)]
    keys = [[{int(k) for s in steps for k in decontaminate.sampled(low, decontaminate.codes(low), np.arange(len(x)), s)[0]} for low in [np.frombuffer(x + bytes(64), np.uint8)]][0] for x in (a, b, c)]
    assert len(keys[0] & keys[1]) > 10 * len(keys[0] & keys[2])


def planted(shares, even, seed=12):
    rng = random.Random(seed)
    letters = "etaoinshrdlu"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(rng.randint(15, 50))) for _ in range(40)]
    items += ["".join(rng.choice("数据学习模型语言") for _ in range(40)) for _ in range(5)]
    items += ["".join(rng.choice(letters) for _ in range(150)) for _ in range(5)]
    rows, want = [], []
    for share in shares:
        for i, item in enumerate(items):
            body = decontaminate.plain(item)
            copy, most = list(body), int(share * len(body) + 1e-9)
            places = [int((j + 0.5) * len(copy) / most) for j in range(most)] if even else rng.sample(range(len(copy)), most)
            for at in sorted(places, reverse=True):
                kind = 0 if even else rng.randrange(3)
                copy[at : at + (kind < 2)] = [[ord(rng.choice(letters))], [], [ord("x")]][kind]
            around = [" ".join(word() for _ in range(rng.randint(0, 60))).encode() for _ in range(2)]
            rows.append(around[0] + b" " + bytes(copy) + b" " + around[1])
            want.append((len(rows) - 1, i))
    return items, rows, want


def searched(items, rows):
    tables = decontaminate.Tables(items, decontaminate.Leaks())
    assert tables.names == items
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    return {(i, item): d for i, item, d, *_ in tables.search(np.frombuffer(b"".join(rows), np.uint8), offsets)}


@pytest.mark.parametrize("even", [False, True])
@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
def test_recall_of_scattered_edits(share, even):
    items, rows, want = planted([share] * 4, even)
    got = searched(items, rows)
    assert sum(x in got for x in want) >= (0.99 if share <= 0.15 else 0.95) * len(want)
    bodies = [decontaminate.plain(t) for t in items]
    for (i, item), d in got.items():
        assert d == decontaminate._search(bodies[item], rows[i], True)[0] <= int(0.2 * len(bodies[item]) + 1e-9)


@pytest.mark.parametrize("size", [1, 3, 5, 9, 14, 20, 33, 50, 64])
def test_recall_of_short_items(size):
    rng = random.Random(size)
    items = list({"".join(rng.choice("abcdefghij") for _ in range(size)): 0 for _ in range(60)})
    rows = [bytes(rng.choice(b"pqrstuvw ") for _ in range(40)) + decontaminate.changed(t.encode(), int(0.2 * size), rng) + b" " + bytes(rng.choice(b"pqrstuvw") for _ in range(40)) for t in items]
    # A deletion beside another edit may undo it: count what is within the threshold.
    want = [i for i, t in enumerate(items) if decontaminate._search(t.encode(), rows[i], True)[0] <= int(0.2 * size)]
    got = searched(items, rows)
    assert len(want) >= 0.9 * len(items) and sum((i, i) in got for i in want) >= 0.9 * len(want)


def test_leaks_in_blocks_and_awkward_rows(spark):
    items = spark.createDataFrame([(1, "same words here again"), (2, "no id at all"), (None, None), (4, ""), (5, "no id at all"), (5, "no id at all")], "item_id long, text string")
    p = decontaminate.Leaks(block_bytes=60)
    assert len(list(decontaminate._blocks(items, p))) == 4  # 3 distinct texts of 64 bytes and their own
    found = decontaminate.leaks(table(spark, AWKWARD), items, p)
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in found.collect()) == [(0, 2), (0, 5), (0, 5), (4, 1), (4, 1), (5, 1)]
    left = decontaminate.clean(table(spark, AWKWARD), items, p)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 6, 7, 8] and left.columns == table(spark, []).columns
    assert decontaminate.leaks(table(spark, []), items).count() == 0
    assert decontaminate.clean(table(spark, AWKWARD), items.limit(0)).count() == len(AWKWARD)


def test_a_text_and_an_item_of_one_letter():
    got = searched(["a" * 300, "a" * 20], [b"a" * 40_000, b"b" * 50, b""])
    assert got == {(0, 0): 0, (0, 1): 0}


# 10 Secrets

KEY = "AKIA" + "ABCDEFGH12345678"


def reference_secrets(t):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    order = {"assign": 0, "access": 1, "hex": 2}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(out, key=lambda s: (s[1], order[s[0]])))


def test_base_secrets_equal_the_plain_patterns():
    rng = random.Random(9)
    parts = ["password", "PassWd", "api_key", "token", "=", ": ", '"', "AKIA", "ABCDEF123456", "0a1b2c3d", "deadbeef", " ", "é", "xyz-_."]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert secrets.joined([s[:3] for s in secrets.base_spans(t)]) == reference_secrets(t)


def test_entropy_spans_keep_off_base_spans_in_linear_time():
    loose = "Zx8" + "qL3mPo9RtY4sBn7wVk2"
    t = f"token={loose} {loose} {KEY}{KEY} x{loose}"
    base = secrets.base_spans(t)
    assert [t[a:b] for _, a, b, _ in secrets.entropy_spans(t, base, 3.0)] == [loose, "x" + loose]
    many = f"token={loose}; {loose} " * 20_000
    began = time.monotonic()
    assert len(secrets.entropy_spans(many, secrets.base_spans(many), 3.0)) == 20_000
    assert time.monotonic() - began < 10


def test_ownership_counts_equal_brute_force(spark):
    rng = random.Random(4)
    keys = [f"AKIA{i:03d}ABCDEFGH12345" for i in range(12)]
    rows = [(i, " ".join(rng.choices(keys[: 2 + i % 11], k=3)), rng.choice(["r1", "r2", "r3", "r4", None]), rng.choice(["a", "b", "c", "", None])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repo string, source string")
    have = {k: ({r or "" for _, t, r, _ in rows if k in t}, {o or "" for _, t, _, o in rows if k in t}) for k in keys}
    for r in secrets.scan(docs, repo=F.col("repo"), max_owners=2).collect():
        for s in r["_ll_spans"]:
            repos, owners = have[r["text"][s["start"] : s["end"]]]
            assert (s["repos"], s["owners"], s["live"]) == (len(repos), len(owners), len(owners) <= 2)


def test_ownership_separates_copied_from_live(spark):
    mine = "token = q8Zk2LmP0xWv7RtY4sBn"
    rows = [(i, f"example {KEY} here", None, f"repo{i}") for i in range(5)] + [(9, f"isé {mine} here", None, "only"), (10, "deploy q8Zk2LmP0xWv7RtY4sBn now", None, "only")]
    out = {r["doc_id"]: r for r in secrets.report(table(spark, rows)).collect()}
    assert [(out[i]["n_access"], out[i]["n_live"], out[i]["n_copied"]) for i in range(5)] == [(1, 0, 1)] * 5
    assert (out[9]["n_assign"], out[9]["n_live"]) == (1, 1) and out[9]["base_sha256"] == hashlib.sha256(reference_secrets(rows[5][1]).encode()).hexdigest()
    assert out[10]["spans"].startswith("entropy:7:")
    clean = {r["doc_id"]: r for r in secrets.redacted(table(spark, rows)).collect()}
    assert clean[9]["text"] == "isé [SECRET] here" and clean[9]["n_chars"] == 17 and clean[0]["text"] == rows[0][1]
    assert secrets.report(table(spark, AWKWARD)).count() == len(AWKWARD) and secrets.report(table(spark, [])).count() == 0
    assert sorted(map(str, secrets.redacted(table(spark, AWKWARD)).collect())) == sorted(map(str, table(spark, AWKWARD).collect()))


# 7 Personal data


def test_personal_data(spark):
    first = "Mail ann7.lee@example.com or +1 (375) 555-4393 now."
    rows = [(1, first + " Later (375) 555-4393 again, and ann7.lee wrote; version 3.1 of 10.0.0.1 and 999.1.1.1", None, "s"), (2, "card 4111 1111 1111 1111 yes, 4111 1111 1111 1112 no", None, "s")] + [(10 + i, f"Reach x{i}.y@mail.example.org, +1 (20{i}) 555-010{i} at 10.1.{i}.2; x{i}.y@mail.example.org, +1 (20{i}) 555-010{i} it is", None, "s") for i in range(9)]
    docs = table(spark, rows)
    out = {r["doc_id"]: r for r in pii.report(docs, pii.fit(docs)).collect()}
    assert [out[1][f"n_{k}"] for k in pii.KINDS] == [1, 1, 0, 1] and out[2]["n_card"] == 1
    at = rows[0][1].index("10.0.0.1")
    base = f"email:5:25,ip:{at}:{at + 8},phone:29:46"
    assert out[1]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    spans = [s.split(":") for s in out[1]["spans"].split(",")]
    assert "375) 555-4393" in {rows[0][1][int(a) : int(b)] for _, a, b in spans} and out[1]["n_added"] >= 1
    unary = np.zeros((pii._SHAPES, pii.LABELS))
    unary[:, pii.OTHER] = 1
    same = 3 * np.eye(pii.LABELS)
    text = rows[0][1]
    assert {text[a:b] for _, a, b in pii.added_spans([text], [pii.base_spans(text)], pii.Field(unary, same, same))[0]} == {"375) 555-4393", "ann7.lee"}
    assert set(base.split(",")) <= set(out[1]["spans"].split(","))
    odd = pii.report(table(spark, AWKWARD), pii.fit(table(spark, AWKWARD))).collect()
    assert len(odd) == len(AWKWARD) and all(r["spans"] == "" for r in odd)
    assert pii.report(table(spark, []), pii.fit(table(spark, []))).count() == 0


def test_beliefs_are_exact_on_a_tree():
    rng = np.random.default_rng(3)
    f = pii.Field(rng.normal(size=(pii._SHAPES, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)), tolerance=1e-9)
    base = np.array([pii.OTHER, pii.OTHER, 1])
    # Neighbours 0 and 1; 1 and 2 in class 3.
    x = pii.Nodes(np.zeros(3, int), np.arange(3), np.arange(3) + 1, np.array([1, 5, 9]), base, np.array([[0, 1]]), np.array([[1, 3], [2, 3]]), np.array([5]))
    total = np.zeros((4, pii.LABELS))
    for s in itertools.product(range(pii.LABELS), repeat=4):
        p = math.exp(f.unary[1, s[0]] + f.unary[5, s[3]] + f.evidence * (s[2] == 1) + f.chain[s[0], s[1]] + f.skip[s[1], s[3]] + f.skip[s[2], s[3]])
        for i in range(4):
            total[i, s[i]] += p
    assert np.allclose(f.beliefs(x), total / total.sum(axis=1, keepdims=True), atol=1e-6)
    assert x.labels().tolist() == [pii.OTHER, 1, 1, 1]


def test_every_repeat_gets_the_label(spark):
    rows = [(i, f"Reach x{i}.y@mail.example.org or +1375555{4000 + i} at 10.1.{i}.2; x{i}.y@mail.example.org it is, 1375555{4000 + i} too, order {1000000 + i} of {i}", None, "s") for i in range(40)]
    field = pii.fit(table(spark, rows))
    for n in (1, 3, 8, 10, 100, 1000):
        text = "Call +13755559999 now" + " then 13755559999 again" * n + " not 8765432 or 8765432."
        (added,) = pii.added_spans([text], [pii.base_spans(text)], field)
        assert len(added) == n and all(k == 3 and text[a:b] == "13755559999" for k, a, b in added)


def test_base_personal_data_equals_the_plain_patterns():
    rng = random.Random(21)
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    digits = lambda t: "".join(c for c in t if c in "0123456789")
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    good = [lambda t: True, lambda t: all(int(x) <= 255 for x in t.split(".")), lambda t: 13 <= len(digits(t)) <= 19 and luhn(digits(t)), lambda t: 9 <= len(digits(t)) <= 15]
    alphabets = ["a@.-1 %é", "0123456789. -", "+12345 ().-0", "12.", "a1@.+ "]
    for i in range(4000):
        t = "".join(rng.choice(alphabets[i % 5]) for _ in range(rng.randint(0, 60)))
        want = [(k, m.start(), m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, t) if good[k](m[0])]
        assert pii.base_spans(t) == want, t


@pytest.mark.parametrize("text", ["1" * 1_000_000, "1." * 500_000, "a@" * 500_000, "+1(" * 300_000, "7 " * 500_000], ids=["digits", "dots", "ats", "plus", "blanks"])
def test_long_runs_take_linear_time(text):
    began = time.time()
    base = pii.base_spans(text)
    assert time.time() - began < 20 and len(pii.base_spans(text[:1000])) <= max(len(base), 1)


def test_no_language_is_lost(spark):
    rows = [(i, ["zwei drei vier", "acht neun zehn"][i % 2], "de", "s") for i in range(3000)] + [(9000 + i, f"one two three{'e' * i}", "en", "s") for i in range(30)]
    profiles = langid.fit(table(spark, rows), max_train_docs=20)
    assert profiles.names == ["de", "en"] and profiles.predict("vier drei")[0] == "de" and profiles.predict("three two")[0] == "en"


def test_out_of_place_equals_brute_force(spark):
    rng = random.Random(9)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["lo", "mu", "ki"], "cc": ["mi", "ka", "mu", "ö"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randint(1, 3))) for _ in range(12)) + ", X1", k, "s") for i, k in enumerate(list(syllables) * 12)]

    def grams(t):
        t = t or ""
        return Counter(f" {w} "[i : i + n] for w in "".join(c if c.isalpha() else " " for c in t.lower()).split() for n in (1, 2, 3) for i in range(len(w) + 3 - n) if f" {w} "[i : i + n] != " ")

    def rank(counts, size):
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - j) for j, c in enumerate(g))
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:size]

    size = 25
    learned = {k: rank(sum((grams(t) for _, t, lang, _ in rows if lang == k), Counter()), size) for k in syllables}
    profiles = langid.fit(table(spark, rows), size=size)
    for r in langid.identify(table(spark, rows), profiles).collect():
        top = rank(grams(dict((i, t) for i, t, *_ in rows)[r["doc_id"]]), size)
        far = {k: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(top)) for k, p in learned.items()}
        best = min(sorted(far), key=far.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 - far[best] / (size * len(top)))


# 1 Media


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    image = np.random.default_rng(kind).integers(0, 256, (13, 9), dtype=np.uint8)
    data = png.write_png(image, idat=50, filters=(kind,))
    assert (png.read_png(data) == image).all() and data.count(b"IDAT") > 1


def test_png_damage():
    data = bytearray(png.write_png(np.zeros((4, 4), np.uint8)))
    data[45] ^= 1
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    short = png.SIGNATURE + chunk(b"IHDR", b"\0" * 12) + chunk(b"IEND", b"")
    for bad in (bytes(data), b"junk", bytes(data[:40]), short):
        with pytest.raises(ValueError):
            png.read_png(bad)


def test_cosine_hash_holds_against_noise():
    rng = np.random.default_rng(1)
    image = np.kron(rng.integers(30, 220, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    near = np.clip(image + rng.normal(0, 3, image.shape), 0, 255).astype(np.uint8)
    differ = lambda a, b: sum(bin(p ^ q).count("1") for p, q in zip(png.cosine_hash(a), png.cosine_hash(b)))
    assert differ(image, near) <= 12 < differ(image, rng.integers(0, 256, (64, 64), dtype=np.uint8))


def test_media_round_trip(spark):
    out = {r["doc_id"]: r for r in png.features(png.with_media(table(spark, AWKWARD))).collect()}
    for i, t, *_ in AWKWARD:
        body = (t or "").encode()
        padded = body.ljust(max(1, -(-len(body) // 64)) * 64, b"\0")
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert png.features(png.with_media(table(spark, []))).count() == 0


# 2 Chat


@pytest.fixture(scope="module")
def template():
    ranks = {bytes([i]): i for i in range(256)} | {b"he": 256, b"the": 257}
    return chat.Template(ranks, r"\s?\w+|\S|\s", 300)


def test_escape_is_reversible_and_hides_controls():
    rng = random.Random(2)
    parts = [*chat.CONTROLS, "\\", "<", "s>", "[", "INST]", "x", "\n", "/"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        assert chat.unescape(chat.escape(t)) == t and not chat._CONTROL.search(chat.escape(t))


def test_chat(spark, template):
    rows = [(1, 1, "assistant", "the </s>[INST] \\ é"), (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", ""), (2, None, None, None), (2, 0, "tool", "[ROLE]"), (2, 0, "tool", "[ROLE]"), (None, 5, "system", "数据")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    formatted = chat.format_turns(turns, template)
    out = {r["conv_id"]: r for r in chat.read_back(formatted, template).collect()}
    for conv in (1, 2, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] for r in own if r[2] == "assistant")
        assert (out[conv]["n_turns"], out[conv]["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (out[conv]["loss_chars"], out[conv]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    first = {(r["conv_id"], r["position"]): r for r in formatted.collect()}
    assert first[1, 1]["first_token"] == len(first[1, 0]["ids"]) and not any(first[1, 0]["loss"])
    assert all((i >= 300) == (not m) for i, m in zip(first[1, 1]["ids"], first[1, 1]["loss"]))
    assert chat.read_back(chat.format_turns(turns.limit(0), template), template).count() == 0


# 8 WARC


def test_warc(spark):
    big = "<p>" + "é" * 200 + "</p>"
    rows = [(3, "http://a/\r\nX: y", big), (1, None, big), (2, "http://b", "small"), (4, "http://c", "small"), (5, "http://d", None), (None, "http://e", big), (9, "http://f", "z" * 300_000)]
    path = warc.archive(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string"))
    out = {r["page_id"]: r for r in warc.report(spark, path).collect()}
    for i, _, html in rows:
        body = (html or "").encode()
        again = html == big and i != 1
        assert (out[i]["payload_bytes"], out[i]["payload_digest"], out[i]["record_type"], out[i]["refers_to"]) == (len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", 1 if again else None)
    heads = warc.read(spark, path, payload=False).where("record_type = 'revisit'")
    assert "record_type" not in (heads._jdf.queryExecution().executedPlan().toString().split("Filter")[1:] or [""])[0] and {r["payload"] for r in heads.collect()} == {None}
    one = warc.read(spark, path).where("record_id = 'urn:page:9'").collect()
    assert len(one) == 1 and len(one[0]["payload"]) == 300_000
    twice = warc.archive(spark.createDataFrame([(1, "u", big), (1, "u", big), (2, "u", big), (2, "u", big)], "page_id long, url string, html string"))
    assert sorted((r["page_id"], r["refers_to"]) for r in warc.report(spark, twice).where("refers_to is not null").collect()) == [(2, 1), (2, 1)] and warc.report(spark, twice).count() == 4
    empty = warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.report(spark, empty).count() == 0


def test_the_reader_skips_without_decoding():
    rows = [{"record_type": "response", "record_id": f"urn:page:{i}", "target_uri": "u", "refers_to": None, "payload_digest": "d", "payload_length": 5, "payload": b"12345" * 5000} for i in range(3)]
    parts = [warc.member(warc.record(r, "2024-01-01T00:00:00Z")) for r in rows]
    spoiled = bytearray(parts[1])
    spoiled[-20] ^= 255
    f = pa.BufferReader(pa.py_buffer(parts[0] + bytes(spoiled) + parts[2]))
    assert [r["record_id"] for r in warc.read_members(f, lambda h: h["record_id"] != "urn:page:1")] == ["urn:page:0", "urn:page:2"]
    with pytest.raises((ValueError, zlib.error)):
        list(warc.read_members(f))


# 3 Context trees


def test_weighting_equals_the_recursion():
    rng = random.Random(4)
    text = bytes(rng.choice(b"abc") for _ in range(300))
    p = ctw.Ctw(depth=2, least_count=1)
    keys = p.windows(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    keys, counts = ctw._summed(keys, np.ones(len(keys), np.int64))
    longer, tree = None, {}
    for d in (2, 1, 0):
        own, n = ctw._summed(keys & np.uint64((1 << (8 * (d + 1))) - 1), counts)
        tree[d] = ctw.levels(own, n, d)
        ctw.weigh(tree[d], longer, d)
        longer = tree[d]

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(context, d, bits):
        """log P_w of the node by the definition: half its own estimate, half its children's product."""
        a = b = 0
        padded = b"\0\0" + text
        for i, c in enumerate(text):
            if padded[i + 2 - d : i + 2] == context and f"{c:08b}".startswith(bits):
                b += f"{c:08b}"[len(bits)] == "1"
                a += f"{c:08b}"[len(bits)] == "0"
        if d == 2 or a + b == 0:
            return kt(a, b) if a + b else 0.0
        return np.logaddexp(kt(a, b), sum(weighted(bytes([x]) + context, d + 1, bits) for x in b"\0abc")) - math.log(2)

    for bits in ("", "0", "0110", "0110001"):
        x = tree[0][len(bits)]
        i = int(np.searchsorted(x.group, int(bits, 2) if bits else 0))
        assert x.log_w[i] == pytest.approx(weighted(b"", 0, bits))


def test_scores(spark):
    rows = [(i, t) for i, t in enumerate(texts(60, 3))] + [(100, None), (101, ""), (102, "never seen WORDS"), (None, "the of")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    out = {r["doc_id"]: r for r in ctw.score(docs, langid.held_out(2, 7), ctw.Ctw(depth=3, least_count=1)).collect()}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    count = Counter()
    for i, t in rows:
        if not held[i]:
            count.update([*split(t), None])
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        own = [*split(t), None]
        assert (out[i]["held_out"], out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"]) == (held[i], len(own), sum(count[w] > 0 for w in own), n)
        assert out[i]["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own))
    assert out[100]["score"] == out[101]["score"] == 0.0 and out[100]["bits_per_byte"] is None
    assert out[102]["bits_per_byte"] > 2 * out[5]["bits_per_byte"]
    assert ctw.score(docs.limit(0), langid.held_out(2, 7)).count() == 0


def test_probabilities_sum_to_one(spark):
    p = ctw.Ctw(depth=3, least_count=2)
    body = " ".join(texts(20, 8)).encode()
    keys = p.windows(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
    k, n = np.unique(keys, return_counts=True)
    m = ctw.model(spark.createDataFrame(list(zip(k.view(np.int64).tolist(), n.tolist())), "key long, n long"), p)
    for context in (keys[50] >> np.uint64(8), np.uint64(0), np.uint64(0x7A7A7A)):
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** m.log10_of(every)).sum() == pytest.approx(1.0, abs=1e-5)


def test_every_context_counts(spark):
    rows = [(i, t) for i, t in enumerate(texts(50, 5))] + [(90, "Rent under the shore, once only: zqé!")]
    got = {r["doc_id"]: r for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string"), langid.held_out(2, 7)).collect()}
    assert any(r["held_out"] for r in got.values())
    seen, children = {}, {}
    padded = {i: b"\0" * 5 + t.encode() for i, t in rows}
    for i, t in padded.items():
        for j in range(5, len(t)) if not got[i]["held_out"] else ():
            for d in range(6):
                for k in range(8):
                    node = t[j - d : j], f"{t[j]:08b}"[:k]
                    seen.setdefault(node, [0, 0])[t[j] >> (7 - k) & 1] += 1
                    if d:
                        children.setdefault((node[0][1:], node[1]), set()).add(node)
    kt, weighted = {}, {}
    for node in sorted(seen, key=lambda x: -len(x[0])):
        a, b = seen[node]
        kt[node] = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        weighted[node] = kt[node] if len(node[0]) == 5 else np.logaddexp(kt[node], sum(weighted[c] for c in children[node])) - math.log(2)

    def probability(context, bits, bit, d=0):
        node = context[5 - d :], bits
        a_b = seen[node]
        mine, longer = (a_b[bit] + 0.5) / (sum(a_b) + 1), (context[4 - d :], bits)
        if d == 5 or longer not in seen:
            return mine
        w = 1 / (1 + math.exp(min(700, sum(weighted[c] for c in children[node]) - kt[node])))
        return w * mine + (1 - w) * probability(context, bits, bit, d + 1)

    for i, t in padded.items():
        want = 0.0
        for j in range(5, len(t)):
            for k in range(8):
                bits = f"{t[j]:08b}"
                want += math.log10(probability(t[j - 5 : j], bits[:k], int(bits[k])) if (b"", bits[:k]) in seen else 0.5)
        assert got[i]["score"] == pytest.approx(want, rel=1e-5, abs=1e-6)


# 5 Pieces


@pytest.fixture(scope="module")
def vocabulary():
    own = [b"\xff", b"a", b"b", b"ab", b"aba", b"\xffa", b"\xffab", b"ba", b"bab", "é".encode(), "éa".encode(), b"aa", b"\xff\xff"]
    return pieces.Vocabulary([(p, 300 + i) for i, p in enumerate(own)], list(range(256)))


def all_paths(unit, v):
    look, score = dict(v.pieces), v.tables()[2]
    single = [False] * len(unit)
    for i in range(len(unit)):
        size = int(pieces._CHAR[unit[i]])
        if size and unit[i : i + size] in look:
            single[i : i + size] = [True] * size

    def walk(i):
        if i == len(unit):
            yield 0.0, []
        for j in range(i + 1, len(unit) + 1):
            p = unit[i:j]
            options = [look[p]] if p in look else []
            if j == i + 1 and not single[i]:
                options.append(unit[i])
            for o in options:
                for s, rest in walk(j):
                    yield score[o] + s, [o, *rest]

    # Of equally good ones the longest last piece, then the longest before it, and so on.
    body = v.tables()[3]
    return sorted(walk(0), key=lambda x: (-x[0], [-len(body[i]) for i in reversed(x[1])]))


@pytest.fixture(scope="module")
def level():
    """All pieces equally likely, so that ties abound."""
    v = pieces.Vocabulary([(p, 300 + i) for i, p in enumerate([b"a", b"b", b"ab", b"ba", b"aa", b"aba", b"bab", b"\xffa"])], list(range(256)))
    child, piece_at, score, *rest = v.tables()
    v._built = child, piece_at, np.full(len(score), -2.0), *rest
    return v


@pytest.mark.parametrize("which", ["vocabulary", "level"])
def test_n_best_equals_enumeration(which, request):
    v, rng = request.getfixturevalue(which), random.Random(5)
    units = [("".join(rng.choice(["a", "b", "é", "z"]) for _ in range(rng.randint(1, 7)))).encode() for _ in range(80)] + [b"\xffab", b"\xff\xffa", b"abababab"]
    e = pieces.Encoder(v, 4)
    units = sorted(set(units), key=len)
    e.search(units)
    for u in units:
        want = all_paths(u, v)[:4]
        at = e.at[u]
        assert e.scores[at][: len(want)].tolist() == [s for s, _ in want]
        assert e.ids[e.first[at] : e.first[at] + e.sizes[at]].tolist() == want[0][1]
        found = pieces.best_paths(pieces.lattice([u], v), 0, 4)
        assert [s for s, _ in found] == [s for s, _ in want] and found[0][1] == want[0][1]


@pytest.mark.parametrize("which", ["vocabulary", "level"])
@pytest.mark.parametrize("n", [2, 5, 200])
def test_each_of_the_n_best_is_a_segmentation(which, n, request):
    """Both searches give the ids of all n best: distinct paths with the scores of the enumeration."""
    v, rng = request.getfixturevalue(which), random.Random(6)
    units = sorted({"".join(rng.choice(["a", "b", "é", "z"]) for _ in range(rng.randint(1, 8))).encode() for _ in range(60)} | {b"\xffab", b"\xff\xffa", b"abababab"}, key=len)
    lattice = pieces.lattice(units, v)
    scores, ids, sizes = pieces.best_paths_together(lattice, np.arange(len(units)), n)
    ends = np.cumsum(sizes).reshape(sizes.shape)
    for u, unit in enumerate(units):
        every = all_paths(unit, v)
        score_of = {tuple(p): s for s, p in every}
        want = [s for s, _ in every[:n]]
        found = [ids[e - c : e].tolist() for e, c in zip(ends[u], sizes[u])][: len(want)]
        assert scores[u].tolist() == want + [-np.inf] * (n - len(want)) and not sizes[u][len(want) :].any()
        assert [score_of[tuple(p)] for p in found] == want and len(set(map(tuple, found))) == len(want)
        assert pieces.best_paths(lattice, u, n) == list(zip(want, found))


@pytest.mark.parametrize("which", ["vocabulary", "level"])
def test_the_n_best_of_whole_texts(which, request):
    v, rng = request.getfixturevalue(which), random.Random(7)
    docs = [" ".join("".join(rng.choice("abz") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["z", "z z", "", "a" * 60 + " ab"]
    for n in (2, 4):
        for text, best in zip(docs, pieces.Encoder(v, n, cache=20).n_best_batch(docs)):
            assert all(v.decode(p) == text for _, p in best) and len({tuple(p.tolist()) for _, p in best}) == len(best)
            assert all(s == v.tables()[2][p].sum() for s, p in best)
            if len(text) < 20:
                every = [sum(c) for c in itertools.product(*([s for s, _ in all_paths(u, v)] for u in v.split(text)))]
                assert [s for s, _ in best] == sorted(every, reverse=True)[:n]
            else:
                assert len(best) == n


@pytest.mark.parametrize("which", ["vocabulary", "level"])
def test_one_long_word_is_bounded(which, request):
    v = request.getfixturevalue(which)
    for word in ("a" * 20_000, "ab" * 10_000, "aba" * 7_000, "é" * 9_000):
        began = time.time()
        ((ids, _, losses),) = pieces.Encoder(v, 3).encode_batch([word])
        assert time.time() - began < 10 and v.decode(ids) == word and len(losses) == 2 * (word[0] == "a")


def test_the_cache_changes_nothing(vocabulary):
    rng = random.Random(8)
    docs = [" ".join("".join(rng.choice("abz") for _ in range(rng.randint(1, 9))) for _ in range(40)) for _ in range(600)]
    for x, y in zip(pieces.Encoder(vocabulary, 3, cache=50).encode_batch(docs), pieces.Encoder(vocabulary, 3).encode_batch(docs)):
        assert x[0].tolist() == y[0].tolist() and x[1:] == y[1:]


def test_a_vocabulary_file():
    v = pieces.Vocabulary.load("/opt/tokenizers/piece_bpe_32k.model")
    sizes = [len(p) for p, _ in v.pieces]
    assert len(v.pieces) > 30_000 and max(sizes) > 5 and len(set(v.byte_ids)) == 256
    docs = ["Hello, world", " lead  and trail ", "数据 \U0001f600\nx", ""]
    for t, (ids, score, _) in zip(docs, pieces.Encoder(v).encode_batch(docs)):
        assert v.decode(ids) == t and (score < 0) == bool(t)


def test_a_vocabulary_takes_little_memory():
    """Each of an executor's Python workers has its own; a row of 256 children a node was 57 MB."""
    v = pieces.Vocabulary.load("/opt/tokenizers/piece_bpe_32k.model")
    tracemalloc.start()
    trie, piece_at, *_ = v.tables()
    assert tracemalloc.get_traced_memory()[1] < 24 << 20
    tracemalloc.stop()
    own = dict(v.pieces)
    heads = {p[:k] for p in own for k in range(len(p) + 1)}
    assert len(piece_at) == len(heads)
    every = np.arange(256)
    for p in [b"", *random.Random(4).sample(sorted(heads), 2000)]:
        node = np.zeros(1, np.int64)
        for c in p:
            node = pieces._child(trie, node, np.array([c], np.uint8))
        assert (node[0] > 0) == bool(p) and piece_at[node[0]] == own.get(p, -1)
        assert np.flatnonzero(pieces._child(trie, np.repeat(node, 256), every)).tolist() == [c for c in range(256) if p + bytes([c]) in heads]


def test_parts_of_a_batch_hold_every_row(spark, vocabulary):
    """Texts of more bytes than a part, nulls and empty ones between them."""
    rows = [(i, [None, "", "ab é z" * (pieces.PART_BYTES // 20), "ba" * i][i % 4]) for i in range(40)] + [(40, "a b " * (pieces.PART_BYTES // 3)), (41, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = sorted(pieces.round_trip(docs, vocabulary).select("doc_id", "exact", "decoded_sha256").collect())
    assert [tuple(r) for r in out] == [(i, True, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]


def test_losses_of_whole_texts(vocabulary):
    e = pieces.Encoder(vocabulary, 3)
    text = "aba ab ba"
    ids, score, losses = next(iter(e.encode_batch([text])))
    want = sorted((sum(c) for c in itertools.product(*([s for s, _ in all_paths(u, vocabulary)] for u in vocabulary.split(text)))), reverse=True)[:3]
    assert np.allclose([score, *(score - x for x in losses)], want)


@pytest.mark.parametrize("which", ["vocabulary", "level"])
def test_units_part_where_no_piece_crosses(which, request, monkeypatch):
    """Against all segmentations of the whole line; words that differ in their signs only are searched once."""
    v, rng = request.getfixturevalue(which), random.Random(9)
    assert v.split("ab. ab!!\nab") == [b"\xffab", b".", b"\xffab", b"!", b"!", b"\n", b"ab"] and v.split("") == v.split(None) == []
    assert b"".join(v.split("é世 z\U0001f600")) == "\xff".encode("latin1") + "é世".encode() + b"\xffz" + "\U0001f600".encode()
    assert len(v.split("世\U0001f600")) == 3, "a character is never split"
    docs = ["".join(rng.choice("ab z.é\n") for _ in range(rng.randint(1, 8))) for _ in range(60)] + ["z世a", " ", "\n", " \n "]
    for text, best in zip(docs, pieces.Encoder(v, 4).n_best_batch(docs)):
        want = all_paths(b"\xff" + text.encode().replace(b" ", b"\xff"), v)
        assert [s for s, _ in best] == [s for s, _ in want[:4]] and best[0][1].tolist() == want[0][1]
    words, searched, search = ["".join(w) for w in itertools.product("ab", repeat=5)], [], pieces.Encoder.search
    monkeypatch.setattr(pieces.Encoder, "search", lambda self, units: (searched.extend(units), search(self, units)) and None)
    docs = [" ".join(w + sign for w in words) for sign in (".", ",", "!", "?", "...", "%%%")]
    for _ in v.encoder(3).n_best_batch(docs):
        pass
    assert len(searched) <= len(words) + 6
    for _ in v.encoder(3).n_best_batch(docs):
        pass
    assert len(searched) <= len(words) + 6, "a worker's next task has the units of the last"


def test_the_most_frequent_units_stay(vocabulary):
    e = pieces.Encoder(vocabulary, 3, cache=10)
    e.search([b"a" * k for k in range(1, 10)])
    want = {u: (e.scores[i].tolist(), e.ids[e.first[i] : e.first[i] + e.sizes[i]].tolist()) for u, i in e.at.items()}
    e.seen[:] = [2, 9, 3, 8, 1, 7, 4, 4, 6]
    e._thin_out()
    assert set(e.at) == {b"a" * k for k in (2, 4, 6, 9)}
    e.search([b"b"])
    assert all((e.scores[i].tolist(), e.ids[e.first[i] : e.first[i] + e.sizes[i]].tolist()) == want[u] for u, i in e.at.items() if u != b"b")


def test_a_row_without_text_alone(vocabulary):
    for docs in ([None], [""], ["", None]):
        assert [[(s, p.tolist()) for s, p in best] for best in pieces.Encoder(vocabulary, 3).n_best_batch(docs)] == [[(0.0, [])]] * len(docs)


def test_pieces_round_trip(spark, vocabulary):
    rows = [(i, t) for i, t in enumerate(["", None, " a  b ", "▁ab\n\nba", "\U0001f600é" * 40, "ab" * 200, *texts(10), "ab é" * 30_000, "same", "same"])]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, ids int")
    out = {r["doc_id"]: r for r in pieces.round_trip(docs, vocabulary).collect()}
    assert all(r["exact"] for r in out.values()) and out[0]["n_tokens"] == 0 and out[0]["loss"] is None
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs, vocabulary), vocabulary).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert pieces.encode(docs.limit(0), vocabulary).count() == 0


def test_pieces_returns_the_other_segmentations(spark, vocabulary):
    rows = [(0, None), (1, ""), (2, "z"), (3, "aba ab"), (4, "é" * 50 + " aa aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = vocabulary.tables()[2]
    digests = {r["doc_id"]: r for r in pieces.round_trip(docs, vocabulary, 4).collect()}
    for r in pieces.encode(docs, vocabulary, 4).collect():
        text, d = dict(rows)[r["doc_id"]] or "", digests[r["doc_id"]]
        assert len(r["others"]) == len(r["losses"]) == (3 if r["doc_id"] > 2 else 0)
        assert len({tuple(x) for x in [r["ids"], *r["others"]]}) == 1 + len(r["others"])
        for ids, loss in zip(r["others"], r["losses"]):
            assert vocabulary.decode(np.array(ids)) == text and r["score"] - loss == score[ids].sum()
        assert d["others_sha256"] == ",".join(hashlib.sha256(np.array(x, np.int32).tobytes()).hexdigest() for x in r["others"])
        assert d["exact"] and d["losses"] == r["losses"] and d["loss"] == (r["losses"] or [None])[0]


def test_samples_are_bounded_and_whole(spark):
    from lodegraph.llm.sampling import distinct_texts

    rows = [(f"text {i % 700}", "a") for i in range(2000)] + [("one", "b")] * 50 + [(f"few {i}", "c") for i in range(9)]
    docs = spark.createDataFrame(rows, "text string, k string")
    got = Counter(r["k"] for r in distinct_texts(docs, 20, "k").collect())
    assert got == {"a": 20, "b": 1, "c": 9}
    assert {r["text"] for r in distinct_texts(docs, 10_000, "k").collect()} == {t for t, _ in rows}
    assert distinct_texts(docs.limit(0), 5, "k").count() == 0
