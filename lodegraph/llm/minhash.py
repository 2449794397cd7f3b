"""Near-duplicate groups: MinHash, banding, signature and exact verification, connected components.

Texts with the same shingle set form one class before anything is compared, so
copies never meet in pairs.  Classes that share a band meet first with the
least of the band only, which unites a large group of near copies in linear
work.  What that leaves apart is sketched anew with longer bands, which hardly
any pair below the threshold shares, and there meets pair by pair, so no link
is lost to the short cut.  Links are confirmed on whole shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodegraph.llm.components import connected_components
from lodegraph.llm.scratch import written
from lodegraph.llm.words import mix, pieces, shingles, utf8, words


@dataclass(frozen=True)
class NearDedup:
    """``shingle`` words make a shingle; texts link from ``percent`` % of Jaccard similarity.

    ``bands`` bands of ``rows`` minima each: two texts of similarity s share
    one with probability 1 - (1 - s**rows)**bands: 0.9999991 at 0.85 and
    0.99993 at 0.8.  ``apart_bands`` and ``apart_rows`` are those of the second
    sketch, made only of texts whose bands the first meetings left in several
    components (0.99994 at 0.85, 0.98 at 0.8 for each such pair).  ``slack``
    standard deviations below the threshold is where the signature estimate
    rules a pair out.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 5
    apart_bands: int = 90
    apart_rows: int = 14
    slack: float = 4.0

    def __post_init__(self) -> None:
        if min(self.shingle, self.bands, self.rows, self.apart_bands, self.apart_rows) < 1 or not 0 < self.percent <= 100:
            raise ValueError("shingle, bands and rows are at least 1, percent is 1 to 100")

    @property
    def least_agreement(self) -> int:
        n, s = self.bands * self.rows, self.percent / 100
        return max(0, int(n * s - self.slack * (n * s * (1 - s)) ** 0.5))

    def signature(self, values: np.ndarray) -> np.ndarray:
        return minima(values, self.bands * self.rows)

    def buckets(self, values: np.ndarray) -> np.ndarray:
        return buckets(self.signature(values), self.bands, self.rows)

    def apart_sketch(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the second sketch, and the two lowest bits of all its minima as 64-bit words."""
        low = minima(values, self.apart_bands * self.apart_rows)
        bits = np.packbits(np.stack([low & 1, low >> 1 & 1]).astype(bool))
        return buckets(low, self.apart_bands, self.apart_rows), np.pad(bits, (0, -len(bits) % 8)).view(np.int64)

    @property
    def apart_words(self) -> int:
        return -(-2 * self.apart_bands * self.apart_rows // 64)

    @property
    def most_bits(self) -> int:
        """More differing bits than these rule a pair out; minima that differ differ in each bit with probability 1/2."""
        n, d = self.apart_bands * self.apart_rows, 1 - self.percent / 100
        return math.ceil(n * d + self.slack * (n * (1.5 * d - d * d)) ** 0.5)


def minima(values: np.ndarray, n: int) -> np.ndarray:
    """Least 32-bit value of each of ``n`` multiply-shift hashes over the set."""
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    a, b = seeds[0::2] | np.uint64(1), seeds[1::2]
    low = np.full(n, 0xFFFFFFFF, np.uint64)
    step = max(1, (1 << 18) // n)
    for i in range(0, len(values), step):
        block = values[i : i + step, None] * a
        block += b
        np.minimum(low, block.min(axis=0) >> np.uint64(32), out=low)
    return low.astype(np.uint32)


def buckets(minimum: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in minimum.reshape(bands, rows).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    flat, offsets = utf8(batch.column(1))
    for first, last in pieces(offsets):
        values, bounds = shingles(words(flat[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]), k)
        for i in range(last - first):
            yield np.unique(values[bounds[i] : bounds[i + 1]])


def sketches(docs: DataFrame, p: NearDedup) -> DataFrame:
    """``(doc_id, n_shingles, set_key, buckets)``: set_key equal for equal sets, null (and no buckets) for empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, rows = [], [], []
            for s in _sets(batch, p.shingle):
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                rows.append(p.buckets(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "buckets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, buckets array<long>")


def _whole_sets(docs: DataFrame, p: NearDedup) -> DataFrame:
    """``(id, sig, items)`` of each text given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch, p.shingle))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.signature(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "sig", "items"])

    return docs.mapInArrow(run, "id long, sig binary, items binary")


def _apart_sketches(sets: DataFrame, p: NearDedup) -> DataFrame:
    """``sets(id, items)`` -> ``(rep, buckets, bits)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [p.apart_sketch(np.frombuffer(x.as_py(), np.uint64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in range(2))], ["rep", "buckets", "bits"])

    return sets.select("id", "items").mapInArrow(run, "rep long, buckets array<long>, bits array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, p: NearDedup) -> DataFrame:
    """Those of ``pairs(a, b)`` whose signatures agree enough and whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sig_a, sig_b, set_a, set_b = (batch.column(i) for i in range(6))
            keep = []
            for i in range(len(a)):
                ok = int((np.frombuffer(sig_a[i].as_py(), np.uint32) == np.frombuffer(sig_b[i].as_py(), np.uint32)).sum()) >= p.least_agreement
                if ok:
                    x, y = np.frombuffer(set_a[i].as_py(), np.uint64), np.frombuffer(set_b[i].as_py(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok = 100 * both >= p.percent * (len(x) + len(y) - both)
                keep.append(ok)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["u", "v"])

    right = pairs.join(sets.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"), F.col("items").alias("set_b")), "b")
    both = right.join(sets.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"), F.col("items").alias("set_a")), "a")
    return both.select("a", "b", "sig_a", "sig_b", "set_a", "set_b").mapInArrow(run, "u long, v long").distinct()


def _across(sketch: DataFrame, p: NearDedup) -> DataFrame:
    """Pairs ``(a, b)`` of ``sketch(rep, n, component, buckets, bits)`` that share a bucket but no component and whose bits agree enough.

    In a bucket, those outside the component of its least member meet all that
    are not in their own; those inside it don't meet each other.
    """
    band = sketch.select("rep", "component", F.posexplode("buckets").alias("place", "bucket"))
    first = band.groupBy("bucket").agg(F.min(F.struct("rep", "component")).alias("hub"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    mixed = written(band.join(written(first.select("bucket", F.col("hub.component").alias("main")), "mains"), "bucket").join(sketch.select("rep", "n", "buckets", "bits"), "rep"), "mixed")
    x = mixed.where("component != main").select("bucket", "place", *(F.col(c).alias(f"x_{c}") for c in ("rep", "n", "component", "buckets", "bits")))
    y = mixed.select("bucket", *(F.col(c).alias(f"y_{c}") for c in ("rep", "n", "component", "buckets", "bits")), (F.col("component") == F.col("main")).alias("near"))
    differ = " + ".join(f"bit_count(x_bits[{i}] ^ y_bits[{i}])" for i in range(p.apart_words))
    able = f"x_component != y_component and (near or x_rep < y_rep) and {_sizes_allow('x_n', 'y_n', p)} and {differ} <= {p.most_bits}"
    able += " and not exists(slice(zip_with(x_buckets, y_buckets, (a, b) -> a = b), 1, place), z -> z)"  # in the first bucket they share
    return x.join(y, "bucket").where(able).select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def _sizes_allow(a: str, b: str, p: NearDedup) -> str:
    return f"100 * least({a}, {b}) >= {p.percent} * greatest({a}, {b})"


def near_duplicates(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, component_id, kept)``, one row for each row given.

    component_id is the least doc_id reached over links.  Empty, blank and
    null texts have no shingles, link with nothing and are their own
    component.  Rows that repeat a doc_id count as one node.  A null doc_id
    can't name a component: such a row gets a null component_id and is kept.
    Other columns are ignored.  An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = written(sketches(docs, p), "sketches")
    classes = written(base.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets")), "classes")
    band = classes.select("rep", "n", F.explode("buckets").alias("bucket"))
    hubs = written(band.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1").select("bucket", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
    members = written(band.join(hubs, "bucket").select("bucket", "rep", "n", "hub", "hub_n"), "members")
    pairs = written(members.where("rep != hub and " + _sizes_allow("n", "hub_n", p)).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")

    # Merged at every size: a broadcast of the ids would be as large as they are.
    ids = members.select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    sets = written(_whole_sets(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text"), p), "sets")
    links = written(_confirmed(pairs, sets, p), "links")
    parts = written(connected_components(links), "parts")
    # Members of a band that the meetings with its least left in other components meet all that are not in theirs.
    label = parts.select(F.col("node").alias("rep"), "component")
    part = lambda df: df.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    hub_part = parts.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    split = written(part(members.where("rep != hub")).join(hub_part, "hub", "left").withColumn("hub_component", F.coalesce("hub_component", "hub")), "split")
    mixed = split.where("component != hub_component").select("bucket").distinct()
    rest = written(split.join(mixed, "bucket", "left_semi").select("rep", "n", "component").distinct(), "rest")
    again = sets.join(rest.select(F.col("rep").alias("id")), "id", "left_semi")
    more = written(_across(written(_apart_sketches(again, p).join(rest, "rep"), "again"), p).join(pairs, ["a", "b"], "left_anti"), "more_pairs")
    if not more.isEmpty():
        extra = written(_confirmed(more, sets, p), "links")
        if not extra.isEmpty():
            parts = written(connected_components(links.unionByName(extra)), "parts")
    found = classes.select("set_key", "rep").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    one_id = base.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    out = base.select("doc_id", "n_shingles", "set_key").join(written(found, "found"), "set_key", "left")
    if not one_id.isEmpty():
        out = _joined_ids(out)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _joined_ids(out: DataFrame) -> DataFrame:
    """Rows of one doc_id that stand in several components bring those together."""
    out = written(out, "rows")
    own = out.where("doc_id is not null").select("doc_id", F.coalesce("component_id", "doc_id").alias("c"))
    parts = written(connected_components(own.select(F.col("doc_id").alias("u"), F.col("c").alias("v"))), "id_parts")
    return out.drop("component_id").join(parts.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")), "doc_id", "left")


def keep_one(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """The rows of ``docs``, all columns, that near_duplicates keeps: of each group the one of the least doc_id.

    Rows with no doc_id, or with one that others have too, are grouped by
    their texts like any other and come after those with one, then in any
    order.  A row with no words stays.  Column names of any kind may occur.
    """
    row = _unused("row", docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    if ids.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        kept = near_duplicates(docs, p).where("kept").select(F.col("doc_id").alias(row))
        return docs.join(written(kept, "kept").hint("merge"), docs["doc_id"].cast("long") == F.col(row), "left_semi")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    own = numbered.select(F.col(row).alias("doc_id"), "text", F.col("doc_id").cast("long").alias("own_id"))
    groups = near_duplicates(own.select("doc_id", "text"), p).select("doc_id", "component_id").join(own.drop("text"), "doc_id")
    first = groups.groupBy("component_id").agg(F.min_by("doc_id", F.struct(F.isnull("own_id"), "own_id", "doc_id")).alias(row))
    return numbered.join(written(first.select(row), "kept").hint("merge"), row, "left_semi").select(docs.columns)


def _unused(name: str, docs: DataFrame) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
