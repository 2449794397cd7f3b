"""Bounded samples to fit on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def distinct_texts(rows: DataFrame, most: int, by: str) -> DataFrame:
    """``rows(text, by)`` -> for each value of ``by`` its ``most`` distinct texts of the least hash, all where it has no more.

    Copies of a text count once, so no value is lost and none exceeds its
    bound.  Only hashes are sorted, and of a value with many texts only about
    twice as many as it may have; ``by`` has few values.
    """
    hashed = rows.select("text", by, F.xxhash64("text", F.lit(7)).alias("_h"))
    sizes = hashed.groupBy(by).agg(F.approx_count_distinct("_h").alias("n")).collect()
    if not sizes:
        return rows.select("text", by).limit(0)
    # Twice the bound and 50 leave the estimate's error and chance no room to come below the bound.
    reach = {r[by]: int(min(1.0, (2 * most + 50) / max(r["n"], 1)) * 2.0**64) - 2**63 for r in sizes}
    near = hashed.where(F.col("_h") <= _of(reach, by))
    order = Window.partitionBy(by).orderBy("_h")
    least = near.select(by, "_h").distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    last = {r[by]: r["h"] for r in least.groupBy(by).agg(F.max("_h").alias("h")).collect()}
    return hashed.where(F.col("_h") <= _of(last, by)).dropDuplicates([by, "_h"]).select("text", by)


def _of(values: dict, by: str) -> Column:
    """The value of ``by`` in a small table; hashes reach 2 ** 63 - 1."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(min(v, 2**63 - 1)).cast("long"))])[F.col(by)]
