"""Vector search: exact top-k, and an approximate index by random hyperplanes."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodegraph import schema as S
from lodegraph.functions import scalar
from lodegraph.functions.embedding import embed

SIMILARITY = {"cosine": scalar.cosine_similarity, "euclidean": scalar.euclidean_similarity}


def top_k(nodes: DataFrame, vector: list[float], k: int, threshold: float = 0.0, similarity: str = "cosine", distance=None) -> DataFrame:  # noqa: ANN001
    """``(id, score)`` of the k most similar at ``threshold`` or more; of equal ones the earlier inserted.

    A size other than the query's raises.  ``distance``, if given, is a
    vectorised function of (vectors, query) used in place of a built-in one.
    One pass; only k rows of each partition leave it.
    """
    query = F.array(*[F.lit(float(x)) for x in vector]).cast("array<double>")
    score: Column = distance(F.col("vector"), query) if distance else SIMILARITY[similarity](F.col("vector"), query)
    own = nodes.where("vector is not null").select("id", "_seq", score.alias("score"))
    return own.where(F.col("score") >= threshold).orderBy(F.desc("score"), "_seq", "id").limit(k).select("id", "score")


def search_text(nodes: DataFrame, text: str, k: int, provider: Callable[[str], list[float]] = embed, threshold: float = 0.0) -> DataFrame:
    """``top_k`` of the vector that ``provider`` gives ``text``; a text to which it gives none, or zeros (as to ''), finds nothing."""
    vector = provider(text) if text else []
    if not any(vector):
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    return top_k(nodes, vector, k, threshold)


def as_float32(nodes: DataFrame) -> DataFrame:
    """Vectors rounded to single precision, still of doubles."""
    return nodes.withColumn("vector", F.col("vector").cast("array<float>").cast("array<double>"))


@dataclass(frozen=True)
class HyperplaneIndex:
    """Signatures of ``tables`` x ``bits`` random hyperplanes; candidates share a table's bits up to ``flips`` of them.

    Vectors at an angle t agree in a bit with probability 1 - t / pi.  One of
    cosine 0.3 is a candidate with probability 0.95, a random one with 0.63.
    """

    tables: int = 28
    bits: int = 8
    flips: int = 1
    seed: int = 11

    def planes(self, size: int) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.tables * self.bits, size))

    def signature(self, vector: Column, size: int) -> Column:
        """An array of one long a table, made of built-in expressions."""
        planes = self.planes(size)
        out = []
        for t in range(self.tables):
            bits = [F.when(scalar._dot(vector, F.array(*[F.lit(float(x)) for x in planes[t * self.bits + b]])) > 0, F.lit(1 << b)).otherwise(0) for b in range(self.bits)]
            total = bits[0]
            for b in bits[1:]:
                total = total + b
            out.append(total.cast("long"))
        return F.array(*out)

    def build(self, nodes: DataFrame, size: int) -> DataFrame:
        """``nodes`` with a column ``signature``; every node with a vector is indexed."""
        planes = self.planes(size)

        @F.pandas_udf("array<bigint>")
        def signed(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_list()) if len(v) else np.zeros((0, size))
            on = (x @ planes.T > 0).reshape(len(x), self.tables, self.bits)
            return pd.Series(list((on << np.arange(self.bits)).sum(axis=2)))

        return nodes.where("vector is not null").withColumn("signature", signed(F.col("vector")))

    def candidates(self, indexed: DataFrame, vector: list[float]) -> DataFrame:
        """Indexed rows of which some table's bits differ from the query's in ``flips`` at most."""
        own = np.asarray(vector, float) @ self.planes(len(vector)).T > 0
        keys = (own.reshape(self.tables, self.bits) << np.arange(self.bits)).sum(axis=1)
        near = F.lit(False)
        for t, key in enumerate(keys.tolist()):
            near = near | (F.bit_count(F.col("signature")[t].bitwiseXOR(F.lit(key))) <= self.flips)
        return indexed.where(near)


def approximate_top_k(nodes: DataFrame, vector: list[float], k: int, threshold: float = 0.0, index: HyperplaneIndex | None = None) -> DataFrame:
    """top_k over the index's candidates; ``nodes`` may already have the index's ``signature``."""
    index = index or HyperplaneIndex()
    indexed = nodes if "signature" in nodes.columns else index.build(nodes, len(vector))
    return top_k(index.candidates(indexed, vector), vector, k, threshold)


def approximate_candidates(nodes: DataFrame, vector: list[float], k: int | None) -> DataFrame:
    index = HyperplaneIndex()
    return index.candidates(index.build(nodes, len(vector)), vector).drop("signature")


def checked(vectors: list[float], dimensions: int | None) -> list[float]:
    """A vector that is non-empty, finite and of the declared size."""
    if not vectors or not all(isinstance(x, (int, float)) and math.isfinite(x) for x in vectors):
        raise S.GraphError("a vector needs finite numbers")
    if dimensions is not None and len(vectors) != dimensions:
        raise S.DimensionMismatch(f"{len(vectors)} and {dimensions}")
    return [float(x) for x in vectors]
