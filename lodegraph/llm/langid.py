"""Language identification by rank-order n-gram profiles.

Cavnar and Trenkle, "N-Gram-Based Text Categorization" (1994): a language is
the ranked list of its most frequent character n-grams; a document goes to the
language from whose ranks its own ranks are least out of place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodegraph.llm.sampling import distinct_texts

UNDETERMINED = "und"
_BITS = 21  # of a code point; three of them fill a non-negative 64-bit integer


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(text: str | None) -> np.ndarray:
    """Codes of all 1- to 3-grams of the lower-cased words of letters, each word framed by one blank."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    follows = np.concatenate([[True], letter[:-1]])
    line = np.where(letter, codes, 0x20)[letter | follows].astype(np.int64)
    line = np.concatenate([[0x20], line[1 - int(letter[0]) :], [0x20]])
    inner = line != 0x20
    two, three = (line[:-1] << _BITS) | line[1:], (line[:-2] << 2 * _BITS) | (line[1:-1] << _BITS) | line[2:]
    return np.concatenate([line[inner], two[inner[:-1] | inner[1:]], three[inner[1:-1]]])


def ranked(grams: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent, most frequent first; of equally frequent ones the smaller code."""
    values, counts = np.unique(grams, return_counts=True)
    if len(values) > 4 * size:
        keep = counts >= np.partition(counts, -size)[-size]
        values, counts = values[keep], counts[keep]
    return values[np.lexsort((values, -counts))[:size]]


@dataclass(frozen=True)
class Profiles:
    """``table[i]`` has the rank in language ``names[i]`` of each of the sorted ``grams``, ``size`` where it has none."""

    names: list[str]
    grams: np.ndarray
    table: np.ndarray
    size: int

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (of equally near ones the first by name) and 1 - its share of the largest distance."""
        grams = ngrams(text)
        if not len(grams) or not self.names:
            return UNDETERMINED, 0.0
        top = ranked(grams, self.size)
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        theirs = np.where(self.grams[at] == top, self.table[:, at], self.size)
        distance = np.where(theirs == self.size, self.size, np.abs(theirs - np.arange(len(top)))).sum(axis=1)
        best = int(distance.argmin())
        return self.names[best], float(1 - distance[best] / (self.size * len(top)))


def fit(labelled: DataFrame, size: int = 400, max_train_docs: int = 1000, max_languages: int = 1000) -> Profiles:
    """Profiles from ``labelled(text, lang)``.

    Each language is learned from its ``max_train_docs`` distinct texts of the
    least hash, all of them where it has no more: the sample is bounded by this
    parameter times the number of languages, which may be ``max_languages`` at
    most (ValueError beyond), and no language is lost, however often its texts
    repeat.  Rows without a text or a language teach nothing.
    """
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    languages = rows.select("lang").distinct().limit(max_languages + 1).count()
    if languages > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not languages:
        return Profiles([], np.zeros(0, np.int64), np.zeros((0, 0), np.int64), size)
    sample = distinct_texts(rows, max_train_docs, "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                values, n = np.unique(np.concatenate([ngrams(t) for t, x in zip(texts, langs) if x == lang]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    grams = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = grams.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "gram", "rank").toPandas()
    names = sorted(top["lang"].unique())
    known = np.unique(top["gram"].to_numpy(np.int64))
    table = np.full((len(names), len(known)), size, np.int64)
    table[top["lang"].map({k: i for i, k in enumerate(names)}).to_numpy(int), np.searchsorted(known, top["gram"])] = top["rank"]
    return Profiles(names, known, table, size)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, lang_pred, score)``, a row for a row.

    A null text, one without a letter, or any text where no profile was
    learned gives ``und`` with score 0.  Whole texts are used, whatever their
    length; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(fold: int, of: int):
    """The test fold: crc32 of the doc_id as text modulo ``of`` is ``fold``; false where it is null."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) == fold, F.lit(False))


def accepted(docs: DataFrame, profiles: Profiles, min_score: float = 0.1) -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be told: not ``und`` and a score of ``min_score`` or more."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(names.index("text"))
            found = [profiles.predict(x.as_py()) for x in text]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
