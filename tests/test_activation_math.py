"""Decay, reinforcement, suppression and merge on the shared cases."""

import pytest
from pyspark.sql import functions as F

from lodegraph import schema as S
from lodegraph.functions import scalar

DAY = 86_400_000


def a(score, importance, count, anchor, inhibition=None, at=None, context=None):
    return {"score": float(score), "importance": float(importance), "reinforcement_count": count, "last_meaningful_activation": anchor, "inhibition": inhibition, "last_inhibited_at": at,
            "context": None if context is None else {k: {"score": s, "last_meaningful_activation": t} for k, (s, t) in context.items()}}


# Cases with their expected results.
CASES = [
    ("decay", a(0.8, 0.6, 2, 0), DAY, {"score_half_life": DAY, "importance_half_life": DAY}, a(0.4, 0.3, 2, 0)),
    ("decay", a(0.8, 0.6, 2, 1000), 1000, {}, a(0.8, 0.6, 2, 1000)),
    ("decay", a(0.8, 0.6, 2, 5000), 1000, {}, a(0.8, 0.6, 2, 5000)),
    ("decay", a(0.8, 0.6, 2, 0), DAY, {"score_half_life": 0, "importance_half_life": 0}, a(0.8, 0.6, 2, 0)),
    ("decay", a(0, 0, 1, 0, 0.8, 0), DAY // 2, {}, a(0, 0, 1, 0, 0.4, 0)),
    ("reinforce", None, 1000, {"delta": 0.3}, a(0.3, 0.015, 1, 1000)),
    ("reinforce", a(0.2, 0.1, 1, 0), 0, {"delta": 0.3}, a(0.5, 0.115, 2, 0)),
    ("reinforce", a(0.9, 0.99, 4, 0), 0, {"delta": 0.5}, a(1, 1, 5, 0)),
    ("reinforce", a(0.5, 0.1, 3, 0), 0, {"delta": -0.3}, a(0.2, 0.085, 4, 0)),
    ("reinforce", a(0.8, 0, 1, 0), DAY, {"delta": 0.1}, a(0.5, 0.005, 2, DAY)),
    ("reinforce", None, 1000, {"delta": 0.3, "context": "project-x"}, a(0.3, 0.015, 1, 1000, context={"project-x": (0.3, 1000)})),
    ("reinforce", a(0.2, 0.1, 1, 0, context={"project-x": (0.4, 0), "coding": (0.1, 0)}), 0, {"delta": 0.2, "context": "project-x"}, a(0.4, 0.11, 2, 0, context={"project-x": (0.6, 0), "coding": (0.1, 0)})),
    ("reinforce", a(0.2, 0, 1, 0, context={"project-x": (0.8, 0)}), DAY, {"delta": 0.1}, a(0.2, 0.005, 2, DAY, context={"project-x": (0.4, 0)})),
    ("suppress", None, 1000, {"delta": 0.5}, a(0, 0, 0, 1000, 0.5, 1000)),
    ("suppress", a(0.6, 0.2, 3, DAY // 2, 0.8, 0), DAY // 2, {"delta": 0.1}, a(0.6, 0.2, 3, DAY // 2, 0.5, DAY // 2)),
    ("suppress", a(0, 0, 0, 0, 0.6, 0), 0, {"delta": -0.4}, a(0, 0, 0, 0, 0.2, 0)),
    ("merge", a(0.3, 0.2, 2, 0), 0, {"incoming": a(0.5, 0.1, 5, 0)}, a(0.5, 0.2, 5, 0)),
    ("merge", a(0.8, 0, 1, 0), DAY, {"incoming": a(0.1, 0, 0, 0)}, a(0.4, 0, 1, DAY)),
    ("merge", a(0.5, 0.3, 3, 2000), 2000, {"incoming": a(0.5, 0.3, 3, 2000)}, a(0.5, 0.3, 3, 2000)),
    ("merge", a(0.2, 0, 1, 0, 0.3, 0, {"project-x": (0.7, 0)}), 0, {"incoming": a(0.5, 0, 2, 0, 0.6, 0, {"project-x": (0.4, 0), "coding": (0.2, 0)})}, a(0.5, 0, 2, 0, 0.6, 0, {"project-x": (0.7, 0), "coding": (0.2, 0)})),
]


def test_cases(spark):
    def run(kind, state, now, options):
        x = F.col("a")
        if kind == "decay":
            return scalar.decay_state(x, now, **options)
        if kind == "reinforce":
            return scalar.reinforce(x, now=now, **options)
        if kind == "suppress":
            return scalar.suppress(x, now=now, **options)
        return scalar.merge(x, F.col("b"), now)

    for kind, state, now, options, expected in CASES:
        df = spark.createDataFrame([(state, options.get("incoming"))], f"a {S.ACTIVATION}, b {S.ACTIVATION}")
        got = df.select(run(kind, state, now, {k: v for k, v in options.items() if k != "incoming"}).alias("r")).first()["r"].asDict(recursive=True)
        for k, v in expected.items():
            if k == "context":
                assert {n: (pytest.approx(e["score"]), e["last_meaningful_activation"]) for n, e in (v or {}).items()} == {n: (e["score"], e["last_meaningful_activation"]) for n, e in (got[k] or {}).items()}
            elif v is not None:
                assert got[k] == pytest.approx(v), (kind, state, k)


def test_scores_without_activation_are_zero(spark):
    df = spark.createDataFrame([(None,)], f"a {S.ACTIVATION}")
    assert df.select(scalar.activation_score(F.col("a"), 5)).first()[0] == 0.0


def test_decay_never_grows(spark):
    df = spark.range(0, 2000).select(scalar.decay_factor(F.col("id") * (DAY // 50), DAY).alias("f"), "id").orderBy("id").collect()
    assert all(x["f"] >= y["f"] for x, y in zip(df, df[1:]))


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(scalar.cosine_similarity(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.5**0.5), 0.0]
    bad = spark.createDataFrame([([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="dimension_mismatch"):
        bad.select(scalar.cosine_similarity(F.col("a"), F.col("b"))).collect()
