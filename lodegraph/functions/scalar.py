"""Scalar expressions: decay and activation arithmetic, vector similarity, ids and text weights.

All of them are column expressions, so they stay in generated code.  Times are
epoch milliseconds; ``now`` is always given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from lodegraph import schema as S

Num = Column | float | int


def col(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp_or_zero(x: Column) -> Column:
    """Between 0 and 1; NaN and null become 0.  Names its argument once, so that nested uses don't multiply a plan."""
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(F.lit(1.0), F.nanvl(F.coalesce(x.cast("double"), zero), zero)))


def clamp01(x: Column) -> Column:
    """Between 0 and 1; NaN becomes 0, null stays null."""
    return F.when(x.isNotNull(), clamp_or_zero(x))


def decay_factor(elapsed: Num, half_life: Num) -> Column:
    """0.5 ** (elapsed / half_life); 1 where no time has passed or the half-life is 0, negative, infinite or null."""
    # greatest passes over nulls, and a division by 0 gives one.
    zero = F.lit(0.0)
    return F.pow(F.lit(0.5), F.greatest(zero, F.try_divide(col(elapsed).cast("double"), F.greatest(zero, col(half_life).cast("double")))))


def _part(value: Column, anchor: Column, now: Num, half_life: Num) -> Column:
    return F.when(value.isNotNull(), clamp_or_zero(value * decay_factor(col(now) - anchor, half_life)))


def class_half_life(memory_class: Column, which: int, default: float) -> Column:
    """Half-life of the score (which 0) or the importance (1) of a memory class."""
    out = F.lit(float(default))
    for name, pair in S.CLASS_HALF_LIVES.items():
        out = F.when(memory_class == name, float(pair[which])).otherwise(out)
    return out


def activation_score(activation: Column, now: Num, half_life: Num = S.SCORE_HALF_LIFE) -> Column:
    """The decayed score, 0 without an activation."""
    return clamp_or_zero(activation["score"] * decay_factor(col(now) - activation["last_meaningful_activation"], half_life))


def _context(activation: Column, now: Num, half_life: Num) -> Column:
    """Each entry decayed against its own anchor, which it keeps."""
    entry = lambda _, e: F.struct(_part(e["score"], e["last_meaningful_activation"], now, half_life).alias("score"), e["last_meaningful_activation"].alias("last_meaningful_activation"))
    return F.transform_values(activation["context"], entry)


def _state(score: Column, importance: Column, count: Column, anchor: Column, inhibition: Column, inhibited_at: Column, context: Column) -> Column:
    return F.struct(
        score.alias("score"), importance.alias("importance"), count.cast("long").alias("reinforcement_count"), anchor.cast("long").alias("last_meaningful_activation"),
        inhibition.cast("double").alias("inhibition"), inhibited_at.cast("long").alias("last_inhibited_at"), context.alias("context"),
    ).cast(S.ACTIVATION)


def decay_state(a: Column, now: Num, score_half_life: Num = S.SCORE_HALF_LIFE, importance_half_life: Num = S.IMPORTANCE_HALF_LIFE, inhibition_half_life: Num = S.INHIBITION_HALF_LIFE, context_half_life: Num = S.CONTEXT_HALF_LIFE) -> Column:
    """An activation as it reads at ``now``; anchors stay where they are.  Null stays null."""
    anchor = a["last_meaningful_activation"]
    out = _state(
        _part(a["score"], anchor, now, score_half_life), _part(a["importance"], anchor, now, importance_half_life), a["reinforcement_count"], anchor,
        _part(a["inhibition"], F.coalesce(a["last_inhibited_at"], anchor), now, inhibition_half_life), a["last_inhibited_at"], _context(a, now, context_half_life),
    )
    return F.when(a.isNotNull(), out)


def reinforce(a: Column, delta: Num, now: Num, score_half_life: Num = S.SCORE_HALF_LIFE, importance_half_life: Num = S.IMPORTANCE_HALF_LIFE, importance_gain: Num = S.IMPORTANCE_GAIN, context: str | None = None) -> Column:
    """Decays to ``now``, adds ``delta`` to the score and a share of it to the importance, and anchors there.

    Inhibition and the other contexts are decayed but keep their anchors, as
    the shared fixtures have it.
    """
    d = decay_state(a, now, score_half_life, importance_half_life)
    zero = F.lit(0.0)
    contexts = d["context"]
    if context is not None:
        old = F.coalesce(contexts[context]["score"], zero)
        entry = F.struct(clamp01(old + col(delta)).alias("score"), col(now).cast("long").alias("last_meaningful_activation"))
        rest = F.map_filter(F.coalesce(contexts, F.create_map().cast("map<string,struct<score:double,last_meaningful_activation:bigint>>")), lambda k, _: k != context)
        contexts = F.map_concat(rest, F.create_map(F.lit(context), entry).cast("map<string,struct<score:double,last_meaningful_activation:bigint>>"))
    return _state(
        clamp01(F.coalesce(d["score"], zero) + col(delta)), clamp01(F.coalesce(d["importance"], zero) + col(importance_gain) * col(delta)),
        F.coalesce(a["reinforcement_count"], F.lit(0)) + 1, col(now), d["inhibition"], d["last_inhibited_at"], contexts,
    )


def suppress(a: Column, delta: Num, now: Num, inhibition_half_life: Num = S.INHIBITION_HALF_LIFE) -> Column:
    """Adds ``delta`` to the decayed inhibition and anchors that; a negative one releases.  Score and importance decay, unanchored."""
    d = decay_state(a, now, inhibition_half_life=inhibition_half_life)
    zero = F.lit(0.0)
    return _state(
        F.coalesce(d["score"], zero), F.coalesce(d["importance"], zero), F.coalesce(a["reinforcement_count"], F.lit(0)), F.coalesce(d["last_meaningful_activation"], col(now)),
        clamp01(F.coalesce(d["inhibition"], zero) + col(delta)), col(now), d["context"],
    )


def merge(a: Column, b: Column, now: Num, score_half_life: Num = S.SCORE_HALF_LIFE, importance_half_life: Num = S.IMPORTANCE_HALF_LIFE) -> Column:
    """The stronger of each component of two activations, both decayed to ``now``, where the result is anchored."""
    x, y = (decay_state(v, now, score_half_life, importance_half_life) for v in (a, b))
    best = lambda k: F.coalesce(F.greatest(x[k], y[k]), x[k], y[k])
    entry = lambda _, p, q: F.struct(F.coalesce(F.greatest(p["score"], q["score"]), p["score"], q["score"]).alias("score"), col(now).cast("long").alias("last_meaningful_activation"))
    empty = F.create_map().cast("map<string,struct<score:double,last_meaningful_activation:bigint>>")
    contexts = F.when(x["context"].isNotNull() | y["context"].isNotNull(), F.map_zip_with(F.coalesce(x["context"], empty), F.coalesce(y["context"], empty), entry))
    out = _state(best("score"), best("importance"), best("reinforcement_count"), col(now), best("inhibition"), F.when(best("inhibition").isNotNull(), col(now)), contexts)
    return F.when(a.isNotNull() | b.isNotNull(), out)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _same_size(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) != F.size(b), F.raise_error(F.concat(F.lit("dimension_mismatch: "), F.size(a), F.lit(" and "), F.size(b))).cast("double")).otherwise(value)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where either norm is 0; raises where the sizes differ; null where either is null."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return _same_size(a, b, F.when(norms == 0, 0.0).otherwise(_dot(a, b) / norms))


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine similarity to a constant; its norm is worked out once."""
    return cosine_similarity(vector, F.array(*[F.lit(float(x)) for x in query]).cast("array<double>"))


def euclidean_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + distance)."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return _same_size(a, b, 1 / (1 + F.sqrt(squares)))


def edge_id(source: Column, type_: Column, target: Column) -> Column:
    """source::type::target; raises where source or type has ``::``."""
    bad = source.contains("::") | type_.contains("::")
    return F.when(bad, F.raise_error(F.lit("invalid_argument: '::' in an edge's source or type")).cast("string")).otherwise(F.concat_ws("::", source, type_, target))


def estimate_tokens(id_: Column, type_: Column, data: Column) -> Column:
    """A quarter of the characters of the JSON of id, type and data, rounded up; 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.char_length(F.to_json(F.struct(id_.alias("id"), type_.alias("type"), data.alias("data")))) / 4)).cast("long")


def embedding_text(fields: dict[str, Column], weights: dict[str, int] | None = None) -> Column:
    """Non-empty field texts, each repeated by its weight (1), joined by blanks."""
    parts = [F.when(F.coalesce(c, F.lit("")) != "", F.array_repeat(c.cast("string"), max(0, int((weights or {}).get(k, 1))))).otherwise(F.array().cast("array<string>")) for k, c in fields.items()]
    return F.array_join(reduce(lambda a, b: F.concat(a, b), parts, F.array().cast("array<string>")), " ")


def group_key(value: Column, type_: str) -> Column:
    """A group's name as text: 'null' for null; whole doubles without a fraction."""
    text = value.cast("string")
    if type_ in ("double", "float"):
        whole = value.cast("double")
        text = F.when((whole == F.floor(whole)) & (F.abs(whole) < 1e15), F.format_string("%.0f", whole)).otherwise(text)
    return F.coalesce(text, F.lit("null"))
