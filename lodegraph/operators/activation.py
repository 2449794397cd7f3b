"""Ranking by activation: effective scores, spreading, pulse, absorb, working memory, and their updates."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, functions as F

from lodegraph import schema as S
from lodegraph.functions import scalar
from lodegraph.operators import traverse, vector
from lodegraph.operators.graph import Graph

SIGNALS = ("semantic", "graph", "recency", "usage")


@dataclass(frozen=True)
class Activation:
    """The engine's settings; every operator takes the time it reads at.

    ``attention`` is transient: a small map of ids, added to effective scores.
    """

    spread_decay: float = 0.5
    spread_depth: int = 2
    recency_half_life: float = 7 * S.DAY
    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SIGNALS, 1.0))
    pulse_threshold: float = 0.0
    absorb_threshold: float = 0.3
    absorb_gain: float = 0.05
    min_reinforce_delta: float = 0.05
    context_fallback: bool = True
    attention: dict[str, float] = field(default_factory=dict)

    def _attention(self, nodes: DataFrame) -> tuple[DataFrame, Column]:
        if not self.attention:
            return nodes, F.lit(0.0)
        small = nodes.sparkSession.createDataFrame(list(self.attention.items()), "id string, _attention double")
        return nodes.join(small, "id", "left"), F.coalesce("_attention", F.lit(0.0))

    def effective(self, nodes: DataFrame, now: int, context: str | None = None) -> DataFrame:
        """``nodes`` with ``effective``: the decayed score (of the context, if given) plus attention less inhibition, between 0 and 1."""
        a = F.col("activation")
        half = scalar.class_half_life(F.col("memory_class"), 0, S.SCORE_HALF_LIFE)
        score = scalar.activation_score(a, now, half)
        if context is not None:
            entry = a["context"][context]
            own = scalar.clamp01(entry["score"] * scalar.decay_factor(F.lit(now) - entry["last_meaningful_activation"], S.CONTEXT_HALF_LIFE))
            score = F.coalesce(own, score if self.context_fallback else F.lit(0.0))
        inhibition = F.coalesce(a["inhibition"] * scalar.decay_factor(F.lit(now) - F.coalesce(a["last_inhibited_at"], a["last_meaningful_activation"]), S.INHIBITION_HALF_LIFE), F.lit(0.0))
        nodes, attention = self._attention(nodes)
        return nodes.withColumn("effective", scalar.clamp_or_zero(score + attention - inhibition)).drop("_attention")

    def spread(self, graph: Graph, seeds: DataFrame, depth: int | None = None, decay: float | None = None, edge_types: list[str] | None = None) -> DataFrame:
        """``seeds(id)`` -> ``(id, hop, spread)``: decay ** hop at a node's least hop along outgoing edges; seeds are left out."""
        found = traverse.reach(seeds, graph.edges, edge_types, self.spread_depth if depth is None else depth)
        return found.where("hop > 0").withColumn("spread", F.pow(F.lit(float(self.spread_decay if decay is None else decay)), F.col("hop")))

    def breakdown(self, nodes: DataFrame, now: int, semantic: Column, graph: Column) -> DataFrame:
        """``nodes`` with the four signals, unweighted, and their weighted ``total``; usage is the stored importance."""
        signals = {
            "semantic": F.coalesce(semantic, F.lit(0.0)),
            "graph": F.coalesce(graph, F.lit(0.0)),
            "recency": scalar.decay_factor(F.lit(now) - F.col("inserted_at"), self.recency_half_life),
            "usage": F.coalesce(F.col("activation")["importance"], F.lit(0.0)),
        }
        out = nodes.withColumns(signals)
        return out.withColumn("total", sum((F.col(s) * F.lit(float(self.weights[s])) for s in SIGNALS), F.lit(0.0)))

    def pulse(self, graph: Graph, query: list[float], now: int, top_k: int = 10, semantic_threshold: float = 0.0, edge_types: list[str] | None = None) -> DataFrame:
        """``(id, semantic, graph, recency, usage, total)`` above the pulse threshold, best first.

        Seeds are the ``top_k`` nodes most similar to the query, above
        ``semantic_threshold`` and 0; what they spread to joins them.
        """
        seeds = vector.top_k(graph.nodes, query, top_k).where(F.col("score") > max(semantic_threshold, 0.0))
        spread = self.spread(graph, seeds.select("id"), edge_types=edge_types)
        both = seeds.select("id", F.col("score").alias("_semantic"), F.lit(None).cast("double").alias("_graph")).unionByName(spread.select("id", F.lit(None).cast("double").alias("_semantic"), F.col("spread").alias("_graph")))
        ranked = self.breakdown(graph.nodes.join(both, "id"), now, F.col("_semantic"), F.col("_graph"))
        return ranked.where(F.col("total") > self.pulse_threshold).orderBy(F.desc("total"), "_seq", "id").select("id", *SIGNALS, "total")

    def absorb(self, graph: Graph, query: list[float], now: int, **pulse_options) -> Graph:  # noqa: ANN003
        """Reinforces what a pulse finds at the absorb threshold or more, each by its gain times total."""
        found = self.pulse(graph, query, now, **pulse_options).where(F.col("total") >= self.absorb_threshold)
        return reinforce(graph, found.select("id", scalar.clamp01(F.col("total") * self.absorb_gain).alias("delta")), now)

    def working_memory(self, nodes: DataFrame, now: int, limit: int = 10, min_score: float = 0.0, context: str | None = None, diversity: float = 0.0, token_budget: float = math.inf, cost_of: Callable[[Row], float] | None = None, similarity_of: Callable[[Row, Row], float] | None = None) -> list[Row]:
        """The ``limit`` nodes of greatest effective score above ``min_score``, as rows.

        With ``diversity`` each choice weighs score against similarity to what
        is chosen already; with a ``token_budget`` it ends at the first choice
        that would exceed it.  At most 4 * limit rows come to the driver.
        """
        ranked = self.effective(nodes, now, context).where(F.col("effective") > min_score).orderBy(F.desc("effective"), "_seq", "id")
        if diversity <= 0 and token_budget == math.inf:
            return ranked.limit(limit).collect()
        pool = ranked.withColumn("_tokens", scalar.estimate_tokens(F.col("id"), F.col("type"), F.col("data"))).limit(4 * limit).collect()
        similarity_of = similarity_of or _row_similarity
        nearest, chosen, spent = [0.0] * len(pool), [], 0.0
        left = list(range(len(pool)))
        while left and len(chosen) < limit:
            best = max(left, key=lambda i: ((1 - diversity) * pool[i]["effective"] - diversity * nearest[i] if diversity > 0 else pool[i]["effective"], -i))
            cost = cost_of(pool[best]) if cost_of else pool[best]["_tokens"]
            if not math.isfinite(cost) or cost < 0:
                raise S.GraphError("a cost is finite and not negative")
            if spent + cost > token_budget:
                break
            spent += cost
            left.remove(best)
            if diversity > 0:
                for i in left:
                    new = similarity_of(pool[i], pool[best])
                    nearest[i] = max(nearest[i], new) if chosen else new
            chosen.append(pool[best])
        return chosen

    def with_weights(self, **weights: float) -> Activation:
        if any(w < 0 or not math.isfinite(w) for w in weights.values()) or set(weights) - set(SIGNALS):
            raise S.GraphError("weights are finite, not negative, and of known signals")
        return replace(self, weights={**self.weights, **weights})

    def with_feedback(self, signals: dict[str, float], useful: bool, rate: float = 0.05) -> Activation:
        """Moves each weight by rate times its signal, up if useful and down if not, to 0 at least."""
        return replace(self, weights={s: max(0.0, w + (1 if useful else -1) * rate * signals.get(s, 0.0)) for s, w in self.weights.items()})

    def with_attention(self, bumps: dict[str, float]) -> tuple[Activation, dict[str, float]]:
        """Adds to the attention; what reaches min_reinforce_delta leaves it and comes back as deltas to reinforce by."""
        total = {k: self.attention.get(k, 0.0) + bumps.get(k, 0.0) for k in {**self.attention, **bumps}}
        due = {k: v for k, v in total.items() if v >= self.min_reinforce_delta}
        return replace(self, attention={k: v for k, v in total.items() if k not in due}), due


def _row_similarity(a: Row, b: Row) -> float:
    if not a["vector"] or not b["vector"]:
        return 0.0
    dot = sum(x * y for x, y in zip(a["vector"], b["vector"], strict=True))
    norm = math.sqrt(sum(x * x for x in a["vector"]) * sum(x * x for x in b["vector"]))
    return dot / norm if norm else 0.0


def top_activated(nodes: DataFrame, now: int, limit: int, min_score: float = 0.0) -> DataFrame:
    """``(id, score)`` of the greatest decayed scores above ``min_score``."""
    half = scalar.class_half_life(F.col("memory_class"), 0, S.SCORE_HALF_LIFE)
    scored = nodes.select("id", "_seq", scalar.activation_score(F.col("activation"), now, half).alias("score"))
    return scored.where(F.col("score") > min_score).orderBy(F.desc("score"), "_seq", "id").limit(limit).select("id", "score")


def reinforce(graph: Graph, deltas: DataFrame, now: int, context: str | None = None) -> Graph:
    """Reinforces the nodes of ``deltas(id, delta)``, several of one node by their sum; revisions stay."""
    total = deltas.groupBy("id").agg(F.sum("delta").alias("_delta"))
    c = F.col("memory_class")
    new = scalar.reinforce(F.col("activation"), F.col("_delta"), now, scalar.class_half_life(c, 0, S.SCORE_HALF_LIFE), scalar.class_half_life(c, 1, S.IMPORTANCE_HALF_LIFE), context=context)
    nodes = graph.nodes.join(total, "id", "left").withColumn("activation", F.when(F.col("_delta").isNotNull(), new).otherwise(F.col("activation")))
    return replace(graph, nodes=nodes.select(graph.nodes.columns))


def suppress(graph: Graph, deltas: DataFrame, now: int) -> Graph:
    """Suppresses the nodes of ``deltas(id, delta)``; negative sums release."""
    total = deltas.groupBy("id").agg(F.sum("delta").alias("_delta"))
    nodes = graph.nodes.join(total, "id", "left").withColumn("activation", F.when(F.col("_delta").isNotNull(), scalar.suppress(F.col("activation"), F.col("_delta"), now)).otherwise(F.col("activation")))
    return replace(graph, nodes=nodes.select(graph.nodes.columns))


def merge_activation(graph: Graph, incoming: DataFrame, now: int) -> Graph:
    """Merges snapshots ``incoming(id, activation)`` by maximum; bringing one again changes nothing."""
    other = incoming.select("id", F.col("activation").cast(S.ACTIVATION).alias("_incoming"))
    nodes = graph.nodes.join(other, "id", "left").withColumn("activation", F.when(F.col("_incoming").isNotNull(), scalar.merge(F.col("activation"), F.col("_incoming"), now)).otherwise(F.col("activation")))
    return replace(graph, nodes=nodes.select(graph.nodes.columns))


def decay(graph: Graph, now: int) -> Graph:
    """Writes decayed values and anchors score and importance at ``now``; inhibition and contexts keep their anchors."""
    c, a = F.col("memory_class"), F.col("activation")
    state = scalar.decay_state(a, now, scalar.class_half_life(c, 0, S.SCORE_HALF_LIFE), scalar.class_half_life(c, 1, S.IMPORTANCE_HALF_LIFE))
    return replace(graph, nodes=graph.nodes.withColumn("activation", F.when(a.isNotNull(), state.withField("last_meaningful_activation", F.lit(now).cast("long")))))
