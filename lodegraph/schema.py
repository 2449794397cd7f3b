"""Column types of nodes and edges, and the names that the operators rely on."""

from __future__ import annotations

ACTIVATION = (
    "struct<score:double,importance:double,reinforcement_count:bigint,last_meaningful_activation:bigint,"
    "inhibition:double,last_inhibited_at:bigint,context:map<string,struct<score:double,last_meaningful_activation:bigint>>>"
)

#: Every node column besides ``data`` (a STRUCT or a VARIANT), with its type.
NODE_COLUMNS = {
    "id": "string",
    "type": "string",
    "vector": "array<double>",
    "inserted_at": "bigint",
    "updated_at": "bigint",
    "revision": "bigint",
    "activation": ACTIVATION,
    "memory_class": "string",
    "confidence": "double",
    "source": "string",
    "observed_at": "bigint",
    "derived_from": "array<string>",
    "supersedes": "string",
    "contradicts": "array<string>",
    "_seq": "bigint",
}
EDGE_COLUMNS = {"id": "string", "source": "string", "type": "string", "target": "string", "ownership": "string", "created_at": "bigint", "revision": "bigint", "_seq": "bigint"}

OWNERSHIP = ("owned", "shared", "reference")
MEMORY_CLASSES = ("episodic", "semantic", "procedural", "entity")

HOUR, DAY = 3_600_000, 86_400_000

# Half-lives in milliseconds and gains.
SCORE_HALF_LIFE = 24 * HOUR
IMPORTANCE_HALF_LIFE = 30 * DAY
INHIBITION_HALF_LIFE = 12 * HOUR
CONTEXT_HALF_LIFE = 24 * HOUR
IMPORTANCE_GAIN = 0.05
#: Score and importance half-lives by memory class; 0: doesn't decay.
CLASS_HALF_LIVES = {
    "episodic": (12 * HOUR, 7 * DAY),
    "semantic": (7 * DAY, 90 * DAY),
    "procedural": (7 * DAY, 60 * DAY),
    "entity": (30 * DAY, 0),
}


class GraphError(ValueError):
    """Base of the errors below; ``code`` names the kind."""

    code = "invalid_argument"


class DimensionMismatch(GraphError):
    code = "dimension_mismatch"


class Conflict(GraphError):
    code = "conflict"


class ResourceLimit(GraphError):
    code = "resource_limit"


class NotFound(GraphError):
    code = "not_found"
