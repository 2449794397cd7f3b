"""The corpus pipeline: language, near duplicates, benchmark, credentials, tokens; see ``lodegraph.llm.stages``."""

from lodegraph.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
