"""The corpus pipeline over ``documents``; its stages are in knowmill.llm.pipeline."""

from knowmill.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
