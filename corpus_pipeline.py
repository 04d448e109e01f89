"""The corpus pipeline of the text operators, which lies with them."""

from causeway.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
