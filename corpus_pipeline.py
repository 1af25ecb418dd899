"""The corpus pipeline: STAGES, ``run`` over ``documents``, and its SQL; the code is in tallywood/llm/pipeline.py."""

from tallywood.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
