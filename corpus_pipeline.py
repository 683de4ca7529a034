"""The corpus pipeline: five stages over whole documents, from quality to training pieces. See matrixloom/llm/pipeline.py."""

from matrixloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
