"""A training corpus from raw documents: language ID, near-dedup, decontamination, mixing, token shards.

The stages stand in ``footfall/llm/pipeline.py``; this is their entry point.
"""

from footfall.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
