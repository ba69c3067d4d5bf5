"""Modules whose queries ``__spark_entry__.py`` registers."""

from footfall.llm import decontaminate, langid, linededup, mixing, pii, pipeline, quality, rollups, simhash, spelling, tokenbin, topk, toxicity, whitening

MODULES = [topk, decontaminate, rollups, mixing, tokenbin, pii, quality, langid, simhash, linededup, toxicity, spelling, whitening, pipeline]
