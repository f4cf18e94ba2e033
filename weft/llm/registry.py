"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MODULES = ("suffix_dedup", "langid", "lm_score", "substring_dedup", "quality", "decontam", "chat",
           "near_dedup", "warc", "mixing", "exact_dedup",
           "divergence", "collocations")


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


def load_all() -> None:
    """Import the operators, each of which registers its query, and the pipeline."""
    for name in MODULES:
        importlib.import_module(f"weft.llm.{name}")
    import corpus_pipeline

    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
