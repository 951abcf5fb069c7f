"""Queries and SQL of this subpackage, and the pipeline."""

from __future__ import annotations

from importlib import import_module

MODULES = ("simhash", "secrets", "bpe", "langid", "mixing", "media", "chat", "search", "suffixes", "lm")


def queries() -> dict:
    import corpus_pipeline

    found = {k: f for m in MODULES for k, f in import_module(f"pagemill.llm.{m}").QUERIES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {k: s for m in MODULES for k, s in import_module(f"pagemill.llm.{m}").ORACLE_SQL.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
