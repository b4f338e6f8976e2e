"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and, where SQL can express the query, ORACLE.
MODULES = ("ball_kmeans", "bpe_codec", "chat_format", "decontamination", "embedding_dedup", "importance", "language_id", "lm_score", "minhash_dedup", "quality", "substring_dedup", "token_counts", "url_filter")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(import_module(f"{__name__}.{m}"), "ORACLE", {}).items()}
