"""Queries of the training-data operators with their oracle SQL."""

from __future__ import annotations

import importlib

MODULES = ("substring_dedup", "packing", "language_id", "source_mix", "simhash_vp", "url_filter", "quality_crf", "quality_rules", "order_minhash", "suffix_dedup")


def _modules():
    return [importlib.import_module(f"setflow.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLE.items()}
