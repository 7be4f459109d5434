"""Registered queries, grouped by the part of the library they exercise."""

from __future__ import annotations

import importlib

from kinframe.plans.registry import REGISTRY, Query

MODULES = [
    "catalog_queries",
    "vector_queries",
    "detect_queries",
    "evaluate_queries",
    "ingest_queries",
    "streaming_queries",
    "source_queries",
]


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"kinframe.plans.{module}")
    return REGISTRY
