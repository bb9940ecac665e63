"""Importing this module registers every query."""

import importlib

from .registry import all_queries, all_sql

_MODULES = [
    "interval_queries",
    "shape_queries",
    "source_queries",
    "join_queries",
    "aggregate_queries",
    "window_queries",
    "section_queries",
    "rule_queries",
    "assembly_queries",
    "stream_queries",
    "job_queries",
]

for _name in _MODULES:
    importlib.import_module(f"{__package__}.{_name}")

__all__ = ["all_queries", "all_sql"]
