"""Registered queries: the operators applied to the star schema, events, documents and pages, each with its SQL."""

from __future__ import annotations

from importlib import import_module

from .registry import FUNCTIONS, SQL

for _name in ("evaluation", "temporal", "search", "quality", "text", "ingestion", "matching", "overview", "quotes", "rules", "portal", "language", "joins", "structure"):
    import_module(f"{__name__}.{_name}")

__all__ = ["FUNCTIONS", "SQL"]
