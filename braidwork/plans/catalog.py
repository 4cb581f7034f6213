"""All queries of the core, with the SQL that DuckDB runs beside them."""

from __future__ import annotations

import importlib

MODULES = ("skewed", "splits_and_anchors", "ordered", "relational", "summaries", "expressions", "roundtrips", "wider")

QUERIES: dict = {}
ORACLE: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"braidwork.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
