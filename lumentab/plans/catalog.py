"""All registered queries in one place."""

from __future__ import annotations

import importlib

MODULES = ["pixel_queries", "stat_queries", "dedup_queries", "metric_queries", "table_queries", "applied_queries"]


def all_queries() -> dict:
    found: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"lumentab.plans.{name}")
        twice = set(found) & set(module.Q)
        if twice:
            raise ValueError(f"query registered twice: {sorted(twice)}")
        found.update(module.Q)
    return found


def flagship(spark, sf):
    return all_queries()["G03_grouped_split"][0](spark, sf)
