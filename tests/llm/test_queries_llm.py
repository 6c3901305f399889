"""Registered text queries on the smallest tables; those with SQL are compared in the common query test."""

import importlib.util

import __spark_entry__ as entry


def test_names():
    assert importlib.util.find_spec("corpus_pipeline")
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert {"op1_url_filters", "op7_license_scans", "op11_lexical_search"} <= set(entry.oracle_sql())
