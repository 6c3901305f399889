"""Every registered query against its SQL on the smallest tables."""

import pytest
from conftest import SMALL
from oracle import compare

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, SMALL, name, QUERIES[name], SQL.get(name))
    assert ok, note


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r["split"] for r in rows} == {"train", "validation", "test"}
    by_group = {}
    for r in rows:
        by_group.setdefault(r["group_id"], set()).add(r["split"])
    assert all(len(v) == 1 for v in by_group.values())
