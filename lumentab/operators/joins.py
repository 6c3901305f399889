"""Join audits and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def without(items: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Drop excluded rows before any costly work on the rest."""
    return items.join(excluded.select(key), key, "left_anti")


def pairing_audit(items: DataFrame, labels: DataFrame, key: str, split: str) -> DataFrame:
    """Per split: items, labels, items without a label, labels without an item."""
    left = items.select(key, split, F.lit(True).alias("_item"))
    right = labels.select(key, F.lit(True).alias("_label"))
    both = left.join(right, key, "full_outer")
    n = lambda c: F.count(F.when(c, 1))
    item, label = F.col("_item").isNotNull(), F.col("_label").isNotNull()
    return both.groupBy(F.coalesce(split, F.lit("none")).alias(split)).agg(
        n(item).alias("items"), n(label).alias("labels"), n(~label).alias("missing_labels"), n(~item).alias("extra_labels")
    )


def membership(items: DataFrame, known: DataFrame, key: str) -> DataFrame:
    semi = items.join(known, key, "left_semi").withColumn("status", F.lit("known"))
    return semi.unionByName(items.join(known, key, "left_anti").withColumn("status", F.lit("unknown")))


def class_map(items: DataFrame, label: str) -> DataFrame:
    """Sorted distinct class names numbered from 0; the window runs over class names only."""
    names = items.select(label).distinct()
    return names.withColumn("idx", (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))


def class_map_problems(mapping: DataFrame, name: str = "name", idx: str = "idx") -> DataFrame:
    """``check, violations`` for a class map: numbered 0..n-1, no gaps, no repeats."""
    line = mapping.agg(F.count("*").alias("n"), F.count_distinct(idx).alias("distinct_idx"), F.min(idx).alias("lo"), F.max(idx).alias("hi"), F.count_distinct(name).alias("names"))
    checks = {
        "empty": (F.col("n") == 0), "starts_at_zero": F.col("lo") != 0, "contiguous": F.col("hi") != F.col("n") - 1,
        "repeated_index": F.col("distinct_idx") != F.col("n"), "repeated_name": F.col("names") != F.col("n"),
    }
    rows = [F.struct(F.lit(c).alias("check"), F.coalesce(v, F.lit(True)).cast("bigint").alias("violations")) for c, v in checks.items()]
    return line.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def index_mismatches(items: DataFrame, mapping: DataFrame, label: str, claimed: str) -> DataFrame:
    return items.join(mapping, label).filter(F.col(claimed) != F.col("idx"))


def cross_check(now: DataFrame, recorded: DataFrame, tolerance: float) -> DataFrame:
    """Recomputed against recorded metric values, row by metric name."""
    r = recorded.select("metric", F.col("value").alias("recorded"))
    agrees = F.coalesce(F.abs(F.col("value") - F.col("recorded")) < tolerance, F.lit(False))
    return now.join(r, "metric", "full_outer").select("metric", "value", "recorded", agrees.alias("agrees"))
