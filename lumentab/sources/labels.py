"""Label files, class maps and table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_label_csv(spark: SparkSession, path: str, schema: str = "id STRING, label STRING") -> DataFrame:
    """Header CSV with a given schema, so no pass is spent on guessing types."""
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8")


def parse_label_lines(lines: DataFrame, classes: int, line: str = "line") -> DataFrame:
    """``class cx cy w h`` lines to typed columns, with a reason where a line is rejected."""
    parts = F.filter(F.split(F.trim(F.col(line)), r"\s+"), lambda t: t != "")
    p = lines.withColumn("_p", parts)
    number = lambda i: F.try_element_at("_p", F.lit(i)).try_cast("double")
    typed = p.select(
        *lines.columns, F.size("_p").alias("_n"), F.try_element_at("_p", F.lit(1)).try_cast("int").alias("class_id"),
        *[number(i).alias(n) for i, n in enumerate(("cx", "cy", "bw", "bh"), start=2)],
    )
    coords = ["cx", "cy", "bw", "bh"]
    missing = F.col("class_id").isNull()
    outside = F.lit(False)
    for c in coords:
        missing = missing | F.col(c).isNull()
        outside = outside | ~F.col(c).between(0, 1)
    legal = (F.col("class_id") >= 0) & (F.col("class_id") < classes)
    reason = (
        F.when(F.col("_n") != 5, "wrong_field_count").when(missing, "not_a_number").when(~legal, "illegal_class").when(outside, "out_of_range")
    )
    return typed.withColumn("reason", reason).drop("_n")


def write_class_map(mapping: DataFrame, path: str) -> None:
    mapping.write.mode("overwrite").json(path)


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="name STRING, idx INT")


def write_manifest(manifest: DataFrame, path: str, by: str = "split") -> None:
    """One folder per split: a reader of one split opens only its files."""
    manifest.write.mode("overwrite").partitionBy(by).parquet(path)
