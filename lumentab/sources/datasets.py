"""A split of a dataset: manifest rows with their images and checked labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumentab.operators.joins import index_mismatches
from lumentab.operators.splits import SPLITS


def load_manifest(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Rows of one split; only the files of that split are read."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, not {split!r}")
    return spark.read.parquet(path).filter(F.col("split") == split)


def load_split(spark: SparkSession, path: str, split: str, images: DataFrame, mapping: DataFrame, key: str, label: str, index: str) -> DataFrame:
    """Manifest rows of a split joined with ``images``; refuses labels that differ from the class map."""
    rows = load_manifest(spark, path, split)
    wrong = index_mismatches(rows, mapping, label, index).limit(1).collect()
    if wrong:
        raise ValueError(f"label and class index disagree, e.g. {wrong[0][key]!r}")
    return rows.join(images, key)
