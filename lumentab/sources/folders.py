"""Scratch folders for written tables: shared on a cluster, temporary in local tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder per run, below ``spark.checkpoint.dir`` where that is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/lumentab/{purpose}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    return tempfile.mkdtemp(prefix=f"lumentab-{purpose}-") + "/data"
