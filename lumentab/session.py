"""Session helpers: local test sessions and lineage cuts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lumentab")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is taken only where neither the setting nor the context names one,
    which is the case in local tests.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lumentab-checkpoint-"))
    return df.checkpoint(eager=eager)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Give a small file scan one partition per core before a costly per-row step.

    Large scans have more splits than cores and come back unchanged. Only for plans that
    start at files: the split count is read from the plan, nothing runs.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Only the few steps that run Python in tasks need it; the driver's path is not theirs.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="lumentab-package-")) / "lumentab.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
