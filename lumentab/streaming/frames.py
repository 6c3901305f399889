"""Structured Streaming forms: transforms, rates, accumulators, filters and file ingest.

Queries run with ``availableNow``, keep offsets in their own checkpoint folder and write
to files, so a restarted job goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumentab.sources.folders import run_folder
from lumentab.sources.images import IMAGE_SCHEMA, scanned


def frame_stream(spark: SparkSession, folder: str, schema, files: str, per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def image_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """New image files as rows; an unreadable file is a row with ``read_ok`` false."""
    reader = spark.readStream.format("image").schema(IMAGE_SCHEMA).option("dropInvalid", "false")
    return scanned(reader.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder))


@contextmanager
def listed_by_core(spark: SparkSession) -> Iterator[None]:
    """Streams that run inside list the files of a trigger in a task per core.

    By default every file is a listing task of its own, and what the tasks report to the driver
    is several times the listing.
    """
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain(stream: DataFrame, purpose: str) -> DataFrame:
    """Append a stateless stream to parquet until it is empty, then read the result."""
    spark = stream.sparkSession
    root = run_folder(spark, purpose)
    with listed_by_core(spark):
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}-offsets").trigger(availableNow=True).start(root)
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(root)


def drain_updates(aggregate: DataFrame, keys: list[str], purpose: str, mode: str = "update", root: str | None = None) -> DataFrame:
    """Write each trigger's changed groups and keep the latest row of every key.

    A repeated trigger overwrites its own folder, so the result stays exact after a restart; a
    ``root`` of an earlier call goes on where that one stopped.
    """
    spark = aggregate.sparkSession
    root = root or run_folder(spark, purpose)

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/epoch={epoch}")

    query = aggregate.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{root}-offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    written = spark.read.parquet(root)
    values = [c for c in aggregate.columns if c not in keys]
    latest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("v"))
    return latest.select(*keys, "v.*")


def arriving(table: DataFrame, slices: list[Column], purpose: str) -> str:
    """Write the rows of each slice as files of their own, one slice after the other; gives the folder."""
    root = run_folder(table.sparkSession, purpose)
    for rows in slices:
        table.filter(rows).write.mode("append").parquet(root)
    return root


def frame_counts(stream: DataFrame, time: str, seconds: int, lateness: int, purpose: str) -> DataFrame:
    """``slot, frames, epoch, late`` of every trigger, in tumbling windows numbered from 1970.

    A trigger counts its own rows and saves them with its latest time, so nothing is held in state
    and no row is dropped. The watermark of a trigger is the latest time of those before it less
    ``lateness`` seconds; rows of a window that it has passed are kept apart by ``late``.
    """
    spark = stream.sparkSession
    root = run_folder(spark, purpose)
    slot = F.expr(f"unix_micros(`{time}`) div {seconds * 1_000_000}").alias("slot")

    def save(batch: DataFrame, epoch: int) -> None:
        counted = batch.groupBy(slot).agg(F.count("*").alias("frames"), F.max(F.unix_micros(time)).alias("latest"))
        counted.write.mode("overwrite").parquet(f"{root}/epoch={epoch}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{root}-offsets").trigger(availableNow=True).start().awaitTermination()
    saved = spark.read.schema("slot long, frames long, latest long, epoch long").parquet(root)
    # one row per trigger
    before = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    marks = saved.groupBy("epoch").agg(F.max("latest").alias("latest")).select("epoch", (F.max("latest").over(before) - lateness * 1_000_000).alias("mark"))
    late = F.coalesce((F.col("slot") + 1) * (seconds * 1_000_000) <= F.col("mark"), F.lit(False))
    return saved.join(marks, "epoch").select("slot", "frames", "epoch", late.alias("late"))


def frame_rate(counted: DataFrame, seconds: int) -> DataFrame:
    """Frames of each window when it closed, the late ones added to it, and the corrected rate."""
    total = lambda rows: F.sum(F.when(rows, F.col("frames")).otherwise(0))
    by_window = counted.groupBy("slot").agg(total(~F.col("late")).alias("on_time"), total(F.col("late")).alias("late"))
    frames = F.col("on_time") + F.col("late")
    return by_window.select(F.timestamp_seconds(F.col("slot") * seconds).alias("window_start"), "on_time", "late", frames.alias("frames"), (frames / seconds).alias("fps"))


def early_stops(history: DataFrame, run: str, patience: int) -> DataFrame:
    """Best epoch and patience stop of every run while its epochs arrive; one state row a run.

    Gives ``run, best_epoch, best_metric, stop_epoch, epochs_run`` of the runs of each trigger.
    Epochs of a run come in order from trigger to trigger, in any order inside one; an epoch not
    after the last one is a repeat and counts no more, nor does any after the stop.
    """
    kind = dict(history.dtypes)[run]
    result = f"`{run}` {kind}, best_epoch int, best_metric double, stop_epoch int, epochs_run long"

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, best_epoch, waited, last, stop, count = state.get if state.exists else (None, None, 0, None, None, 0)
        rows = sorted({pair for p in parts for pair in zip(p["epoch"].tolist(), p["metric"].tolist())})
        for epoch, metric in rows:
            if stop is not None or (last is not None and epoch <= last):
                continue
            last, count = epoch, count + 1
            better = best is None or metric > best
            best, best_epoch, waited = (metric, epoch, 0) if better else (best, best_epoch, waited + 1)
            stop = epoch if waited >= patience else None
        state.update((best, best_epoch, waited, last, stop, count))
        yield pd.DataFrame({run: [key[0]], "best_epoch": [best_epoch], "best_metric": [best], "stop_epoch": pd.array([stop], "Int32"), "epochs_run": [count]})

    held = "best double, best_epoch int, waited int, last int, stop int, count long"
    return history.groupBy(run).applyInPandasWithState(follow, result, held, "update", GroupStateTimeout.NoTimeout)


def accumulators(stream: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    return stream.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])


def above_score(stream: DataFrame, column: str, level: float) -> DataFrame:
    return stream.filter(F.col(column) > level)
