"""File sources, label parsing and stream restarts."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lumentab import session
from lumentab.operators.stats import best_epoch
from lumentab.plans.table_queries import bitmap
from lumentab.sources import folders, images as I, labels as L, paths as Pa
from lumentab.sources.bitmaps import encode
from lumentab.streaming import frames as St


@pytest.fixture
def image_dir(tmp_path):
    for i, name in enumerate(["a/one_12.bmp", "a/b/two.BMP", "c/broken.jpg", "c/note.txt"]):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        data = bitmap([(i * 64 + p) % 256 for p in range(64)])
        path.write_bytes(data[:30] if "broken" in name else data)
    return str(tmp_path)


def test_listing_filters_and_sorts(spark, image_dir):
    names = [os.path.basename(r["path"]) for r in I.list_images(spark, image_dir).collect()]
    assert names == ["two.BMP", "one_12.bmp", "broken.jpg"]
    assert {r["class_name"] for r in I.file_digests(spark, image_dir).collect()} == {"a", "b", "c"}


def test_a_broken_file_is_a_row(spark, image_dir):
    rows = {os.path.basename(r["path"]): r for r in I.read_images(spark, image_dir).collect()}
    assert rows["one_12.bmp"]["read_ok"] and rows["one_12.bmp"]["channels"] == 3
    assert not rows["broken.jpg"]["read_ok"]


def test_rasters_and_pixels_agree(spark, image_dir):
    scan = I.read_images(spark, image_dir).filter("path like '%one_12%'")
    r = I.image_rasters(scan).first()
    assert (r["h"], r["w"], len(r["planes"])) == (8, 8, 3) and r["planes"][0] == [float(v) for v in range(64)]
    px = I.image_pixels(scan).filter("c = 1").orderBy("y", "x").collect()
    assert [p["v"] for p in px] == list(range(64))


def test_path_columns(spark):
    df = spark.createDataFrame([("/d/oak/IMG_007_2.final.JPG",), ("file",), ("x/none.tif",)], "p string")
    c = F.col("p")
    got = df.select(Pa.parent_name(c), Pa.stem(c), Pa.extension(c), Pa.image_number(Pa.stem(c)), Pa.is_image(c)).collect()
    assert [tuple(r) for r in got] == [("oak", "IMG_007_2.final", "jpg", 7, True), ("", "file", "", None, False), ("x", "none", "tif", None, True)]


def test_label_lines(spark):
    lines = ["0 0.5 0.5 0.1 0.1", "  0   1 0 0.5 1 ", "0 0.5 0.5", "3 0.1 0.1 0.1 0.1", "0 1.5 0.1 0.1 0.1", "0 a 0.1 0.1 0.1", ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, line string")
    got = [r["reason"] for r in L.parse_label_lines(df, 1).orderBy("i").collect()]
    assert got == [None, None, "wrong_field_count", "illegal_class", "out_of_range", "not_a_number", "wrong_field_count"]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id long, v double"
    write = lambda lo, hi: spark.range(lo, hi).withColumn("v", F.col("id") * 1.0).coalesce(1).write.mode("append").parquet(src)

    def run():
        s = St.above_score(St.frame_stream(spark, src, schema, "*.parquet"), "v", 4.0)
        s.writeStream.format("parquet").option("checkpointLocation", out + "-offsets").trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    write(0, 8)
    assert run() == [5, 6, 7]
    write(8, 10)
    assert run() == [5, 6, 7, 8, 9]


def test_checkpoint_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = folders.run_folder(spark, "x")
    assert folder.startswith(named.rstrip("/")) if named else os.path.isabs(folder)
    assert folder != folders.run_folder(spark, "x")
    assert session.cut_lineage(spark.range(5)).count() == 5
    assert spark.sparkContext.getCheckpointDir()


def test_late_frames_are_kept_apart_and_added(spark, tmp_path):
    """Eight files of an hour each, every one with a row of hour 0."""
    src = str(tmp_path / "in")
    for k in range(8):
        hours = [k] * 5 + ([0] if k else [])
        df = spark.createDataFrame([(h * 3600 + 7 * i,) for i, h in enumerate(hours)], "t long").select(F.timestamp_seconds("t").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(src)
    counted = St.frame_counts(St.frame_stream(spark, src, "ts timestamp", "*.parquet"), "ts", 3600, 3600, "late")
    got = {int(r["window_start"].timestamp()) // 3600: r for r in St.frame_rate(counted, 3600).collect()}
    # the watermark passes the end of hour 0 once a time of hour 2 has been seen: files 3 to 7 are late
    assert (got[0]["on_time"], got[0]["late"], got[0]["frames"]) == (7, 5, 12)
    assert all((got[h]["on_time"], got[h]["late"]) == (5, 0) for h in range(1, 8)) and len(got) == 8
    assert got[3]["fps"] == 5 / 3600


def test_early_stops_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(8)
    rows = [(run, epoch, float(rng.randrange(30))) for run in ("a", "b", "c") for epoch in range(1, 31)]
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    got = None
    for lo, hi in ((1, 5), (6, 7), (7, 20), (21, 30)):  # epoch 7 comes twice
        part = [r for r in rows if lo <= r[1] <= hi]
        rng.shuffle(part)
        spark.createDataFrame(part, "run string, epoch int, metric double").write.mode("append").parquet(src)
        t = St.early_stops(St.frame_stream(spark, src, "run string, epoch int, metric double", "*.parquet", 1000), "run", 6)
        got = St.drain_updates(t, ["run"], "stops", root=root)
    want = best_epoch(spark.createDataFrame(rows, "run string, epoch int, metric double"), 6, ["run"])
    columns = ["run", "best_epoch", "best_metric", "stop_epoch", "epochs_run"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert got.filter("stop_epoch is not null").count() > 0


def test_file_stream_lists_in_a_task_per_core(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"img_{i}.bmp").write_bytes(encode(np.full((3, 4), i)) if i else b"short")
    runs, name = [], "spark.sql.sources.parallelPartitionDiscovery.parallelism"

    class Started(StreamingQueryListener):
        def onQueryStarted(self, event):
            runs.append(str(event.runId))

        def onQueryProgress(self, event):
            pass

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    listener, before = Started(), spark.conf.get(name)
    spark.streams.addListener(listener)
    try:
        got = St.drain(St.image_stream(spark, tmp_path.as_uri()).select("path", "read_ok", "width"), "list-test").collect()
    finally:
        spark.streams.removeListener(listener)
    assert len(got) == 60 and sorted((r["read_ok"], r["width"]) for r in got) == [(False, -1)] + [(True, 4)] * 59
    assert spark.conf.get(name) == before
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for run in runs for j in tracker.getJobIdsForGroup(run) for s in tracker.getJobInfo(j).stageIds]
    # a listing task per file would be 60
    assert stages and max(s.numTasks for s in stages if s) < 30
