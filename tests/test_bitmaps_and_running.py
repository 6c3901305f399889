"""Bitmaps read by bands, and wide windows on prefix tables, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentab.operators import running as R, stencils as W
from lumentab.sources import bitmaps as Bm


def picture(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (3, h, w)).astype(float)


def assembled(df, h, w, value="v"):
    out = np.full((h, w), np.nan)
    table = df.select("y", "x", value).toArrow()
    out[table.column("y").to_numpy(), table.column("x").to_numpy()] = table.column(value).to_numpy()
    return out


def padded(x, r):
    return np.pad(x, r, mode="reflect")


@pytest.mark.parametrize("side, halo, band", [(5, 2, 64), (16, 0, 100), (64, 3, 1 << 20)])
def test_tiles_equal_the_picture(spark, tmp_path, side, halo, band):
    x = picture(23, 31)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.bmp").write_bytes(Bm.encode(x))
    (tmp_path / "in" / "gray.BMP").write_bytes(Bm.encode(x[1]))
    (tmp_path / "in" / "cut.bmp").write_bytes(Bm.encode(x)[:200])
    (tmp_path / "in" / "empty.bmp").write_bytes(b"")
    (tmp_path / "in" / "note.txt").write_bytes(b"x")
    rows = Bm.read_tiles(spark, str(tmp_path), side, halo, band).collect()
    bad = [r for r in rows if not r["read_ok"]]
    assert sorted(r["path"].split("/")[-1] for r in bad) == ["cut.bmp", "empty.bmp"] and all(r["planes"] is None for r in bad)
    for name, planes in (("p.bmp", x), ("gray.BMP", np.stack([x[1]] * 3))):
        tiles = [r for r in rows if r["path"].endswith(name) and r["read_ok"]]
        assert len(tiles) == -(-23 // side) * -(-31 // side)
        for t in tiles:
            assert (t["h"], t["w"]) == (23, 31) and t["hy"] == max(0, t["oy"] - halo) and t["hx"] == max(0, t["ox"] - halo)
            part = planes[:, t["hy"] : t["hy"] + t["hh"], t["hx"] : t["hx"] + t["hw"]]
            assert np.array_equal(np.array(t["planes"]).reshape(3, t["hh"], t["hw"]), part)


def test_top_down_and_four_byte_pixels(spark, tmp_path):
    import struct

    x = picture(4, 3, 5)
    body = np.zeros((4, 3, 4), np.uint8)
    body[:, :, :3] = x.transpose(1, 2, 0)
    head = b"BM" + struct.pack("<IHHI", 54 + 48, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, -4, 1, 32, 0, 48, 0, 0, 0, 0)
    (tmp_path / "t.bmp").write_bytes(head + body.tobytes())
    row = Bm.read_tiles(spark, str(tmp_path / "t.bmp")).first()
    assert np.array_equal(np.array(row["planes"]).reshape(3, 4, 3), x)


def test_a_large_bitmap_is_read_by_many_tasks(spark, tmp_path):
    side = 4096
    x = np.add.outer(np.arange(side) * 7, np.arange(side) * 13) % 251
    (tmp_path / "large.bmp").write_bytes(Bm.encode(x.astype(np.uint8)))
    tiles = Bm.read_tiles(spark, f"file://{tmp_path}", side=512, halo=1)
    assert tiles.rdd.getNumPartitions() >= 6
    sums = tiles.withColumn("image_id", F.lit(1)).select("image_id", *Bm.GEOMETRY, F.slice("planes", 1, 1).alias("planes"))
    # a mean of three neighbours each way, added up by rows of tiles, equals numpy's
    got = R.box_mean(sums, 3).groupBy(F.floor(F.col("y") / 512).alias("t")).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    whole = R.window_sums(padded(x.astype(float), 1), 3, 3) / 9
    assert len(got) == 8 and all(r["n"] == 512 * side for r in got)
    for r in got:
        assert abs(r["s"] - whole[r["t"] * 512 : r["t"] * 512 + 512].sum()) < 1e-3


@pytest.mark.parametrize("k", [3, 9, 31])
def test_box_mean_of_any_width(spark, k):
    x = picture(19, 27, 3)[0]
    df = spark.createDataFrame([(1, 19, 27, x.ravel().tolist())], "image_id long, h int, w int, cells array<double>")
    at = lambda n, size: R.mirrored(np.arange(-(k // 2), n + k // 2), size)
    wide = x[np.ix_(at(19, 19), at(27, 27))]
    want = np.array([[wide[i : i + k, j : j + k].mean() for j in range(27)] for i in range(19)])
    assert np.allclose(assembled(R.box_mean(W.tiles_from_rasters(df), k), 19, 27), want)
    px = spark.createDataFrame([(1, y, c, float(v)) for (y, c), v in np.ndenumerate(x)], "image_id long, y int, x int, v double")
    cut = W.tiles_from_pixels(px, df, halo=k // 2, side=8)
    assert np.allclose(assembled(R.box_mean(cut, k), 19, 27), want)


@pytest.mark.parametrize("size, stride, pad", [((3, 3), (2, 2), (1, 1)), ((7, 5), (1, 3), (0, 2)), ((31, 2), (4, 1), (15, 0)), ((1, 1), (1, 1), (0, 0)), ((12, 12), (5, 5), (6, 3))])
def test_running_pools_equal_plain_ones(spark, size, stride, pad):
    x = picture(33, 22, 4)[2] - 128
    px = spark.createDataFrame([(1, y, c, float(v)) for (y, c), v in np.ndenumerate(x)], "image_id long, y int, x int, v double")
    dims = spark.createDataFrame([(1, 33, 22)], "image_id long, h int, w int")
    for mode, fill, how in (("max", -np.inf, np.max), ("avg", 0.0, np.mean)):
        wide = np.pad(x, [(p, p) for p in pad], constant_values=fill)
        want = np.array([[how(wide[i : i + size[0], j : j + size[1]]) for j in range(0, wide.shape[1] - size[1] + 1, stride[1])] for i in range(0, wide.shape[0] - size[0] + 1, stride[0])])
        for side in (10, 64):
            tiles = W.tiles_from_pixels(px, dims, halo=max(size), side=side)
            assert np.allclose(assembled(R.pool(tiles, size, mode, stride, pad), *want.shape), want)


def test_the_plan_does_not_grow_with_the_window(spark):
    df = spark.createDataFrame([(1, 8, 8, [0.0] * 64)], "image_id long, h int, w int, cells array<double>")
    size = lambda k: len(W.pool(W.tiles_from_rasters(df), (k, k), "max", stride=(1, 1), pad=(k // 2, k // 2))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(31) - size(11)) < 100


def test_extremes_of_short_lines():
    x = np.array([[3.0, 1.0, 2.0, 5.0, 4.0]])
    for k in range(1, 6):
        assert R.window_max(x, k).tolist() == [[max(x[0, i : i + k]) for i in range(6 - k)]]
