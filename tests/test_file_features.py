"""Image files to inventory, quality, hashes and a split, against numpy."""

import time

import numpy as np
from pyspark.sql import functions as F

from lumentab.operators import dedup as D, phash as H
from lumentab.operators.phash import cosine_rows
from lumentab.sources import images as I
from lumentab.sources.bitmaps import encode


def area(x, h, w):
    """8-bit area resize, one weight matrix per side."""

    def weights(n, m):
        k = n / m
        return np.array([[max(0.0, min(c + 1, (t + 1) * k) - max(c, t * k)) / k for c in range(n)] for t in range(m)])

    return np.rint(np.round(weights(x.shape[0], h) @ x @ weights(x.shape[1], w).T, 6))


def packed(bits):
    v = 0
    for b in bits:
        v = v << 1 | int(b)
    return v - (1 << 64) if v >> 63 else v


def both(x):
    rows = np.array(cosine_rows(32, 8))
    low = np.round(rows @ area(x, 32, 32) @ rows.T, 6).ravel() + 0.0
    nine = area(x, 8, 9)
    return packed(low > np.median(low[1:])), packed((nine[:, 1:] > nine[:, :-1]).ravel())


def pictures():
    rng = np.random.default_rng(31)
    shapes = [(8, 9), (32, 32), (5, 70), (41, 6), (1, 1), (64, 48)]
    out = {f"class_{i % 2}/img_{i}.bmp": rng.integers(0, 256, s).astype(np.uint8) for i, s in enumerate(shapes)}
    out["class_0/img_50.bmp"] = np.full((12, 20), 77, np.uint8)
    return out


def test_hashes_of_images_of_any_size(spark):
    names = list(pictures().items())
    rows = [(n, x.shape[0], x.shape[1], [float(v) for v in x.ravel()]) for n, x in names]
    got = H.image_hashes(spark.createDataFrame(rows, "path string, h int, w int, cells array<double>")).collect()
    assert {r["path"]: (r["phash"], r["dhash"]) for r in got} == {n: both(x.astype(float)) for n, x in names}


def test_hashes_of_many_images_cost_little(spark):
    rng = np.random.default_rng(5)
    small = [rng.integers(0, 256, (8, 8)).astype(float) for _ in range(2000)]
    rows = [(i, 8, 8, x.ravel().tolist()) for i, x in enumerate(small)] + [(-1, 8, 8, None), (-2, 8, 8, [1.0] * 63)]
    frame = spark.createDataFrame(rows, "i int, h int, w int, cells array<double>").coalesce(1).cache()
    frame.count()
    start = time.time()
    got = {r["i"]: (r["phash"], r["dhash"]) for r in H.image_hashes(frame).select("i", "phash", "dhash").collect()}
    took = time.time() - start
    assert got.pop(-1) == got.pop(-2) == (None, None)
    assert all(got[i] == both(small[i]) for i in range(0, 2000, 25))
    # one core; 20 ms an image, as expressions inside the row took, would be 40 s
    assert took < 12


def test_gray_of_coloured_images_of_several_sizes(spark):
    rng = np.random.default_rng(6)
    made = [rng.integers(0, 256, s).astype(np.uint8) for s in [(9, 7, 3), (9, 7, 3), (4, 4, 4), (9, 7, 1), (600, 900, 3)]]
    rows = [(i, x.tobytes(), *x.shape) for i, x in enumerate(made)] + [(9, None, None, None, None), (10, b"short", 5, 5, 3)]
    frame = spark.createDataFrame([(i, None if d is None else bytearray(d), *s) for i, d, *s in rows], "i int, data binary, h int, w int, c int")
    got = {r["i"]: r["f"] for r in frame.select("i", I.gray_features("data", "h", "w", "c").alias("f")).collect()}
    assert all(v is None for v in [*got[9], *got[10]])
    for i, x in enumerate(made):
        x = x.astype(float)
        gray = x[..., 0] if x.shape[2] < 3 else np.rint(x[..., 2] * 0.299 + x[..., 1] * 0.587 + x[..., 0] * 0.114)
        assert (got[i]["phash"], got[i]["dhash"]) == both(gray)
        assert abs(got[i]["mean_v"] - gray.mean()) < 1e-9 and abs(got[i]["sd_v"] - gray.std()) < 1e-6


def test_files_to_features_and_split(spark, tmp_path):
    made = pictures()
    near = made["class_1/img_5.bmp"].copy()
    near[:2, :2] = np.minimum(255, near[:2, :2].astype(int) + 2)
    made["class_1/img_60.bmp"] = near
    for name, x in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(encode(x))
    (tmp_path / "class_1/img_90.bmp").write_bytes(encode(near)[:30])
    (tmp_path / "class_1/notes.txt").write_text("no image")
    got = I.file_features(spark, tmp_path.as_uri()).withColumn("name", F.substring_index("path", "/", -2))
    rows = {r["name"]: r for r in got.collect()}
    assert not rows["class_1/img_90.bmp"]["read_ok"] and rows["class_1/img_90.bmp"]["sd_v"] is None and rows["class_1/img_90.bmp"]["phash"] is None
    for name, x in made.items():
        r = rows[name]
        assert (r["read_ok"], r["class_name"], r["h"], r["w"]) == (True, name.split("/")[0], *x.shape)
        assert (r["phash"], r["dhash"]) == both(x.astype(float))
        assert abs(r["mean_v"] - x.mean()) < 1e-9 and abs(r["sd_v"] - x.std()) < 1e-6
    hashes = got.filter("read_ok").select(
        F.regexp_extract("name", r"_(\d+)\.bmp", 1).cast("long").alias("image_id"), F.right("class_name", F.lit(1)).cast("int").alias("class_index"), "phash", "dhash")
    a, b = (r for r in hashes.filter("image_id in (5, 60)").collect())
    assert bin((a["phash"] ^ b["phash"]) & (2**64 - 1)).count("1") <= 6
    placed = {r["image_id"]: (r["group_id"], r["split"]) for r in D.split_manifest(hashes).collect()}
    assert len(placed) == len(made) and placed[5] == placed[60]
