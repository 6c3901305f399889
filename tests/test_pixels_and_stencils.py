"""Worked examples and identities for pixel and stencil operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentab.operators import batch, pixels as P, stats as A, stencils as W, windows


def raster(spark, *grids):
    rows = [(i, len(g), len(g[0]), [float(v) for r in g for v in r]) for i, g in enumerate(grids)]
    return spark.createDataFrame(rows, "image_id long, h int, w int, cells array<double>")


def grid_of(df, image=0, value="v"):
    cells = {(r["y"], r["x"]): r[value] for r in df.filter(F.col("image_id") == image).collect()}
    h, w = max(k[0] for k in cells) + 1, max(k[1] for k in cells) + 1
    return [[cells[y, x] for x in range(w)] for y in range(h)]


def sliding(x, k, how, stride=(1, 1)):
    """``how`` of every window of the kernel's size."""
    kh, kw = k
    return [[how(x[i : i + kh, j : j + kw]) for j in range(0, x.shape[1] - kw + 1, stride[1])] for i in range(0, x.shape[0] - kh + 1, stride[0])]


def spread_out(x, k, pad=0):
    """Each cell times the kernel, added up where they overlap, less ``pad`` at every side."""
    out = np.zeros((x.shape[0] + k.shape[0] - 1, x.shape[1] + k.shape[1] - 1))
    for (i, j), v in np.ndenumerate(x):
        out[i : i + k.shape[0], j : j + k.shape[1]] += v * k
    return out[pad : out.shape[0] - pad, pad : out.shape[1] - pad].tolist()


def own(seed, *shape):
    return np.random.default_rng(seed).integers(-9, 10, shape).astype(float)


def test_correlation_by_hand(spark):
    x, k = own(11, 5, 7), own(12, 2, 3)
    got = grid_of(W.correlate(W.tiles_from_rasters(raster(spark, x.tolist())), [[k.tolist()]]))
    assert got == sliding(x, k.shape, lambda part: float((part * k).sum()))


def test_pooling_by_hand(spark):
    x = own(13, 6, 5)
    t = W.tiles_from_rasters(raster(spark, x.tolist()))
    assert grid_of(W.pool(t, (3, 2), "max", stride=(1, 1))) == sliding(x, (3, 2), lambda part: float(part.max()))
    assert grid_of(W.pool(t, (2, 4), "avg", stride=(2, 1))) == sliding(x, (2, 4), lambda part: float(part.mean()), (2, 1))


def test_transposed_correlation_by_hand(spark):
    x, k = own(14, 3, 4), own(15, 3, 2)
    t = W.tiles_from_rasters(raster(spark, x.tolist()))
    assert grid_of(W.transpose_correlate(t, k.tolist())) == spread_out(x, k)
    x, k = own(16, 4, 3), own(17, 3, 3)
    assert grid_of(W.transpose_correlate(W.tiles_from_rasters(raster(spark, x.tolist())), k.tolist(), pad=1)) == spread_out(x, k, 1)


def test_padding_and_stride_shapes(spark):
    h, w = 9, 11
    t = W.tiles_from_rasters(raster(spark, np.arange(h * w).reshape(h, w).tolist()))
    for kh, kw, ph, pw, sh, sw in ((1, 4, 0, 2, 1, 1), (7, 3, 3, 0, 1, 2), (4, 4, 1, 2, 3, 1), (2, 6, 0, 1, 2, 5)):
        got = np.array(grid_of(W.correlate(t, [[[[1.0] * kw for _ in range(kh)]]], pad=(ph, pw), stride=(sh, sw)))).shape
        assert got == ((h + 2 * ph - kh) // sh + 1, (w + 2 * pw - kw) // sw + 1)


def test_one_by_one_kernel_is_a_matrix_product(spark):
    rng = np.random.default_rng(1)
    x, k = rng.normal(size=(3, 9)), rng.normal(size=(2, 3))
    df = spark.createDataFrame([(0, 3, 3, x.tolist())], "image_id long, h int, w int, planes array<array<double>>")
    out = W.correlate(W.tiles_from_rasters(df, F.col("planes")), [[[[float(v)]] for v in row] for row in k]).collect()
    got = np.zeros((2, 9))
    for r in out:
        got[r["c"], r["y"] * 3 + r["x"]] = r["v"]
    assert np.allclose(got, k @ x)


def numpy_filter(img, kernel):
    r = len(kernel) // 2
    p = np.pad(img, r, mode="reflect")
    return np.array([[(p[y : y + 2 * r + 1, x : x + 2 * r + 1] * kernel).sum() for x in range(img.shape[1])] for y in range(img.shape[0])])


@pytest.mark.parametrize("side", [4, 7, 64])
def test_tiles_of_a_pixel_table_give_the_whole_image_result(spark, side):
    """A large image cut into tiles with a halo filters exactly like the whole raster."""
    img = np.random.default_rng(2).integers(0, 256, size=(17, 23)).astype(float)
    px = spark.createDataFrame([(5, y, x, float(img[y, x])) for y in range(17) for x in range(23)], "image_id long, y int, x int, v double")
    dims = spark.createDataFrame([(5, 17, 23)], "image_id long, h int, w int")
    tiles = W.tiles_from_pixels(px, dims, halo=3, side=side)
    assert np.allclose(grid_of(W.filter_mirror(tiles, W.LAPLACIAN), 5), numpy_filter(img, np.array(W.LAPLACIAN)))
    g = np.array(W.gaussian_weights(7, 1.5))
    assert np.allclose(grid_of(W.separable_mirror(tiles, list(g)), 5), numpy_filter(img, np.outer(g, g)))
    pooled = np.array(grid_of(W.pool(tiles, (2, 3), "max"), 5))
    assert np.allclose(pooled, img[:16, :21].reshape(8, 2, 7, 3).max(axis=(1, 3)))
    whole = W.tiles_from_rasters(spark.createDataFrame([(5, 17, 23, img.ravel().tolist())], "image_id long, h int, w int, cells array<double>"))
    up = W.bilinear_kernel(4)
    assert np.allclose(grid_of(W.transpose_correlate(tiles, up, 2, 1), 5), grid_of(W.transpose_correlate(whole, up, 2, 1), 5))
    corr = lambda t: grid_of(W.correlate(t, [[own(20, 2, 2).tolist()]], pad=(1, 1), stride=(2, 1)), 5)
    assert np.allclose(corr(tiles), corr(whole))


def test_wide_kernel_uses_two_passes(spark):
    img = np.random.default_rng(3).normal(size=(12, 14))
    t = W.tiles_from_rasters(spark.createDataFrame([(0, 12, 14, img.ravel().tolist())], "image_id long, h int, w int, cells array<double>"))
    g = np.array(W.gaussian_weights(11, 2.0))
    assert np.allclose(grid_of(W.separable_mirror(t, list(g))), numpy_filter(img, np.outer(g, g)))


def test_threshold_conventions(spark):
    px = spark.createDataFrame([(0, 0, i, v) for i, v in enumerate([10, 80, 127, 128, 180, 255])], "image_id long, y int, x int, v int")
    values = lambda df: [r["v"] for r in df.orderBy("x").collect()]
    assert values(P.threshold(px, 127, False)) == [0, 0, 0, 255, 255, 255]
    assert values(P.threshold(px, 127, True)) == [0, 0, 255, 255, 255, 255]


def test_saturation_rounds_half_to_even(spark):
    px = spark.createDataFrame([(0, 0, i, v) for i, v in enumerate([1, 3, 5, 250])], "image_id long, y int, x int, v int")
    half = [r["v"] for r in P.arithmetic(px, "divide", 2).orderBy("x").collect()]
    assert half == [0, 2, 2, 125]
    assert [r["v"] for r in P.arithmetic(px, "divide", 0).orderBy("x").collect()] == [0, 0, 0, 0]
    with pytest.raises(ValueError):
        P.arithmetic(px, "power", 2)


def test_flip_twice_is_identity_and_moves_masks(spark):
    px = spark.createDataFrame([(0, y, x, y * 3 + x, x) for y in range(2) for x in range(3)], "image_id long, y int, x int, v int, mask int")
    back = P.flip(P.flip(px, -1, 2, 3), -1, 2, 3)
    assert sorted(back.collect()) == sorted(px.collect())
    assert all(r["mask"] == 2 - r["x"] for r in P.flip(px, 1, 2, 3).collect())


def test_resize_keeps_every_target_pixel(spark):
    px = spark.createDataFrame([(0, y, x, y * 5 + x) for y in range(5) for x in range(5)], "image_id long, y int, x int, v int")
    for f, n in ((0.75, 4), (0.5, 2), (2.0, 10), (1.6, 8)):
        got = np.array(grid_of(P.resize_nearest(px, f, f, 5, 5)))
        want = [[min(int(y / f), 4) * 5 + min(int(x / f), 4) for x in range(n)] for y in range(n)]
        assert got.tolist() == want


def test_dropout_edges(spark):
    df = spark.range(2000).withColumn("v", F.lit(1.0))
    assert P.dropout(df, "v", 0, 1, ["id"]) is df
    assert P.dropout(df, "v", 1, 1, ["id"]).agg(F.max("v")).first()[0] == 0
    kept = P.dropout(df, "v", 0.5, 1, ["id"])
    assert {r["v"] for r in kept.select("v").distinct().collect()} == {0.0, 2.0}
    assert abs(kept.agg(F.avg("v")).first()[0] - 1) < 0.1
    assert sorted(kept.collect()) == sorted(P.dropout(df.repartition(7), "v", 0.5, 1, ["id"]).collect())
    with pytest.raises(ValueError):
        P.dropout(df, "v", 1.5, 1, ["id"])


def test_constant_image_windows(spark):
    px = spark.createDataFrame([(0, y, x, 7) for y in range(3) for x in range(3)], "image_id long, y int, x int, v int")
    assert {r["v"] for r in windows.equalise(px).collect()} == {7}
    assert {r["v"] for r in windows.min_max(px.withColumn("v", F.col("v").cast("double"))).collect()} == {0.0}


def test_histogram_has_empty_bins(spark):
    px = spark.createDataFrame([(0, 1), (0, 1), (0, 255)], "image_id long, v int")
    h = {r["bin"]: r["n"] for r in A.histogram(px, ["image_id"], "v", 256, 0, 256).collect()}
    assert len(h) == 256 and h[1] == 2 and h[255] == 1 and h[0] == 0


def test_operations_differ_and_unknown_is_refused(spark):
    rng = np.random.default_rng(4)
    planes = [rng.integers(0, 256, 144).astype(float).tolist() for _ in range(3)]
    t = W.tiles_from_rasters(spark.createDataFrame([(0, 12, 12, planes)], "image_id long, h int, w int, planes array<array<double>>"), F.col("planes"))
    results = {name: sorted(batch.run_operation(name, t).select("y", "x", "v").collect()) for name in ("gray", "blur", "edge")}
    assert len(results["gray"]) == len(results["blur"]) == 144 and results["gray"] != results["blur"] != results["edge"]
    with pytest.raises(ValueError):
        batch.run_operation("sharpen", t)


def test_best_epoch_and_patience(spark):
    rows = [(i + 1, m) for i, m in enumerate([0.1, 0.5, 0.5, 0.4, 0.6, 0.6, 0.2, 0.9])]
    h = spark.createDataFrame(rows, "epoch int, metric double")
    r = A.best_epoch(h, 2).first()
    assert (r["best_epoch"], r["best_metric"], r["stop_epoch"], r["epochs_run"]) == (2, 0.5, 4, 4)
    r = A.best_epoch(h, 5).first()
    assert (r["best_epoch"], r["stop_epoch"], r["epochs_run"]) == (8, None, 8)


def test_moving_statistics_fold(spark):
    batches = spark.createDataFrame([(b, 0, float(b * b), 1.0 + b) for b in range(6)], "batch int, j int, mean_v double, var_v double")
    mean = var = 0.0
    for b in range(6):
        mean, var = 0.9 * mean + 0.1 * b * b, 0.9 * var + 0.1 * (1 + b)
    r = A.moving_statistics(batches, 0.9).first()
    assert abs(r["moving_mean"] - mean) < 1e-12 and abs(r["moving_var"] - var) < 1e-12


def test_a_tile_with_a_gap_is_refused(spark):
    px = spark.createDataFrame([(1, y, x, float(y + x)) for y in range(4) for x in range(4) if (y, x) != (1, 2)], "image_id long, y int, x int, v double")
    dims = spark.createDataFrame([(1, 4, 4)], "image_id long, h int, w int")
    with pytest.raises(Exception, match="lacks pixels"):
        W.tiles_from_pixels(px, dims, halo=1, side=4).collect()


RIDGE = "image_id long, h int, w int, oy int, ox int, th int, tw int, y int, x int, m double, strong boolean"


def test_edges_of_very_wide_images_do_not_meet(spark, monkeypatch):
    from lumentab.operators import edges as E

    # (0, 65536) and (1, 0) are far apart; only the second touches a strong pixel
    rows = [(1, 0, 65536, 1.0, False), (1, 1, 0, 1.0, False), (1, 1, 1, 9.0, True), (1 << 40, 1, 2, 1.0, False)]
    monkeypatch.setattr(E, "ridge_pixels", lambda tiles, *a: tiles)
    for side in (1 << 20, 1):
        ridges = [(i, 3, 70000, y // side * side, x // side * side, min(side, 3), min(side, 70000), y, x, m, strong) for i, y, x, m, strong in rows]
        assert sorted(tuple(r) for r in E.edge_map(spark.createDataFrame(ridges, RIDGE)).collect()) == [(1, 1, 0), (1, 1, 1)]


def plain_edges(pixels):
    """Pixels reached from the strong ones, one image after the other."""
    out = set()
    for image in {p[0] for p in pixels}:
        known = {(y, x): strong for i, y, x, strong in pixels if i == image}
        todo = [p for p, strong in known.items() if strong]
        seen = set(todo)
        while todo:
            y, x = todo.pop()
            for step in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if step in known and step not in seen:
                    seen.add(step)
                    todo.append(step)
        out |= {(image, y, x) for y, x in seen}
    return sorted(out)


def test_edges_settle_in_tiles_and_meet_at_their_borders(spark, monkeypatch):
    from lumentab.operators import edges as E

    rng = np.random.default_rng(21)
    h, w = 23, 31
    pixels = [(i, y, x, bool(rng.random() < 0.02)) for i in range(4) for y in range(h) for x in range(w) if rng.random() < 0.3 + 0.1 * i]
    monkeypatch.setattr(E, "ridge_pixels", lambda tiles, *a: tiles)
    linked, right = [], E.components
    monkeypatch.setattr(E, "components", lambda nodes, links: linked.append(links.count()) or right(nodes, links))
    want = plain_edges(pixels)
    for side in (5, 8, 64):
        rows = [(i, h, w, y // side * side, x // side * side, min(side, h - y // side * side), min(side, w - x // side * side), y, x, 1.0, strong) for i, y, x, strong in pixels]
        assert sorted(tuple(r) for r in E.edge_map(spark.createDataFrame(rows, RIDGE)).collect()) == want
    # the graph holds links of border pixels only, and one tile per image needs none
    assert len(linked) == 2 and linked[1] < linked[0] < 4 * len(pixels)


def test_tiled_edge_map_equals_the_whole(spark):
    from lumentab.operators.edges import edge_map

    rng = np.random.default_rng(22)
    x = np.kron(rng.integers(0, 256, (5, 6)), np.ones((4, 4)))
    px = spark.createDataFrame([(0, y, c, float(v)) for (y, c), v in np.ndenumerate(x)], "image_id long, y int, x int, v double")
    dims = spark.createDataFrame([(0, *x.shape)], "image_id long, h int, w int")
    want = sorted(tuple(r) for r in edge_map(W.tiles_from_rasters(raster(spark, x.tolist()))).collect())
    got = sorted(tuple(r) for r in edge_map(W.tiles_from_pixels(px, dims, halo=2, side=7)).collect())
    assert got == want and want


def test_labels_of_long_chains():
    from lumentab.operators.edges import labels

    # a spiral: one component whose pixels come in an order far from the chain's
    side, cells, y, x, dy, dx = 41, set(), 0, 0, 0, 1
    for _ in range(900):
        cells.add((y, x))
        if not (0 <= y + dy < side and 0 <= x + dx < side) or (y + 2 * dy, x + 2 * dx) in cells:
            dy, dx = dx, -dy
        y, x = y + dy, x + dx
    order = np.array(sorted(cells))
    got = labels(np.zeros(len(order), np.int64), order[:, 0], order[:, 1])
    assert set(got.tolist()) == {0}
    two = labels(np.repeat([0, 1], len(order)), np.tile(order[:, 0], 2), np.tile(order[:, 1], 2))
    assert set(two.tolist()) == {0, len(order)}


def test_chain_of_steps(spark):
    x = own(18, 3, 4) + 100
    rows = [(i, 3, 4, x.ravel().tolist(), steps) for i, steps in enumerate([["negative", "mirror"], ["mirror", "negative"], ["upside_down", "mirror"], [], ["negative", "swirl"], [None], None])]
    got = {r["image_id"]: r for r in batch.run_chain(spark.createDataFrame(rows, "image_id long, h int, w int, cells array<double>, steps array<string>")).collect()}
    assert got[0]["cells"] == got[1]["cells"] == (255 - x[:, ::-1]).ravel().tolist()
    assert got[2]["cells"] == x[::-1, ::-1].ravel().tolist() and got[3]["cells"] == x.ravel().tolist()
    assert [got[i]["status"] for i in range(7)] == ["done"] * 4 + ["unknown step swirl", "unknown step null", "unknown step null"]
    assert all(got[i]["cells"] is None for i in (4, 5, 6))


def test_augmentation_is_one_lookup_per_pixel(spark):
    x = np.random.default_rng(19).integers(0, 256, (3, 7, 9)).astype(float)
    rows = [(i, 7, 9, [p.ravel().tolist() for p in x]) for i in range(20)]
    images = spark.createDataFrame(rows, "image_id long, h int, w int, planes array<array<double>>")
    plan = {r["image_id"]: r for r in P.augmentation_plan(images, 3).collect()}
    out = P.augmented(images, 5, 3)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["image_id"], r["y"], r["x"]): r for r in out.collect()}
    assert len(got) == 20 * 25
    for i, p in plan.items():
        angle, bright = np.radians(p["rotation"]), np.zeros((3, 5, 5))
        for y in range(5):
            for c in range(5):
                sy = np.rint((c - 2) * -np.sin(angle) + (y - 2) * np.cos(angle) + 2)
                sx = np.rint((c - 2) * np.cos(angle) + (y - 2) * np.sin(angle) + 2)
                cell = np.array([P.FILL[k] for k in "bgr"], float)
                if 0 <= sy < 5 and 0 <= sx < 5:
                    sx = 4 - sx if p["flip"] else sx
                    cell = x[:, int(p["top"] + (sy + 0.5) * p["crop_h"] // 5), int(p["left"] + (sx + 0.5) * p["crop_w"] // 5)]
                bright[:, y, c] = np.clip(np.rint(cell * p["brightness"]), 0, 255)
        mean = np.clip(np.rint(bright[2] * 0.299 + bright[1] * 0.587 + bright[0] * 0.114), 0, 255).mean()
        flat = np.clip(np.rint(bright * p["contrast"] + mean * (1 - p["contrast"])), 0, 255)
        import colorsys

        for y in range(5):
            for c in range(5):
                b, g, r = flat[:, y, c] / 255
                hue, sat, value = colorsys.rgb_to_hsv(r, g, b)
                want = colorsys.hsv_to_rgb((hue + p["hue"]) % 1, min(1, sat * p["saturation"]), value)
                row = got[i, y, c]
                assert np.abs(np.array([row["r"], row["g"], row["b"]]) - np.array(want) * 255).max() <= 0.5 + 1e-6
