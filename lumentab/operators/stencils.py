"""Neighbourhood operators on tile rows.

A tile row holds the planes of one image window (a whole small image, or a core window
of a large one with its halo). A scan of raster rows is already tiled, so a filter
needs no shuffle; a long pixel table is tiled with one shuffle, whatever the kernel
size. No tile grows with the image, so one huge image spreads over many tasks.

Columns: image_id, h, w (image), oy, ox, th, tw (core), hy, hx, hh, hw (window), planes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumentab.functions.numeric import saturate
from lumentab.operators import running

GEOMETRY = ["h", "w", "oy", "ox", "th", "tw", "hy", "hx", "hh", "hw"]
UNROLL_LIMIT = 64


def tiles_from_rasters(rasters: DataFrame, planes: Column | None = None) -> DataFrame:
    """Every raster row is one tile."""
    planes = F.array("cells") if planes is None else planes
    zero = F.lit(0)
    return rasters.select(
        "image_id", "h", "w", zero.alias("oy"), zero.alias("ox"), F.col("h").alias("th"), F.col("w").alias("tw"),
        zero.alias("hy"), zero.alias("hx"), F.col("h").alias("hh"), F.col("w").alias("hw"), planes.alias("planes"),
    )


def tiles_from_pixels(px: DataFrame, dims: DataFrame, halo: int, side: int = 256, value: str = "v") -> DataFrame:
    """Tile a dense pixel table; ``dims`` gives ``image_id, h, w``.

    Each pixel goes to the tiles whose window covers it (one for inner pixels), so a
    group holds at most (side + 2 halo)^2 cells.
    """
    p = px.select("image_id", "y", "x", F.col(value).cast("double").alias("v")).join(dims.select("image_id", "h", "w"), "image_id")

    def covering(coord: str, size: str) -> Column:
        first = F.greatest(F.lit(0), F.floor((F.col(coord) - halo) / side)).cast("int")
        last = F.least(F.floor((F.col(coord) + halo) / side), F.floor((F.col(size) - 1) / side)).cast("int")
        return F.sequence(first, last)

    spread = p.withColumn("ty", F.explode(covering("y", "h"))).withColumn("tx", F.explode(covering("x", "w")))
    grouped = spread.groupBy("image_id", "h", "w", "ty", "tx").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("s"))
    start = lambda t: F.col(t) * side
    low = lambda t: F.greatest(F.lit(0), start(t) - halo)
    high = lambda t, size: F.least(F.col(size), start(t) + side + halo)
    # pixels are read by place, so a gap would shift all that follow
    whole = F.size("s") == (high("ty", "h") - low("ty")) * (high("tx", "w") - low("tx"))
    return grouped.select(
        "image_id", "h", "w", start("ty").alias("oy"), start("tx").alias("ox"),
        F.least(F.lit(side), F.col("h") - start("ty")).alias("th"), F.least(F.lit(side), F.col("w") - start("tx")).alias("tw"),
        low("ty").alias("hy"), low("tx").alias("hx"), (high("ty", "h") - low("ty")).alias("hh"), (high("tx", "w") - low("tx")).alias("hw"),
        F.when(whole, F.array(F.transform("s", lambda c: c["v"]))).otherwise(F.raise_error(F.lit("a tile lacks pixels or has one twice"))).alias("planes"),
    )


def mirror(coord: Column, size: Column) -> Column:
    """Reflect without repeating the edge, for any distance."""
    period = F.greatest((size - 1) * 2, F.lit(1))
    folded = F.pmod(coord, period)
    return F.when(folded < size, folded).otherwise(period - folded)


def cell(plane: int, y: Column, x: Column, border: str) -> Column:
    """Value at image coordinates, for coordinates only known inside a loop."""
    h, w = F.col("h"), F.col("w")
    if border == "mirror":
        y, x = mirror(y, h), mirror(x, w)
    index = (y - F.col("hy")) * F.col("hw") + (x - F.col("hx"))
    value = F.get(F.get("planes", F.lit(plane)), index.cast("int"))
    if border == "mirror":
        return value
    return F.when((y >= 0) & (y < h) & (x >= 0) & (x < w), value).otherwise(F.lit(0.0))


def points(tiles: DataFrame, oh: Column, ow: Column, first_y: Column, last_y: Column, first_x: Column, last_x: Column) -> DataFrame:
    """One row per output position of each tile, still carrying the tile by reference."""
    rows = tiles.withColumns({"_fy": first_y, "_ly": F.least(last_y, oh - 1), "_fx": first_x, "_lx": F.least(last_x, ow - 1)})
    rows = rows.filter("_fy <= _ly and _fx <= _lx")
    width = F.col("_lx") - F.col("_fx") + 1
    spread = rows.withColumn("_p", F.explode(F.sequence(F.lit(0), (F.col("_ly") - F.col("_fy") + 1) * width - 1)))
    return spread.withColumns({"y": F.col("_fy") + F.floor(F.col("_p") / width).cast("int"), "x": F.col("_fx") + F.col("_p") % width})


def with_offsets(pts: DataFrame, rows: dict[int, Column], cols: dict[int, Column], border: str, planes: int = 1) -> DataFrame:
    """Window offsets of the needed rows and columns, computed once per output position.

    ``rows`` and ``cols`` map a tap offset to its image coordinate. An offset is null
    outside the image unless the border mirrors. Keeps the generated code of a tap to one
    addition and one array read.
    """
    h, w = F.col("h"), F.col("w")

    def inside(c: Column, size: Column) -> Column:
        return mirror(c, size) if border == "mirror" else F.when((c >= 0) & (c < size), c)

    at = {f"_r{dy}": ((inside(c, h) - F.col("hy")) * F.col("hw")).cast("int") for dy, c in rows.items()}
    at |= {f"_c{dx}": (inside(c, w) - F.col("hx")).cast("int") for dx, c in cols.items()}
    at |= {f"_p{i}": F.get("planes", F.lit(i)) for i in range(planes)}
    return pts.withColumns(at)


def tap(plane: int, dy: int, dx: int, empty: float | None = None) -> Column:
    """Cell at offsets prepared by ``with_offsets``."""
    value = F.get(F.col(f"_p{plane}"), F.col(f"_r{dy}") + F.col(f"_c{dx}"))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def around(pts: DataFrame, taps, border: str) -> DataFrame:
    """Offsets for taps given relative to the output position."""
    rows = {dy: F.col("y") + dy for dy in sorted({t[1] for t in taps} | {0})}
    cols = {dx: F.col("x") + dx for dx in sorted({t[2] for t in taps} | {0})}
    return with_offsets(pts, rows, cols, border, max([t[0] for t in taps] + [0]) + 1)


def core_points(tiles: DataFrame) -> DataFrame:
    last = lambda o, t: F.col(o) + F.col(t) - 1
    return points(tiles, F.col("h"), F.col("w"), F.col("oy"), last("oy", "th"), F.col("ox"), last("ox", "tw"))


def weighted_sum(taps: Sequence[tuple[int, int, int, float]], empty: float | None = None) -> Column:
    """Sum over taps (plane, dy, dx, weight) at prepared offsets."""
    terms = [tap(plane, dy, dx, empty) * F.lit(float(k)) for plane, dy, dx, k in taps if k != 0]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def kernel_taps(kernel: Sequence[Sequence[float]], plane: int = 0, centred: bool = False) -> list[tuple[int, int, int, float]]:
    cy, cx = (len(kernel) // 2, len(kernel[0]) // 2) if centred else (0, 0)
    return [(plane, dy - cy, dx - cx, float(k)) for dy, row in enumerate(kernel) for dx, k in enumerate(row)]


def _out_size(size: Column, k: int, pad: int, stride: int) -> Column:
    return F.floor((size + 2 * pad - k) / stride).cast("int") + 1


def _strided(tiles: DataFrame, kh: int, kw: int, pad: tuple[int, int], stride: tuple[int, int]) -> DataFrame:
    """Output points of a strided window; an output belongs to the tile of its first cell."""

    def span(o: str, t: str, p: int, s: int):
        first = F.when(F.col(o) == 0, F.lit(0)).otherwise(F.ceil((F.col(o) + p) / s).cast("int"))
        last = F.ceil((F.col(o) + F.col(t) + p) / s).cast("int") - 1
        return first, last

    oh, ow = _out_size(F.col("h"), kh, pad[0], stride[0]), _out_size(F.col("w"), kw, pad[1], stride[1])
    (fy, ly), (fx, lx) = span("oy", "th", pad[0], stride[0]), span("ox", "tw", pad[1], stride[1])
    return points(tiles, oh, ow, fy, ly, fx, lx)


def correlate(tiles: DataFrame, kernels: Sequence[Sequence[Sequence[Sequence[float]]]], pad=(0, 0), stride=(1, 1)) -> DataFrame:
    """Cross-correlation; ``kernels[c_out][c_in]`` is a 2-D kernel. Zero padding.

    Returns ``image_id, c, y, x, v`` with c the output channel.
    """
    kh, kw = len(kernels[0][0]), len(kernels[0][0][0])
    pts = _strided(tiles, kh, kw, pad, stride)
    rows = {dy: F.col("y") * stride[0] - pad[0] + dy for dy in range(kh)}
    cols = {dx: F.col("x") * stride[1] - pad[1] + dx for dx in range(kw)}
    pts = with_offsets(pts, rows, cols, "empty", len(kernels[0]))
    outs = [weighted_sum([t for c, k in enumerate(bank) for t in kernel_taps(k, c)], 0.0) for bank in kernels]
    if len(outs) == 1:
        return pts.select("image_id", F.lit(0).alias("c"), "y", "x", outs[0].alias("v"))
    return pts.select("image_id", "y", "x", F.posexplode(F.array(*outs)).alias("c", "v")).select("image_id", "c", "y", "x", "v")


def transpose_correlate(tiles: DataFrame, kernel: Sequence[Sequence[float]], stride: int = 1, pad: int = 0) -> DataFrame:
    """Transposed correlation: every cell spreads its kernel; written as a gather."""
    kh, kw = len(kernel), len(kernel[0])
    size = lambda c, k: (F.col(c) - 1) * stride + k - 2 * pad
    first = lambda o: F.when(F.col(o) == 0, F.lit(0)).otherwise(F.col(o) * stride - pad)
    # the tile at the far edge also owns the cells beyond the last core position
    last = lambda o, t, full, k: F.when(F.col(o) + F.col(t) >= F.col(full), size(full, k) - 1).otherwise((F.col(o) + F.col(t)) * stride - pad - 1)
    pts = points(tiles, size("h", kh), size("w", kw), first("oy"), last("oy", "th", "h", kh), first("ox"), last("ox", "tw", "w", kw))

    source = lambda c, d: F.when((F.col(c) + pad - d) % stride == 0, F.floor((F.col(c) + pad - d) / stride).cast("int"))
    pts = with_offsets(pts, {dy: source("y", dy) for dy in range(kh)}, {dx: source("x", dx) for dx in range(kw)}, "empty")
    return pts.select("image_id", "y", "x", weighted_sum(kernel_taps(kernel), 0.0).alias("v"))


def pool(tiles: DataFrame, size: tuple[int, int], mode: str, stride: tuple[int, int] | None = None, pad: tuple[int, int] = (0, 0)) -> DataFrame:
    """Max or average pooling; padding counts as missing for max and as 0 for average.

    Windows of more than ``UNROLL_LIMIT`` cells run on prefix tables, whatever their size.
    """
    stride = stride or size
    if size[0] * size[1] > UNROLL_LIMIT:
        return running.pool(tiles, size, mode, stride, pad)
    pts = _strided(tiles, *size, pad, stride)
    rows = {dy: F.col("y") * stride[0] - pad[0] + dy for dy in range(size[0])}
    cols = {dx: F.col("x") * stride[1] - pad[1] + dx for dx in range(size[1])}
    pts = with_offsets(pts, rows, cols, "empty")
    empty = None if mode == "max" else 0.0
    cells = [tap(0, dy, dx, empty) for dy in range(size[0]) for dx in range(size[1])]
    if mode == "max":
        value = F.greatest(*cells) if len(cells) > 1 else cells[0]
    elif mode == "avg":
        value = sum(cells[1:], cells[0]) / float(len(cells))
    else:
        raise ValueError("mode must be max or avg")
    return pts.select("image_id", "y", "x", value.alias("v"))


def filter_mirror(tiles: DataFrame, kernel: Sequence[Sequence[float]], name: str = "v") -> DataFrame:
    """Centred filter of the same size with mirrored borders; keeps the source value as ``src``."""
    taps = [t for t in kernel_taps(kernel, centred=True) if t[3] != 0]
    pts = around(core_points(tiles), taps, "mirror")
    return pts.select("image_id", "y", "x", tap(0, 0, 0).alias("src"), weighted_sum(taps).alias(name))


def gaussian_weights(size: int, sigma: float) -> list[float]:
    raw = [math.exp(-((i - (size - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [r / sum(raw) for r in raw]


def separable_mirror(tiles: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Filter with the outer product of ``weights`` and mirrored borders.

    Small kernels are unrolled directly. Larger ones filter the rows inside the tile
    first, then the columns, so the work grows with the edge of the kernel.
    """
    r = len(weights) // 2
    if len(weights) ** 2 <= UNROLL_LIMIT:
        return filter_mirror(tiles, [[a * b for b in weights] for a in weights]).select("image_id", "y", "x", "v")
    table = F.array(*[F.lit(float(k)) for k in weights])

    def row_pass(p: Column) -> Column:
        y = F.floor(p / F.col("tw")).cast("int") + F.col("hy")
        x = p % F.col("tw") + F.col("ox")
        one = lambda acc, i: acc + cell(0, y, x + i - r, "mirror") * F.get(table, i)
        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * r)), F.lit(0.0), one)

    rows = F.transform(F.sequence(F.lit(0), F.col("hh") * F.col("tw") - 1), row_pass)
    first = tiles.withColumns({"planes": F.array(rows), "hx": F.col("ox"), "hw": F.col("tw")})
    taps = [(0, i - r, 0, float(k)) for i, k in enumerate(weights)]
    return around(core_points(first), taps, "mirror").select("image_id", "y", "x", weighted_sum(taps).alias("v"))


def box_blur(tiles: DataFrame, k: int) -> DataFrame:
    """Mean over k x k with mirrored borders; wide windows run on summed-area tables."""
    if k * k > UNROLL_LIMIT:
        return running.box_mean(tiles, k).withColumn("v", saturate(F.col("v")))
    return separable_mirror(tiles, [1.0 / k] * k).withColumn("v", saturate(F.col("v")))


def gaussian_blur(tiles: DataFrame, size: int, sigma: float) -> DataFrame:
    return separable_mirror(tiles, gaussian_weights(size, sigma)).withColumn("v", saturate(F.col("v")))


def bilateral(tiles: DataFrame, radius: int, sigma_value: float, sigma_space: float) -> DataFrame:
    """Edge-keeping mean over a disc: space weight times value weight."""
    span = range(-radius, radius + 1)
    taps = [(0, dy, dx, math.exp(-(dy * dy + dx * dx) / (2 * sigma_space * sigma_space))) for dy in span for dx in span if dy * dy + dx * dx <= radius * radius]
    pts = around(core_points(tiles), taps, "mirror")
    pts = pts.withColumns({f"_v{i}": tap(0, dy, dx) for i, (_, dy, dx, _k) in enumerate(taps)} | {"_m": tap(0, 0, 0)})
    near = lambda i: F.col(f"_v{i}") - F.col("_m")
    pts = pts.withColumns({f"_w{i}": F.exp(near(i) * near(i) / (-2 * sigma_value * sigma_value)) * t[3] for i, t in enumerate(taps)})
    top = sum((F.col(f"_v{i}") * F.col(f"_w{i}") for i in range(1, len(taps))), F.col("_v0") * F.col("_w0"))
    bottom = sum((F.col(f"_w{i}") for i in range(1, len(taps))), F.col("_w0"))
    return pts.select("image_id", "y", "x", (top / bottom).alias("v"))


LAPLACIAN = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]
SOBEL_X = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SOBEL_Y = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]


def bilinear_kernel(size: int) -> list[list[float]]:
    factor = (size + 1) // 2
    centre = factor - 1 if size % 2 == 1 else factor - 0.5
    line = [1 - abs(i - centre) / factor for i in range(size)]
    return [[a * b for b in line] for a in line]
