"""Pixel-table operators: arithmetic, colour, geometry and augmentation.

All are row-local projections over ``image_id, y, x, v`` (or ``b, g, r``) unless the
operator combines two images, so a corpus scan needs no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumentab.functions import colour
from lumentab.functions.numeric import hash_uniform, saturate


def negative(px: DataFrame) -> DataFrame:
    return px.withColumn("v", F.lit(255) - F.col("v"))


def bitwise_not(px: DataFrame) -> DataFrame:
    return px.withColumn("v", F.bitwise_not(F.col("v")).bitwiseAND(F.lit(255)))


def saturating(op: str, a: Column, b: Column) -> Column:
    if op == "divide":
        return F.when(b == 0, F.lit(0)).otherwise(saturate(a / F.when(b == 0, F.lit(1)).otherwise(b)))
    table = {"add": lambda: a + b, "subtract": lambda: a - b, "multiply": lambda: a * b}
    if op not in table:
        raise ValueError(f"unknown arithmetic operation: {op}")
    return saturate(table[op]().cast("double"))


def arithmetic(px: DataFrame, op: str, value: float) -> DataFrame:
    """Saturating add, subtract, multiply or divide with a constant image."""
    return px.withColumn("v", saturating(op, F.col("v"), F.lit(value)))


def weighted(px: DataFrame, contrast: float, lightness: float) -> DataFrame:
    """Contrast and lightness against a black second image."""
    return px.withColumn("v", saturate(F.col("v") * contrast + lightness))


PAIR_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "and": lambda a, b: a.bitwiseAND(b),
    "or": lambda a, b: a.bitwiseOR(b),
    "add": lambda a, b: saturating("add", a, b),
    "subtract": lambda a, b: saturating("subtract", a, b),
}


def combine(left: DataFrame, right: DataFrame, *ops: str) -> DataFrame:
    """Per-pixel combination of two raster tables (``image_id, h, w, cells``) with the same image ids.

    Images meet as rows, so a pixel is never shuffled on its own.
    """
    both = left.join(right.select("image_id", F.col("cells").alias("others")), "image_id")
    pair = lambda a, b: F.struct(*[PAIR_OPS[o](a.cast("int"), b.cast("int")).alias(f"v_{o}") for o in ops])
    cells = both.select("image_id", "w", F.posexplode(F.zip_with("cells", "others", pair)).alias("i", "c"))
    return cells.select("image_id", F.expr("cast(i div w as int)").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), "c.*")


def to_gray(bgr: DataFrame) -> DataFrame:
    return bgr.select("image_id", "y", "x", colour.gray(F.col("b"), F.col("g"), F.col("r")).alias("v"))


def to_hsv(bgr: DataFrame) -> DataFrame:
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    ends = bgr.withColumns({"_top": F.greatest(b, g, r), "_low": F.least(b, g, r)})
    return ends.select("image_id", "y", "x", *colour.hsv(b, g, r, F.col("_top"), F.col("_low")))


def in_range(df: DataFrame, low: dict[str, float], high: dict[str, float], name: str = "mask") -> DataFrame:
    inside = F.lit(True)
    for c in low:
        inside = inside & F.col(c).between(low[c], high[c])
    return df.withColumn(name, F.when(inside, 255).otherwise(0))


def keep_masked(df: DataFrame, channels: list[str], mask: str = "mask", invert: bool = False) -> DataFrame:
    """AND the channels with a 0/255 mask."""
    keep = F.col(mask) == (0 if invert else 255)
    return df.withColumns({c: F.when(keep, F.col(c)).otherwise(0) for c in channels})


def split_channels(bgr: DataFrame) -> DataFrame:
    """Wide b, g, r to long ``c, v`` with c = 0, 1, 2 for b, g, r."""
    return bgr.select("image_id", "y", "x", F.posexplode(F.array("b", "g", "r")).alias("c", "v"))


def merge_channels(long: DataFrame) -> DataFrame:
    pick = lambda c: F.max(F.when(F.col("c") == c, F.col("v")))
    return long.groupBy("image_id", "y", "x").agg(*[pick(c).alias(n) for c, n in enumerate("bgr")])


def overwrite_channel(long: DataFrame, channel: int, value: int) -> DataFrame:
    return long.withColumn("v", F.when(F.col("c") == channel, F.lit(value)).otherwise(F.col("v")))


def mix_channels(bgr: DataFrame, from_to: list[int]) -> DataFrame:
    """Channel permutation given as from, to, from, to, ..."""
    names = "bgr"
    moved = {names[t]: F.col(names[f]) for f, t in zip(from_to[::2], from_to[1::2])}
    return bgr.select("image_id", "y", "x", *[moved.get(n, F.lit(0)).alias(n) for n in names])


def threshold(px: DataFrame, level: float, inclusive: bool) -> DataFrame:
    hit = F.col("v") >= level if inclusive else F.col("v") > level
    return px.withColumn("v", F.when(hit, 255).otherwise(0))


def crop(px: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    inside = (F.col("y") >= top) & (F.col("y") < bottom) & (F.col("x") >= left) & (F.col("x") < right)
    return px.filter(inside).withColumns({"y": F.col("y") - top, "x": F.col("x") - left})


def paste_on_black(px: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    inside = (F.col("y") >= top) & (F.col("y") < bottom) & (F.col("x") >= left) & (F.col("x") < right)
    return px.withColumn("v", F.when(inside, F.col("v")).otherwise(0))


def flip(px: DataFrame, code: int, h: int | Column, w: int | Column) -> DataFrame:
    """0 flips rows, 1 columns, -1 both; further columns such as a mask move along."""
    h, w = (c if isinstance(c, Column) else F.lit(c) for c in (h, w))
    moves = {}
    if code in (0, -1):
        moves["y"] = h - 1 - F.col("y")
    if code in (1, -1):
        moves["x"] = w - 1 - F.col("x")
    return px.withColumns(moves)


def resize_nearest(px: DataFrame, fy: float, fx: float, h: int, w: int) -> DataFrame:
    """Nearest resize by factors; a source pixel emits its own target pixels, so nothing shuffles."""

    def targets(coord: Column, factor: float, size: int) -> Column:
        out = int(round(size * factor))
        source = lambda d: F.floor(d / F.lit(float(factor)))

        def first_for(c: Column) -> Column:
            """First target whose source is c or beyond (the product may be off by one)."""
            near = F.ceil(c * factor).cast("int") - 1
            return F.when(source(near) >= c, near).when(source(near + 1) >= c, near + 1).otherwise(near + 2)

        low = first_for(coord)
        high = F.least(F.lit(out - 1), F.when(coord == size - 1, F.lit(out - 1)).otherwise(first_for(coord + 1) - 1))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    ys = px.withColumn("ty", F.explode(targets(F.col("y"), fy, h)))
    xs = ys.withColumn("tx", F.explode(targets(F.col("x"), fx, w)))
    keep = [c for c in px.columns if c not in ("y", "x")]
    return xs.select(*keep, F.col("ty").alias("y"), F.col("tx").alias("x"))


def _grid(rasters: DataFrame, height: Column, width: Column, value: Callable[[Column, Column], Column]) -> DataFrame:
    """``image_id, y, x, v`` of a new canvas whose size may differ by image, made inside the image's row."""
    places = rasters.withColumns({"_h": height.cast("int"), "_w": width.cast("int")})
    y, x = lambda p: F.floor(p / F.col("_w")).cast("int"), lambda p: (p % F.col("_w")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("_h") * F.col("_w") - 1), lambda p: F.struct(y(p).alias("y"), x(p).alias("x"), value(y(p), x(p)).alias("v")))
    return places.select("image_id", F.explode(cells).alias("c")).select("image_id", "c.*")


def _cell(y: Column, x: Column) -> Column:
    return F.get("cells", (y * F.col("w") + x).cast("int"))


def _area_mean(y: Column, x: Column) -> Column:
    """Mean of the source cells under a pixel of the ``_h`` x ``_w`` canvas, by the part of each that it covers."""
    ky, kx = F.col("h") / F.col("_h"), F.col("w") / F.col("_w")
    part = lambda c, t, k: F.least(c + 1, (t + 1) * k) - F.greatest(c.cast("double"), t * k)
    covered = lambda t, k, n: F.sequence(F.floor(t * k).cast("int"), F.least(n, F.ceil((t + 1) * k).cast("int")) - 1)
    row = lambda r: F.aggregate(covered(x, kx, F.col("w")), F.lit(0.0), lambda a, c: a + _cell(r, c) * part(c, x, kx))
    total = F.aggregate(covered(y, ky, F.col("h")), F.lit(0.0), lambda a, r: a + row(r) * part(r, y, ky))
    return total / (ky * kx)


def resize_area(rasters: DataFrame, height: Column, width: Column) -> DataFrame:
    """Mean over the source area of every target pixel; each image may have its own target size.

    ``rasters`` has ``image_id, h, w, cells``.
    """
    return _grid(rasters, height, width, _area_mean)


def letterbox(rasters: DataFrame, size: int, fill: float) -> DataFrame:
    """Aspect-keeping nearest resize to ``size`` with padding, the way back is ``letterbox_inverse``."""
    boxed = letterbox_geometry(rasters, size)

    def value(y: Column, x: Column) -> Column:
        r, c = y - F.col("top"), x - F.col("left")
        inside = (r >= 0) & (r < F.col("rh")) & (c >= 0) & (c < F.col("rw"))
        source = _cell(F.floor(r * F.col("h") / F.col("rh").cast("double")), F.floor(c * F.col("w") / F.col("rw").cast("double")))
        return F.when(inside, source).otherwise(F.lit(float(fill)))

    return _grid(boxed, F.lit(size), F.lit(size), value)


def rotate(rasters: DataFrame, degrees: float, fill: float) -> DataFrame:
    """Rotation about the centre onto a canvas that holds all of the image, nearest source pixel."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    height = F.ceil(F.col("h") * abs(c) + F.col("w") * abs(s) - 1e-9)
    width = F.ceil(F.col("h") * abs(s) + F.col("w") * abs(c) - 1e-9)

    def value(y: Column, x: Column) -> Column:
        dy, dx = y - (F.col("_h") - 1) / 2.0, x - (F.col("_w") - 1) / 2.0
        sy = F.rint(dx * -s + dy * c + (F.col("h") - 1) / 2.0)
        sx = F.rint(dx * c + dy * s + (F.col("w") - 1) / 2.0)
        inside = (sy >= 0) & (sy < F.col("h")) & (sx >= 0) & (sx < F.col("w"))
        return F.when(inside, _cell(sy, sx)).otherwise(F.lit(float(fill)))

    return _grid(rasters, height, width, value)


def letterbox_geometry(dims: DataFrame, size: int) -> DataFrame:
    """Scale, resized size and the four paddings of an aspect-keeping resize to ``size``."""
    w, h = F.col("w"), F.col("h")
    scaled = dims.withColumn("scale", F.least(F.lit(float(size)) / w, F.lit(float(size)) / h))
    sized = scaled.withColumns({"rw": F.rint(w * F.col("scale")).cast("int"), "rh": F.rint(h * F.col("scale")).cast("int")})
    pads = sized.withColumns({"left": F.floor((F.lit(size) - F.col("rw")) / 2).cast("int"), "top": F.floor((F.lit(size) - F.col("rh")) / 2).cast("int")})
    return pads.withColumns({"right": F.lit(size) - F.col("rw") - F.col("left"), "bottom": F.lit(size) - F.col("rh") - F.col("top")})


def letterbox_inverse(px: DataFrame, geometry: DataFrame, size: int) -> DataFrame:
    """Drop padded pixels and give each kept pixel its original coordinates."""
    j = px.join(geometry.select("image_id", "w", "h", "rw", "rh", "left", "top", "right", "bottom"), "image_id")
    y, x = F.col("y") - F.col("top"), F.col("x") - F.col("left")
    kept = j.filter((y >= 0) & (F.col("y") < size - F.col("bottom")) & (x >= 0) & (F.col("x") < size - F.col("right")))
    return kept.select(
        "image_id", "y", "x", "v",
        F.floor(y * F.col("h") / F.col("rh")).cast("int").alias("oy"),
        F.floor(x * F.col("w") / F.col("rw")).cast("int").alias("ox"),
    )


def five_crops(dims: DataFrame, resize: int, crop_size: int, keep: Sequence[str] = ()) -> DataFrame:
    """Short side to ``resize``, then four corner crops and the centre crop; ``keep`` columns stay in the row."""
    w, h = F.col("w"), F.col("h")
    rw = F.when(w <= h, F.lit(resize)).otherwise(F.floor(w * resize / h)).cast("int")
    rh = F.when(w <= h, F.floor(h * resize / w)).otherwise(F.lit(resize)).cast("int")
    d = dims.select("image_id", rw.alias("rw"), rh.alias("rh"), *keep)
    far_x, far_y = F.col("rw") - crop_size, F.col("rh") - crop_size
    one = lambda name, top, left: F.struct(F.lit(name).alias("crop"), top.cast("int").alias("top"), left.cast("int").alias("left"))
    zero = F.lit(0)
    crops = F.array(
        one("top_left", zero, zero), one("top_right", zero, far_x), one("bottom_left", far_y, zero),
        one("bottom_right", far_y, far_x), one("centre", F.rint(far_y / 2.0), F.rint(far_x / 2.0)),
    )
    return d.select("image_id", "rw", "rh", *keep, F.explode(crops).alias("c")).select("image_id", "rw", "rh", *keep, "c.*")


def cut_crops(rasters: DataFrame, resize: int, crop_size: int) -> DataFrame:
    """``image_id, crop, y, x, v``: the pixels of the five crops, nearest source pixel, made in the image's row."""
    crops = five_crops(rasters, resize, crop_size, ["h", "w", "cells"])
    at = lambda p, start, size, scaled: F.floor((p + F.col(start)) * F.col(size) / F.col(scaled).cast("double"))
    y, x = lambda p: F.floor(p / crop_size).cast("int"), lambda p: (p % crop_size).cast("int")
    one = lambda p: F.struct(y(p).alias("y"), x(p).alias("x"), _cell(at(y(p), "top", "h", "rh"), at(x(p), "left", "w", "rw")).alias("v"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(crop_size * crop_size - 1)), one)
    return crops.select("image_id", "crop", F.explode(cells).alias("c")).select("image_id", "crop", "c.*")


def normalise(bgr: DataFrame) -> DataFrame:
    return bgr.select("image_id", "y", "x", *[colour.normalise(F.col(c), c).alias(c) for c in "bgr"])


def denormalise(bgr: DataFrame) -> DataFrame:
    return bgr.select("image_id", "y", "x", *[colour.denormalise(F.col(c), c).alias(c) for c in "bgr"])


def palette_table(spark) -> DataFrame:
    rows = [(i, r, g, b, (r * 256 + g) * 256 + b) for i, (r, g, b) in enumerate(colour.PALETTE)]
    return spark.createDataFrame(rows, "class_index int, r int, g int, b int, code int")


def palette_classes(bgr: DataFrame) -> DataFrame:
    """Colour to class; unknown colours are class 0. The palette has 21 fixed rows."""
    lut = palette_table(bgr.sparkSession).select("code", F.col("class_index").alias("c"))
    coded = bgr.withColumn("code", colour.palette_code(F.col("r"), F.col("g"), F.col("b")))
    return coded.join(F.broadcast(lut), "code", "left").select("image_id", "y", "x", F.coalesce("c", F.lit(0)).alias("class_index"))


def class_colours(df: DataFrame, column: str) -> DataFrame:
    lut = palette_table(df.sparkSession).select(F.col("class_index").alias(column), "r", "g", "b")
    return df.join(F.broadcast(lut), column, "left")


def apply_lut(px: DataFrame, lut: DataFrame) -> DataFrame:
    """Look every v up in a caller's table keyed by ``v``; the planner broadcasts it after its size check."""
    return px.join(lut, "v")


def trimap_to_mask(px: DataFrame, background: int = 2) -> DataFrame:
    return px.withColumn("mask", F.when(F.col("v") != background, 1).otherwise(0))


def at_least(dims: DataFrame, min_w: int, min_h: int) -> DataFrame:
    return dims.filter((F.col("w") >= min_w) & (F.col("h") >= min_h))


def detections_in_pixels(boxes: DataFrame, dims: DataFrame, min_score: float) -> DataFrame:
    """Score filter, then edge-scaled corners truncated to whole pixels."""
    j = boxes.filter(F.col("score") > min_score).join(dims.select("image_id", "w", "h"), "image_id")
    scaled = {"left": ("x1", "w"), "top": ("y1", "h"), "right": ("x2", "w"), "bottom": ("y2", "h")}
    return j.select("image_id", "k", "score", *[(F.col(a) * F.col(b)).cast("int").alias(n) for n, (a, b) in scaled.items()])


def dropout(df: DataFrame, column: str, p: float, seed: int, keys: list[str]) -> DataFrame:
    """Zero a share p of the values and scale the rest; keyed by row, not by row order."""
    if not 0 <= p <= 1:
        raise ValueError("p must lie in [0, 1]")
    if p == 0:
        return df
    if p == 1:
        return df.withColumn(column, F.lit(0.0))
    return df.withColumn(column, F.when(hash_uniform(seed, *keys) < p, 0.0).otherwise(F.col(column) / (1 - p)))


def augmentation_plan(dims: DataFrame, seed: int, keep: Sequence[str] = ()) -> DataFrame:
    """Per image: flip decision, crop rectangle, rotation and colour factors; ``keep`` columns stay in the row.

    A crop that does not fit falls back to the whole image.
    """
    u = lambda name: hash_uniform(f"{seed}:{name}", "image_id")
    between = lambda name, lo, hi: F.lit(lo) + u(name) * (hi - lo)
    w, h = F.col("w"), F.col("h")
    plan = dims.withColumns({
        "area": w * h * between("area", 0.7, 1.0),
        "aspect": F.exp(between("aspect", math.log(0.75), math.log(1.33))),
    })
    plan = plan.withColumns({"tw": F.rint(F.sqrt(F.col("area") * F.col("aspect"))), "th": F.rint(F.sqrt(F.col("area") / F.col("aspect")))})
    fits = (F.col("tw") <= w) & (F.col("th") <= h)
    plan = plan.withColumns({"crop_w": F.when(fits, F.col("tw")).otherwise(w).cast("int"), "crop_h": F.when(fits, F.col("th")).otherwise(h).cast("int")})
    return plan.select(
        "image_id",
        (u("flip") < 0.5).alias("flip"),
        F.floor(u("top") * (h - F.col("crop_h") + 1)).cast("int").alias("top"),
        F.floor(u("left") * (w - F.col("crop_w") + 1)).cast("int").alias("left"),
        "crop_w",
        "crop_h",
        between("rotation", -10.0, 10.0).alias("rotation"),
        between("brightness", 0.85, 1.15).alias("brightness"),
        between("contrast", 0.85, 1.15).alias("contrast"),
        between("saturation", 0.9, 1.1).alias("saturation"),
        between("hue", -0.02, 0.02).alias("hue"),
        *keep,
    )


#: Colour of the corners that a rotation leaves empty.
FILL = {"b": 104, "g": 116, "r": 124}


def augmented(rasters: DataFrame, size: int, seed: int) -> DataFrame:
    """``image_id, y, x, b, g, r``: the augmentation plan applied to every image, without a shuffle.

    ``rasters`` has ``image_id, h, w, planes`` (b, g, r). Crop, resize to ``size`` squared, flip
    and rotation are one inverse map from an output pixel to its source pixel, so a pixel is
    looked up once, in the image's own row. The colour factors follow in the plan's order:
    brightness, contrast about the mean gray of the result so far, saturation and hue.
    """
    half = (size - 1) / 2.0
    angle = F.col("rotation") * (math.pi / 180)
    rows = augmentation_plan(rasters, seed, ["h", "w", "planes"]).withColumns({"_cos": F.cos(angle), "_sin": F.sin(angle)})
    # a generator keeps the plan from being computed again for every pixel
    rows = rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("_r")).select("_r.*")

    def source(p: Column) -> Column:
        dy, dx = F.floor(p / size) - half, p % size - half
        sy = F.rint(dx * -F.col("_sin") + dy * F.col("_cos") + half)
        sx = F.rint(dx * F.col("_cos") + dy * F.col("_sin") + half)
        inside = (sy >= 0) & (sy < size) & (sx >= 0) & (sx < size)
        across = F.when(F.col("flip"), size - 1 - sx).otherwise(sx)
        y = F.col("top") + F.floor((sy + 0.5) * F.col("crop_h") / size)
        x = F.col("left") + F.floor((across + 0.5) * F.col("crop_w") / size)
        return F.when(inside, y * F.col("w") + x).otherwise(-1).cast("int")

    def bright(i: Column) -> Column:
        values = {c: F.coalesce(F.get(F.get("planes", F.lit(k)), i), F.lit(float(FILL[c]))) for k, c in enumerate("bgr")}
        return F.struct(*[saturate(v * F.col("brightness")).alias(c) for c, v in values.items()])

    rows = rows.withColumn("_at", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), source))
    rows = rows.withColumn("_lit", F.transform("_at", bright))
    mean = F.aggregate("_lit", F.lit(0.0), lambda a, c: a + colour.gray(c["b"], c["g"], c["r"])) / (size * size)
    out = rows.select("image_id", "contrast", "saturation", "hue", mean.alias("_mean"), F.posexplode("_lit").alias("_p", "_c"))
    out = out.select(
        "image_id", F.floor(F.col("_p") / size).cast("int").alias("y"), (F.col("_p") % size).alias("x"), "saturation", "hue",
        *[saturate(F.col(f"_c.{c}") * F.col("contrast") + F.col("_mean") * (1 - F.col("contrast"))).alias(c) for c in "bgr"],
    )
    return colour.turned(out, F.col("saturation"), F.col("hue")).select("image_id", "y", "x", "b", "g", "r")
