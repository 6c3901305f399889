"""Colour-space columns on 8-bit b, g, r channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumentab.functions.numeric import saturate

# Channel means and deviations of the common image normalisation, in r, g, b order.
CHANNEL_MEAN = {"r": 0.485, "g": 0.456, "b": 0.406}
CHANNEL_STD = {"r": 0.229, "g": 0.224, "b": 0.225}

# The 21 segmentation palette colours (r, g, b) in class order.
PALETTE = [
    (0, 0, 0), (128, 0, 0), (0, 128, 0), (128, 128, 0),
    (0, 0, 128), (128, 0, 128), (0, 128, 128), (128, 128, 128),
    (64, 0, 0), (192, 0, 0), (64, 128, 0), (192, 128, 0),
    (64, 0, 128), (192, 0, 128), (64, 128, 128), (192, 128, 128),
    (0, 64, 0), (128, 64, 0), (0, 192, 0), (128, 192, 0),
    (0, 64, 128),
]


def gray(b: Column, g: Column, r: Column) -> Column:
    return saturate(r * 0.299 + g * 0.587 + b * 0.114)


def hsv(b: Column, g: Column, r: Column, top: Column | None = None, low: Column | None = None) -> list[Column]:
    """8-bit hue in [0, 180), saturation and value; ``top`` and ``low`` may be columns made before."""
    top = F.greatest(b, g, r) if top is None else top
    low = F.least(b, g, r) if low is None else low
    span = (top - low).cast("double")
    # sector offset and signed difference first, so that one division remains
    part = F.when(top == r, g - b).when(top == g, b - r).otherwise(r - g)
    offset = F.when(top == r, F.lit(0.0)).when(top == g, F.lit(120.0)).otherwise(F.lit(240.0))
    angle = F.when(span == 0, F.lit(0.0)).otherwise(part * 60.0 / F.when(span == 0, F.lit(1.0)).otherwise(span) + offset)
    hue = F.pmod(F.rint((angle + F.when((top == r) & (g < b), F.lit(360.0)).otherwise(F.lit(0.0))) / 2.0), F.lit(180.0)).cast("int")
    sat = F.when(top == 0, F.lit(0)).otherwise(saturate(span * 255.0 / F.when(top == 0, 1).otherwise(top)))
    return [hue.alias("h"), sat.alias("s"), top.alias("v")]


def turned(bgr: DataFrame, saturation: Column, turn: Column) -> DataFrame:
    """``b, g, r`` after their saturation is scaled and their hue moved by a share of the circle.

    Goes through hue (six sectors), saturation and value in full precision and back; turns of
    more than half a circle either way are not expected.
    """
    b, g, r = (F.col(c) for c in "bgr")
    low, span = F.least(b, g, r), (F.col("_top") - F.col("_low")).cast("double")
    wide = F.when(span == 0, F.lit(1.0)).otherwise(span)
    sector = F.when(F.col("_top") == r, (g - b) / wide).when(F.col("_top") == g, (b - r) / wide + 2.0).otherwise((r - g) / wide + 4.0)
    moved = F.when(span == 0, F.lit(0.0)).otherwise(sector) + turn * 6.0
    out = bgr.withColumns({"_top": F.greatest(b, g, r), "_low": low})
    out = out.withColumns({
        "_s": F.when(F.col("_top") == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), span / F.when(F.col("_top") == 0, 1).otherwise(F.col("_top")) * saturation)),
        "_h": F.when(moved < 0, moved + 6.0).when(moved >= 6, moved - 6.0).otherwise(moved),
    })
    top, s, f = F.col("_top"), F.col("_s"), F.col("_h") - F.floor("_h")
    out = out.withColumns({"_p": top * (1 - s), "_q": top * (1 - s * f), "_t": top * (1 - s * (1 - f)), "_i": F.floor("_h")})
    # which of value, falling, lowest and rising stands in each sector
    order = {"r": ("_top", "_q", "_p", "_p", "_t", "_top"), "g": ("_t", "_top", "_top", "_q", "_p", "_p"), "b": ("_p", "_p", "_t", "_top", "_top", "_q")}
    pick = lambda names: F.get(F.array(*[F.col(n).cast("double") for n in names]), F.col("_i").cast("int"))
    return out.withColumns({c: saturate(pick(names)) for c, names in order.items()}).drop("_top", "_low", "_s", "_h", "_p", "_q", "_t", "_i")


def normalise(v: Column, channel: str) -> Column:
    return (v / 255.0 - CHANNEL_MEAN[channel]) / CHANNEL_STD[channel]


def denormalise(v: Column, channel: str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v * CHANNEL_STD[channel] + CHANNEL_MEAN[channel]))


def palette_code(r: Column, g: Column, b: Column) -> Column:
    return (r * 256 + g) * 256 + b
