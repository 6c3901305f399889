"""Box columns: corner and centre forms, areas and overlap."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CORNERS = ["x1", "y1", "x2", "y2"]
OFFSET_EPS = 1e-6


def corner_to_centre(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    return [((x1 + x2) / 2).alias("cx"), ((y1 + y2) / 2).alias("cy"), (x2 - x1).alias("bw"), (y2 - y1).alias("bh")]


def centre_to_corner(cx: Column, cy: Column, bw: Column, bh: Column) -> list[Column]:
    return [(cx - bw * 0.5).alias("x1"), (cy - bh * 0.5).alias("y1"), (cx + bw * 0.5).alias("x2"), (cy + bh * 0.5).alias("y2")]


def iou(a, b) -> Column:
    """Intersection over union of two objects indexable by x1, y1, x2, y2."""
    width = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    height = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    shared = width * height
    return shared / (area(a) + area(b) - shared)


def encode_offsets(anchor, truth) -> list[Column]:
    """Ten times the centre shift and five times the log size ratio."""
    ax, ay, aw, ah = corner_to_centre(*[anchor[c] for c in CORNERS])
    tx, ty, tw, th = corner_to_centre(*[truth[c] for c in CORNERS])
    return [
        (((tx - ax) / aw) * 10).alias("dx"), (((ty - ay) / ah) * 10).alias("dy"),
        (F.log(tw / aw + OFFSET_EPS) * 5).alias("dw"), (F.log(th / ah + OFFSET_EPS) * 5).alias("dh"),
    ]


def decode_offsets(anchor, dx: Column, dy: Column, dw: Column, dh: Column) -> list[Column]:
    ax, ay, aw, ah = corner_to_centre(*[anchor[c] for c in CORNERS])
    return centre_to_corner(dx * aw / 10 + ax, dy * ah / 10 + ay, F.exp(dw / 5) * aw, F.exp(dh / 5) * ah)
