"""Double-threshold edge map, settled inside tiles; only components at inner tile borders meet in a graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumentab.operators import stencils as W
from lumentab.operators.graph import components
from lumentab.session import cut_lineage, ship_package

TAN_22_5 = 0.41421356237309503  # fixed value: tangent of 22.5 degrees

TILE = ["h", "w", "oy", "ox", "th", "tw"]


def ridge_pixels(tiles: DataFrame, low: float, high: float) -> DataFrame:
    """Pixels above ``low`` that are maximal across the edge, with their tile; ``strong`` above ``high``.

    The 5 x 5 cells around a pixel become columns once; the nine gradients use those.
    """
    five, three = range(-2, 3), range(-1, 2)
    pts = W.around(W.core_points(tiles), [(0, dy, dx, 1.0) for dy in five for dx in five], "mirror")
    pts = pts.withColumns({f"_v{dy}_{dx}": W.tap(0, dy, dx) for dy in five for dx in five})

    def slope(kernel, dy, dx):
        terms = [F.col(f"_v{dy + ky}_{dx + kx}") * float(k) for _, ky, kx, k in W.kernel_taps(kernel, centred=True) if k]
        return sum(terms[1:], terms[0])

    def size(dy, dx):
        y, x = F.col("y") + dy, F.col("x") + dx
        inside = (y >= 0) & (y < F.col("h")) & (x >= 0) & (x < F.col("w"))
        return F.when(inside, F.abs(slope(W.SOBEL_X, dy, dx)) + F.abs(slope(W.SOBEL_Y, dy, dx))).otherwise(F.lit(0.0))

    pts = pts.withColumns({f"_m{dy}_{dx}": size(dy, dx) for dy in three for dx in three} | {"gx": slope(W.SOBEL_X, 0, 0), "gy": slope(W.SOBEL_Y, 0, 0)})
    m = F.col("_m0_0")
    maximal = lambda a, b: (m > F.col(f"_m{a[0]}_{a[1]}")) & (m >= F.col(f"_m{b[0]}_{b[1]}"))
    ax, ay = F.abs("gx"), F.abs("gy")
    along = (
        F.when(ay <= ax * TAN_22_5, maximal((0, -1), (0, 1)))
        .when(ax <= ay * TAN_22_5, maximal((-1, 0), (1, 0)))
        .when(F.col("gx") * F.col("gy") > 0, maximal((-1, -1), (1, 1)))
        .otherwise(maximal((-1, 1), (1, -1)))
    )
    pts = pts.select("image_id", *TILE, "y", "x", m.alias("m"), along.alias("ridge"))
    # an empty list drops a pixel; a filter would be pushed below and copy all of the above
    found = F.when((F.col("m") > low) & F.col("ridge"), F.array(F.col("m"))).otherwise(F.array().cast("array<double>"))
    return pts.select("image_id", *TILE, "y", "x", F.explode(found).alias("m")).withColumn("strong", F.col("m") > high)


def labels(tile: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Smallest index of each pixel's 8-connected component; pixels of different tiles never meet.

    Pixels come sorted by tile, y, x. Roots of linked pixels are hung under the smaller root
    and all paths are then halved to their roots, so the rounds follow the logarithm of a chain.
    """
    out = np.arange(len(y))
    if not len(y):
        return out
    width = int(x.max() - x.min()) + 3
    code = (tile * (int(y.max() - y.min()) + 2) + y - y.min()) * width + x - x.min() + 1
    links = []
    for step in (1, width - 1, width, width + 1):
        at = np.minimum(np.searchsorted(code, code + step), len(code) - 1)
        here = np.flatnonzero(code[at] == code + step)
        links.append(np.stack([here, at[here]]))
    a, b = np.concatenate(links, axis=1)
    while True:
        low, high = np.minimum(out[a], out[b]), np.maximum(out[a], out[b])
        apart = low != high
        if not apart.any():
            return out
        a, b = a[apart], b[apart]
        np.minimum.at(out, high[apart], low[apart])
        while (out[out] != out).any():
            out = out[out]


SETTLED = "image_id bigint, y int, x int, strong boolean, open boolean, border boolean, oy int, ox int, label int"


def _settle(part: pa.RecordBatch) -> pa.RecordBatch:
    """Ridges of whole tiles: those of components that are strong, or that an inner border leaves open."""
    column = part.column("ridges")
    sizes = np.diff(column.offsets.to_numpy())
    tile = np.repeat(np.arange(part.num_rows), sizes)
    y, x, strong = (column.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
    order = np.lexsort((x, y, tile))
    tile, y, x, strong = tile[order], y[order].astype(np.int64), x[order].astype(np.int64), strong[order]
    g = {c: part.column(c).to_numpy()[tile] for c in TILE}
    label = labels(tile, y, x)
    # a border is inner where the image goes on behind it
    border = ((y == g["oy"]) & (g["oy"] > 0)) | ((x == g["ox"]) & (g["ox"] > 0))
    border |= ((y == g["oy"] + g["th"] - 1) & (y < g["h"] - 1)) | ((x == g["ox"] + g["tw"] - 1) & (x < g["w"] - 1))
    anchored, reaching = np.zeros(len(y), bool), np.zeros(len(y), bool)
    anchored[label[strong]], reaching[label[border]] = True, True
    strong, open_ = anchored[label], reaching[label]
    keep = np.flatnonzero(strong | open_)
    # numbered within the tile, so that a recomputed batch gives the same names
    first = np.r_[0, np.cumsum(sizes)][tile]
    kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.int32())
    values = (y, x, strong, open_, border, g["oy"], g["ox"], label - first)
    return pa.RecordBatch.from_arrays([part.column("image_id").take(pa.array(tile[keep])), *(pa.array(v[keep], k) for v, k in zip(values, kinds))], names=[c.split()[0] for c in SETTLED.split(", ")])


def edge_map(tiles: DataFrame, low: float = 80.0, high: float = 160.0) -> DataFrame:
    """``image_id, y, x`` of edge pixels: strong ridges and weak ones 8-connected to a strong one.

    A tile's components are labelled in one pass over its ridges. Those that touch no inner
    border are settled there; of the others only the pixels on the borders are linked, so the
    graph is bounded by the perimeters of tiles, and an image of one tile has none.
    """
    ship_package(tiles.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                yield _settle(part)

    # a list holds the ridges of one tile
    ridges = F.collect_list(F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "strong")).alias("ridges")
    grouped = ridge_pixels(tiles, low, high).groupBy("image_id", *TILE).agg(ridges)
    # written once: read by the border links and by the result
    found = cut_lineage(grouped.mapInArrow(run, SETTLED))
    border = found.filter("border").select("image_id", "y", "x", F.struct("image_id", "oy", "ox", "label").alias("id"), "strong")
    settled = found.filter("strong").select("image_id", "y", "x")
    if border.isEmpty():
        return settled
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    reach = border.select("image_id", F.col("id").alias("u"), "y", "x", F.explode(steps).alias("s"))
    reach = reach.select("image_id", "u", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    links = reach.join(border.select("image_id", "y", "x", F.col("id").alias("v")), ["image_id", "y", "x"]).filter("u <> v").select("u", "v")
    nodes = border.groupBy("id").agg(F.max("strong").alias("strong"))
    joined = nodes.join(components(nodes.select("id"), links), "id")
    anchored = joined.filter("strong").select("component").distinct()
    reached = joined.join(anchored, "component", "left_semi").filter("not strong").select("id.*")
    late = found.filter("open and not strong").join(reached, ["image_id", "oy", "ox", "label"], "left_semi")
    return settled.unionByName(late.select("image_id", "y", "x"))
