"""Batch-run and detection summaries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lumentab.functions.numeric import saturate
from lumentab.operators import stencils
from lumentab.operators.edges import edge_map


def detected_per_group(images: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """Images, images with at least one box, and boxes per group."""
    per_image = found.groupBy("image_id").agg(F.count("*").alias("n"))
    j = images.join(per_image, "image_id", "left")
    return j.groupBy(group).agg(F.count("*").alias("images"), F.count("n").alias("detected"), F.coalesce(F.sum("n"), F.lit(0)).alias("boxes_found"))


def run_status(results: DataFrame) -> DataFrame:
    status = F.when(~F.col("read_ok"), "read_failed").when(~F.col("saved"), "write_failed").otherwise("saved")
    return results.withColumn("status", status)


def run_summary(results: DataFrame) -> DataFrame:
    s = run_status(results)
    n = lambda v: F.count(F.when(F.col("status") == v, 1))
    return s.agg(F.count("*").alias("total"), n("saved").alias("saved"), n("read_failed").alias("read_failed"), n("write_failed").alias("write_failed"))


def parse_operation(name: Column, known: tuple[str, ...] = ("gray", "blur", "edge")) -> Column:
    """The operation's number in ``known``, null for an unknown name."""
    out = F.lit(None).cast("int")
    for i, k in reversed(list(enumerate(known))):
        out = F.when(name == k, F.lit(i)).otherwise(out)
    return out


def gray_tiles(tiles: DataFrame) -> DataFrame:
    """Three planes (b, g, r) to one gray plane; one-plane tiles stay."""
    b, g, r = (F.get("planes", F.lit(i)) for i in range(3))
    pairs = F.zip_with(F.zip_with(b, g, lambda x, y: F.struct(x.alias("b"), y.alias("g"))), r, lambda p, z: saturate(z * 0.299 + p["g"] * 0.587 + p["b"] * 0.114).cast("double"))
    return tiles.withColumn("planes", F.when(F.size("planes") == 3, F.array(pairs)).otherwise(F.col("planes")))


def _gray(tiles: DataFrame) -> DataFrame:
    return stencils.filter_mirror(gray_tiles(tiles), [[1.0]]).select("image_id", "y", "x", "v")


def _blur(tiles: DataFrame) -> DataFrame:
    return stencils.gaussian_blur(tiles, 7, 1.5).select("image_id", "y", "x", F.col("v").cast("double").alias("v"))


def _edge(tiles: DataFrame) -> DataFrame:
    return edge_map(gray_tiles(tiles)).withColumn("v", F.lit(255.0))


OPERATIONS: dict[str, Callable[[DataFrame], DataFrame]] = {"gray": _gray, "blur": _blur, "edge": _edge}


def run_operation(name: str, tiles: DataFrame) -> DataFrame:
    """Apply a named operation; an unknown name is refused before any job starts."""
    if name not in OPERATIONS:
        raise ValueError(f"unknown operation {name!r}; known: {sorted(OPERATIONS)}")
    return OPERATIONS[name](tiles)


def run_operations(tiles: DataFrame, column: str = "operation") -> DataFrame:
    """Every tile under the operation that its ``column`` names: ``image_id, operation, status, y, x, v``.

    One plan serves all names; each operation sees the tiles that name it. A tile with an unknown
    or missing name is one reject row, and the rest of the run goes on.
    """
    known = F.coalesce(F.col(column).isin(list(OPERATIONS)), F.lit(False))
    parts = [apply(tiles.filter(F.col(column) == name)).select("image_id", F.lit(name).alias("operation"), F.lit("done").alias("status"), "y", "x", F.col("v").cast("double").alias("v")) for name, apply in OPERATIONS.items()]
    none = lambda kind: F.lit(None).cast(kind)
    rejected = tiles.filter(~known).select("image_id", F.col(column).alias("operation"), F.lit("unknown operation").alias("status"), none("int").alias("y"), none("int").alias("x"), none("double").alias("v"))
    return reduce(DataFrame.unionByName, [*parts, rejected])


def _moved(cells: Column, place: Callable[[Column, Column], Column]) -> Column:
    """Cells of the same raster from other places; ``place`` gives a cell's source from its y and x."""
    w = F.col("w")
    return F.transform(F.sequence(F.lit(0), F.col("h") * w - 1), lambda p: F.get(cells, place(F.floor(p / w).cast("int"), p % w)))


#: Steps of a chain: each maps the cells of one raster row (``h``, ``w``) to new cells.
STEPS: dict[str, Callable[[Column], Column]] = {
    "negative": lambda cells: F.transform(cells, lambda v: 255.0 - v),
    "contrast": lambda cells: F.transform(cells, lambda v: saturate(v * 1.5 + 20).cast("double")),
    "threshold": lambda cells: F.transform(cells, lambda v: F.when(v >= 128, 255.0).otherwise(0.0)),
    "mirror": lambda cells: _moved(cells, lambda y, x: y * F.col("w") + F.col("w") - 1 - x),
    "upside_down": lambda cells: _moved(cells, lambda y, x: (F.col("h") - 1 - y) * F.col("w") + x),
}


def run_chain(rasters: DataFrame, column: str = "steps") -> DataFrame:
    """Rasters after the steps that the array ``column`` names, one after the other: adds ``status``.

    The chain is folded inside the image's row. An unknown or missing step makes the row a
    reject: ``cells`` null, ``status`` names the first such step; an empty chain changes nothing.
    """

    def apply(cells: Column, name: Column) -> Column:
        out = cells
        for known, step in STEPS.items():
            out = F.when(name == known, step(cells)).otherwise(out)
        return out

    unknown = F.filter(column, lambda s: ~F.coalesce(s.isin(list(STEPS)), F.lit(False)))
    good = F.coalesce(F.size(unknown) == 0, F.lit(False))
    folded = F.aggregate(column, F.col("cells"), apply)
    status = F.when(good, "done").otherwise(F.concat(F.lit("unknown step "), F.coalesce(F.get(unknown, F.lit(0)), F.lit("null"))))
    return rasters.withColumns({"cells": F.when(good, folded), "status": status})
