"""Matrix products by dense blocks: a shuffle moves blocks, not cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumentab.session import ship_package

#: Products of one task that are held before their sums are passed on.
HELD = 32


def to_blocks(a: DataFrame, side: int) -> DataFrame:
    """``bi, bj, cells`` of a matrix ``i, j, v``: row-major blocks of ``side`` x ``side``, null where there is no cell."""
    part = lambda c: F.floor(F.col(c) / side).alias(f"b{c}")
    place = (F.pmod("i", F.lit(side)) * side + F.pmod("j", F.lit(side))).cast("int")
    # a group holds the cells of one block
    groups = a.select(part("i"), part("j"), F.struct(place.alias("p"), F.col("v").cast("double").alias("v")).alias("c")).groupBy("bi", "bj").agg(F.collect_list("c").alias("c"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if not batch.num_rows:
                continue
            column = batch.column("c")
            row = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
            at = row * side * side + column.flatten().field(0).to_numpy()
            cells, empty = np.zeros(batch.num_rows * side * side), np.ones(batch.num_rows * side * side, bool)
            cells[at], empty[at] = column.flatten().field(1).to_numpy(zero_copy_only=False), False
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * side * side)
            yield pa.RecordBatch.from_arrays([batch.column("bi"), batch.column("bj"), pa.ListArray.from_arrays(offsets, pa.array(cells, mask=empty))], names=["bi", "bj", "cells"])

    return groups.mapInArrow(run, "bi bigint, bj bigint, cells array<double>")


def _block(cells: pa.ListScalar, side: int) -> tuple[np.ndarray, np.ndarray]:
    values = cells.values
    known = values.is_valid().to_numpy(zero_copy_only=False).reshape(side, side)
    return np.where(known, values.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(side, side), 0.0), known


def multiply_blocks(a: DataFrame, b: DataFrame, side: int = 64, grid: tuple[int, int] = (8, 4)) -> DataFrame:
    """``i, j, v`` of a x b, cells that no inner index feeds left out.

    Blocks meet on a grid: a block of ``a`` goes to its grid row and inner index once for each of
    ``grid[1]`` grid columns, a block of ``b`` once for each of ``grid[0]`` grid rows. So a long
    inner side, a tall ``a`` and a wide ``b`` all spread over tasks, whatever the number of blocks,
    and a cell takes part in ``grid`` copies instead of one row for every product. Products are
    added in the task that makes them before their cells are shuffled. Repeated cells count once,
    null values are 0.
    """
    ship_package(a.sparkSession)
    rows, columns = grid
    left = to_blocks(a, side).withColumns({"r": F.pmod("bi", F.lit(rows)), "c": F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))})
    right = to_blocks(b, side).withColumns({"r": F.explode(F.sequence(F.lit(0), F.lit(rows - 1))), "c": F.pmod("bj", F.lit(columns))})
    left = left.select("r", F.col("bj").alias("inner"), F.col("c").cast("bigint").alias("c"), "bi", F.col("cells").alias("x"))
    right = right.select(F.col("r").cast("bigint").alias("r"), F.col("bi").alias("inner"), "c", F.col("bj").alias("bk"), F.col("cells").alias("y"))

    def flush(held: dict) -> pa.RecordBatch:
        out = []
        for (bi, bk), (total, fed) in held.items():
            i, j = np.nonzero(fed)
            out.append((bi * side + i, bk * side + j, total[i, j]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["i", "j", "v"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in parts:
            for bi, bk, x, y in zip(batch.column("bi").to_pylist(), batch.column("bk").to_pylist(), batch.column("x"), batch.column("y")):
                (p, p_known), (q, q_known) = _block(x, side), _block(y, side)
                product, fed = p @ q, (p_known.astype(np.float32) @ q_known.astype(np.float32)) > 0
                if (bi, bk) in held:
                    product, fed = held[bi, bk][0] + product, held[bi, bk][1] | fed
                held[bi, bk] = product, fed
                if len(held) >= HELD:
                    yield flush(held)
                    held = {}
        if held:
            yield flush(held)

    products = left.join(right, ["r", "inner", "c"]).select("bi", "bk", "x", "y").mapInArrow(run, "i bigint, j bigint, v double")
    return products.groupBy("i", "j").agg(F.sum("v").alias("v"))
