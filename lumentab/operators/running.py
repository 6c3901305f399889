"""Mean and extremes over wide windows at a cost that does not follow the window.

Sums come from summed-area tables, extremes from block-wise running extremes forwards and
backwards (two reads a cell). Prefix tables of an array have no linear built-in form, so the
tile's array is worked on by numpy in Arrow batches; a tile bounds the memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumentab.session import ship_package

SCHEMA = "image_id bigint, y int, x int, v double"


def mirrored(at: np.ndarray, size: int) -> np.ndarray:
    """Reflect coordinates without repeating the edge, for any distance."""
    period = max(2 * (size - 1), 1)
    folded = at % period
    return np.where(folded < size, folded, period - folded)


def window_sums(x: np.ndarray, kh: int, kw: int) -> np.ndarray:
    """Sums over all windows of a padded array, four reads each."""
    table = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    np.cumsum(np.cumsum(x, axis=0), axis=1, out=table[1:, 1:])
    return table[kh:, kw:] - table[:-kh, kw:] - table[kh:, :-kw] + table[:-kh, :-kw]


def window_max(x: np.ndarray, k: int) -> np.ndarray:
    """Largest of k neighbours along the last axis: the rest of one block and the beginning of the next."""
    n = x.shape[-1]
    full = -(-n // k) * k
    blocks = np.full((*x.shape[:-1], full), -np.inf)
    blocks[..., :n] = x
    cut = blocks.reshape(*x.shape[:-1], -1, k)
    before = np.maximum.accumulate(cut, axis=-1).reshape(blocks.shape)
    after = np.maximum.accumulate(cut[..., ::-1], axis=-1)[..., ::-1].reshape(blocks.shape)
    return np.maximum(after[..., : n - k + 1], before[..., k - 1 : n])


def _per_tile(tiles: DataFrame, one: Callable[[np.ndarray, dict], tuple[np.ndarray, int, int]]) -> DataFrame:
    """``image_id, y, x, v`` where ``one`` maps a tile's window and place to values and their first y and x."""
    ship_package(tiles.sparkSession)
    names = ["h", "w", "oy", "ox", "th", "tw", "hy", "hx", "hh", "hw"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            places = {c: part.column(c).to_pylist() for c in names}
            for r, (image, cells) in enumerate(zip(part.column("image_id").to_pylist(), part.column("cells"))):
                at = {c: places[c][r] for c in names}
                value, y, x = one(cells.values.to_numpy(zero_copy_only=False).reshape(at["hh"], at["hw"]), at)
                if value.size:
                    ys, xs = np.indices(value.shape, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(value.size, image, np.int64)), pa.array((ys + np.int32(y)).ravel()), pa.array((xs + np.int32(x)).ravel()), pa.array(value.ravel().astype(float), from_pandas=True)], names=["image_id", "y", "x", "v"])

    return tiles.select(F.col("image_id").cast("bigint").alias("image_id"), *names, F.get("planes", F.lit(0)).alias("cells")).mapInArrow(run, SCHEMA)


def box_mean(tiles: DataFrame, k: int) -> DataFrame:
    """Mean over k x k (k odd) about every core cell of the first plane, borders mirrored; the halo has k // 2 cells or reaches the edge."""
    r = k // 2

    def one(window: np.ndarray, at: dict) -> tuple[np.ndarray, int, int]:
        ys = mirrored(np.arange(at["oy"] - r, at["oy"] + at["th"] + r), at["h"]) - at["hy"]
        xs = mirrored(np.arange(at["ox"] - r, at["ox"] + at["tw"] + r), at["w"]) - at["hx"]
        return window_sums(window[np.ix_(ys, xs)], k, k) / (k * k), at["oy"], at["ox"]

    return _per_tile(tiles, one)


def pool(tiles: DataFrame, size: tuple[int, int], mode: str, stride: tuple[int, int], pad: tuple[int, int]) -> DataFrame:
    """Max or average pooling; a tile gives the outputs whose window begins in its core (or before the image, for the first).

    Padding counts as missing for max and as 0 for average.
    """
    if mode not in ("max", "avg"):
        raise ValueError("mode must be max or avg")

    def outputs(o: int, t: int, whole: int, k: int, p: int, s: int) -> tuple[int, int]:
        last = (whole + 2 * p - k) // s
        low = 0 if o == 0 else -(-(o + p) // s)
        high = last if o + t >= whole else min(last, (o + t - 1 + p) // s)
        return low, high

    def one(window: np.ndarray, at: dict) -> tuple[np.ndarray, int, int]:
        (ya, yb), (xa, xb) = outputs(at["oy"], at["th"], at["h"], size[0], pad[0], stride[0]), outputs(at["ox"], at["tw"], at["w"], size[1], pad[1], stride[1])
        if yb < ya or xb < xa:
            return np.zeros((0, 0)), 0, 0
        ys = np.arange(ya * stride[0] - pad[0], yb * stride[0] - pad[0] + size[0])
        xs = np.arange(xa * stride[1] - pad[1], xb * stride[1] - pad[1] + size[1])
        inside = np.ix_((ys >= 0) & (ys < at["h"]), (xs >= 0) & (xs < at["w"]))
        part = np.full((len(ys), len(xs)), -np.inf if mode == "max" else 0.0)
        part[inside] = window[np.ix_(ys[inside[0].ravel()] - at["hy"], xs[inside[1].ravel()] - at["hx"])]
        if mode == "avg":
            got = window_sums(part, *size) / (size[0] * size[1])
        else:
            got = window_max(window_max(part, size[1]).T, size[0]).T
            got = np.where(np.isinf(got), np.nan, got)
        return got[:: stride[0], :: stride[1]], ya, xa

    return _per_tile(tiles, one)
