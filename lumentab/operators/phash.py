"""Perceptual hashes of raster rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lumentab.functions.numeric import let
from lumentab.session import ship_package

#: Cells of equally large images that are hashed together (4 MB); a larger image goes alone.
GROUP_CELLS = 1 << 19
HASHES = T.StructType([T.StructField("phash", T.LongType()), T.StructField("dhash", T.LongType())])


def difference_bits(cells: Column, h: int, w: int) -> Column:
    """Right neighbour greater than left, row by row: h x (w - 1) bits."""
    n = h * (w - 1)

    def one(p: Column) -> Column:
        at = (p + F.floor(p / (w - 1))).cast("int")
        return F.get(cells, at + 1) > F.get(cells, at)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


def cosine_rows(n: int, keep: int) -> list[list[float]]:
    """First ``keep`` rows of the orthonormal DCT-II matrix of size n."""
    rows = []
    for u in range(keep):
        scale = math.sqrt((1 if u == 0 else 2) / n)
        rows.append([scale * math.cos(math.pi * (2 * i + 1) * u / (2 * n)) for i in range(n)])
    return rows


def low_dct(cells: Column, n: int = 32, keep: int = 8) -> Column:
    """Top-left keep x keep block of the 2-D DCT of an n x n raster, row-major.

    Two products with the same constant cosine rows, inside the row: the raster first
    shrinks to keep x n, then to keep x keep.
    """
    rows = F.array(*[F.array(*[F.lit(v) for v in r]) for r in cosine_rows(n, keep)])
    seq = lambda k: F.sequence(F.lit(0), F.lit(k - 1))
    total = lambda f: F.aggregate(seq(n), F.lit(0.0), lambda acc, i: acc + f(i))

    def first(c: Column) -> Column:
        cell = lambda p: total(lambda i: F.get(F.get(c, F.floor(p / n).cast("int")), i) * F.get(cells, (i * n + p % n).cast("int")))
        return F.transform(seq(keep * n), cell)

    def second(c: Column, half: Column) -> Column:
        cell = lambda p: total(lambda i: F.get(half, (F.floor(p / keep) * n + i).cast("int")) * F.get(F.get(c, (p % keep).cast("int")), i))
        return F.transform(seq(keep * keep), cell)

    return let(rows, lambda c: let(first(c), lambda half: second(c, half)))


def area_weights(n: int, m: int) -> np.ndarray:
    """Share of each of n source cells in each of m cells of an area resize, m x n."""
    k = n / m
    t, c = np.arange(m)[:, None], np.arange(n)
    return np.maximum(np.minimum(c + 1, (t + 1) * k) - np.maximum(c, t * k), 0.0) / k


def area_bytes(stack: np.ndarray, height: int, width: int) -> np.ndarray:
    """8-bit area resize of equally large rasters (n, h, w).

    Six places first: halves that sums of products miss by a last bit go to the even side as well.
    """
    mean = area_weights(stack.shape[1], height) @ stack @ area_weights(stack.shape[2], width).T
    return np.clip(np.rint(np.round(mean, 6)), 0, 255)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Signed 64-bit numbers of rows of 64 bits, first bit highest."""
    return np.packbits(bits, axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64)


def _above_median(low: np.ndarray) -> np.ndarray:
    """Bit per coefficient of 8 x 8 blocks: greater than the median of all but the first."""
    low = low.reshape(len(low), 64)
    return _packed(low > np.median(low[:, 1:], axis=1)[:, None])


def stack_hashes(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``phash`` and ``dhash`` of equally large gray rasters (n, h, w)."""
    rows = np.array(cosine_rows(32, 8))
    low = np.round(rows @ area_bytes(stack, 32, 32) @ rows.T, 6)
    nine = area_bytes(stack, 8, 9)
    return _above_median(low), _packed((nine[:, :, 1:] > nine[:, :, :-1]).reshape(len(stack), 64))


def equal_sizes(h: pd.Series, w: pd.Series, whole: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """Positions of the ``whole`` rasters with one size, in groups of a few megabytes of cells."""
    places = pd.DataFrame({"h": h.to_numpy(), "w": w.to_numpy()}).loc[whole].groupby(["h", "w"]).indices
    found = np.flatnonzero(whole)
    for (height, width), at in places.items():
        step = max(1, GROUP_CELLS // int(height * width))
        for first in range(0, len(at), step):
            yield found[at[first : first + step]], int(height), int(width)


@F.pandas_udf(HASHES)
def raster_hashes(h: pd.Series, w: pd.Series, cells: pd.Series) -> pd.DataFrame:
    """Both hashes of gray rasters, null where the cells are not those of a raster of that size."""
    out = pd.DataFrame({c: pd.array([None] * len(cells), "Int64") for c in ("phash", "dhash")})
    size = np.array([-1 if c is None else len(c) for c in cells], dtype=np.int64)
    for at, height, width in equal_sizes(h, w, (size > 0) & (size == (h * w).to_numpy())):
        stack = np.stack([cells.iloc[i] for i in at]).astype(float).reshape(len(at), height, width)
        out.iloc[at, 0], out.iloc[at, 1] = stack_hashes(stack)
    return out


@F.pandas_udf(T.LongType())
def square_hashes(cells: pd.Series) -> pd.Series:
    out, rows = pd.Series([None] * len(cells), dtype="Int64"), np.array(cosine_rows(32, 8))
    whole = np.flatnonzero([c is not None and len(c) == 1024 for c in cells])
    for first in range(0, len(whole), GROUP_CELLS // 1024):
        at = whole[first : first + GROUP_CELLS // 1024]
        stack = np.stack([cells.iloc[i] for i in at]).astype(float).reshape(len(at), 32, 32)
        out.iloc[at] = _above_median(rows @ stack @ rows.T)
    return out


def perceptual_hash(cells: Column) -> Column:
    """64-bit hash of a 32 x 32 raster, null for another size; coefficients are not rounded."""
    ship_package(SparkSession.active())
    return square_hashes(cells)


def image_hashes(rasters: DataFrame) -> DataFrame:
    """Gray rasters (``h, w, cells``) of any size with ``phash`` and ``dhash``.

    The cosine hash sees the image at 32 x 32, the difference hash at 8 rows of 9 pixels.
    Coefficients are taken to six places, so an even image has no bits by chance. Nothing is
    shuffled; resize and cosines are matrix products over the equally large images of a batch.
    """
    ship_package(rasters.sparkSession)
    hashed = rasters.withColumn("_hashes", raster_hashes("h", "w", "cells"))
    return hashed.select(*rasters.columns, "_hashes.phash", "_hashes.dhash")
