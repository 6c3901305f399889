"""Embedding whitening by spectrum slicing.

Rows become integer grid vectors; the distinct ones are the fit list. Spark adds up its sums and
its centred products. On that one matrix, as wide as a vector, inertia counts of shifted LDL'
factors bisect until an interval holds one eigenvalue, Rayleigh quotient iteration takes it to
full precision, and two further counts certify its number from above. Spark then projects every
row and measures the covariance of the projected fit list.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumentab.llm import batches as B
from lumentab.session import cut_lineage, ship_package

#: A grid vector has floor(GRID * c) + OFFSET for every entry c.
GRID, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Grid entries beyond this size count as this size, so that sums of a batch are exact.
REACH = 1 << 40
EPS = np.finfo(np.float64).eps
#: Growth bound of the pivots in an LDL' factorisation.
PIVOT = (1 + 17**0.5) / 8

RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def grid_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: whole-number entries less the offset; vectors that are null or hold null or non-finite entries have no row."""
    entry = F.col("embedding").cast("array<double>")
    odd = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    near = lambda c: F.least(F.greatest(c * F.lit(float(GRID)), F.lit(-float(REACH))), F.lit(float(REACH)))
    return vectors.select("vec_id", entry.alias("embedding")).filter(~odd).select("vec_id", F.transform("embedding", lambda c: F.floor(near(c)).cast("bigint")).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of every entry."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for part in parts:
            if part.num_rows:
                n += part.num_rows
                total = [a + int(b) for a, b in zip(total, _matrix(part.column("x"), width).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([Decimal(v) for v in (n, *total)], pa.decimal128(38, 0))], names=["i", "v"])

    got = dict(fit.select("x").mapInArrow(run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v")).collect())
    return int(got.get(-1, 0)), [int(got.get(i, 0)) for i in range(width)]


def _added(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """Rows of equal ``i`` added entry by entry; a task keeps one line for each of its ``i``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for i, line in zip(batch.column("i").to_pylist(), _matrix(batch.column("line"), width)):
                    held[i] = held[i] + line if i in held else line
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), B.ragged(np.concatenate(list(held.values())), np.full(len(held), width), pa.float64())], names=["i", "line"])

    return rows.repartition(parts, "i").mapInArrow(run, "i int, line array<double>")


def _products(rows: DataFrame, mean: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Sums of y and of y y', one row after the other, for the centred and projected rows y."""
    width, k = to.shape

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for part in parts:
            if part.num_rows:
                y = (_matrix(part.column("x"), width) - mean) @ to
                total[0] += y.sum(axis=0)
                total[1:] += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), B.ragged(total.ravel(), np.full(k + 1, k), pa.float64())], names=["i", "line"])

    out = np.zeros((k + 1, k))
    # k + 1 lines of k numbers, whatever the number of rows
    for i, line in _added(rows.select("x").mapInArrow(run, "i int, line array<double>"), k, min(k + 1, 32)).collect():
        out[i] = line
    return out


def count_above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric ``a`` above ``shift``: positive pivots of P(a - shift)P' = LDL'.

    Pivots are single entries or two-by-two blocks, chosen column by column so that growth is bounded.
    """
    m = a - shift * np.eye(len(a))
    above = 0
    while len(m):
        column = np.abs(m[1:, 0])
        far = int(column.argmax()) + 1 if len(column) else 0
        largest, corner = (column[far - 1] if far else 0.0), abs(m[0, 0])
        if max(largest, corner) == 0.0:
            m = m[1:, 1:]
            continue
        order, block = None, 1
        if corner < PIVOT * largest:
            row = np.abs(m[far])
            row[far] = 0.0
            beside = row.max()
            if corner * beside < PIVOT * largest * largest:
                if abs(m[far, far]) >= PIVOT * beside:
                    order = [far, *range(1, far), 0, *range(far + 1, len(m))]
                else:
                    block = 2
                    order = [0, far, *range(2, far), *([1] if far > 1 else []), *range(far + 1, len(m))]
        if order is not None:
            m = m[np.ix_(order, order)]
        pivot, beside = m[:block, :block], m[block:, :block]
        if block == 1:
            above += int(pivot[0, 0] > 0)
            m = m[1:, 1:] - (beside / pivot[0, 0]) @ beside.T
        else:  # such a block is indefinite: one eigenvalue on either side
            above += 1
            m = m[2:, 2:] - beside @ np.linalg.solve(pivot, beside.T)
    return above


class Slicer:
    """Leading eigenpairs of one covariance; remembers the count at every shift it has tried."""

    def __init__(self, a: np.ndarray):
        self.a = (a + a.T) / 2
        self.scale = float(np.abs(self.a).sum(axis=1).max()) if len(a) else 0.0
        self.noise = 4 * EPS * len(a) * self.scale
        self.counts: dict[float, int] = {}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = count_above(self.a, shift)
        return self.counts[shift]

    def interval(self, k: int, narrow: float) -> tuple[float, float]:
        """Shifts around eigenvalue ``k`` alone, at most ``narrow`` apart, or as near as rounding allows."""
        lo = max((s for s, c in self.counts.items() if c >= k), default=-self.scale)
        hi = min((s for s, c in self.counts.items() if c < k), default=2 * self.scale)
        while hi - lo > self.noise and (hi - lo > narrow or self.above(lo) != k or self.above(hi) != k - 1):
            mid = (lo + hi) / 2
            if self.above(mid) >= k:
                lo = mid
            else:
                hi = mid
        return lo, hi

    def solved(self, shift: float, y: np.ndarray) -> np.ndarray:
        for nudge in (0.0, self.noise, -3 * self.noise):
            try:
                z = np.linalg.solve(self.a - (shift + nudge) * np.eye(len(y)), y)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(z).all():
                return z
        return y

    def pair(self, k: int, found: list[np.ndarray]) -> tuple[float, np.ndarray]:
        """Eigenvalue ``k`` and its vector, at right angles to the ones found before."""
        basis = np.array(found).reshape(len(found), len(self.a))

        def unit(y):
            for _ in range(2):
                y = y - basis.T @ (basis @ y)
            return y / np.linalg.norm(y)

        narrow = np.inf
        while True:
            lo, hi = self.interval(k, narrow)
            shift = (lo + hi) / 2
            y = unit(np.random.default_rng(k).standard_normal(len(self.a)))
            for _ in range(2):
                y = unit(self.solved(shift, y))
            for _ in range(12):
                value = float(y @ self.a @ y)
                if np.linalg.norm(self.a @ y - value * y) <= self.noise:
                    break
                y = unit(self.solved(value, y))
            value = float(y @ self.a @ y)
            if hi - lo <= 2 * self.noise:
                return value, y
            if lo - self.noise <= value <= hi + self.noise and self.above(value - 4 * self.noise) >= k and self.above(value + 4 * self.noise) < k:
                return value, y
            narrow = (hi - lo) / 16


def spectrum(a: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues by falling size and their unit vectors as columns.

    The largest entry of a vector is positive. Directions without spread (eigenvalues that
    rounding cannot tell from 0) are left out.
    """
    s = Slicer(a)
    values, found = [], []
    for k in range(1, min(components, len(a)) + 1):
        if s.scale == 0.0 or s.above(8 * s.noise) < k:
            break
        value, y = s.pair(k, found)
        values.append(value)
        found.append(y if y[np.abs(y).argmax()] > 0 else -y)
    order = np.argsort(-np.array(values), kind="stable") if values else []
    return np.array(values)[order] if values else np.zeros(0), np.array(found).reshape(len(found), len(a))[order].T if values else np.zeros((len(a), 0))


class Fit:
    """What the fit list teaches: sums, covariance, eigenpairs and the projection to unit spread."""

    def __init__(self, vectors: DataFrame, components: int = COMPONENTS):
        ship_package(vectors.sparkSession)
        distinct = cut_lineage(grid_vectors(vectors).select("x").distinct())
        usual = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
        self.width = usual["d"] if usual else 0
        self.rows = distinct.filter(F.size("x") == self.width)
        self.n, self.sums = _sums(self.rows, self.width) if self.width else (0, [])
        self.mean = np.array([s / self.n for s in self.sums])
        covariance = np.zeros((self.width, self.width))
        if self.n:
            covariance = _products(self.rows, self.mean, np.eye(self.width))[1:] / self.n
        self.trace = float(np.trace(covariance))
        self.values, self.vectors = spectrum(covariance, components)
        self.to = self.vectors / np.sqrt(self.values)
        self.error = 0.0
        if len(self.values):
            got = _products(self.rows, self.mean, self.to) / self.n
            self.error = float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(len(self.values))).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over entries of (n x - S)^2, exact; null where that is no 64-bit number."""
    reach = max((max(abs(n * int(hi) - s), abs(n * int(lo) - s)) for hi, lo, s in zip(x.max(axis=0), x.min(axis=0), sums)), default=0)
    if x.shape[1] * reach * reach < 1 << 62 and n * int(np.abs(x).max(initial=0)) < 1 << 62 and max(map(abs, sums), default=0) < 1 << 62:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    wide = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [v if v < 1 << 63 else None for v in wide]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every row and component.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are not read. Defined cases: a
    vector that is null or holds null, NaN or infinite entries has no row; grid entries end at
    2^40 either way; the vectors are as long as most distinct ones are (ties: the longer), others
    have no row; repeated rows and rows without an id are projected each; directions without
    spread are no components, so a table whose vectors are all equal gives no rows, nor does an
    empty one; equal eigenvalues get some orthonormal basis, the same for all rows. ``deviation``
    is null where its exact value passes 64 bits (n beyond about 10^7 at usual spreads).
    """
    fit = Fit(vectors, components)
    width, n, sums, mean, to = fit.width, fit.n, fit.sums, fit.mean, fit.to
    k = len(fit.values)
    explained = fit.values / fit.trace if k else np.zeros(0)
    error = fit.error

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            x = _matrix(part.column("x"), width)
            rows = part.num_rows
            again = np.repeat(np.arange(rows), k)
            arrays = [
                part.column("vec_id").take(pa.array(again)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, n, np.int64)),
                pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(again)),
                pa.array(((x - mean) @ to).ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in RESULT.split(", ")])

    rows = grid_vectors(vectors).filter((F.size("x") == width) & F.lit(k > 0)).select(F.col("vec_id").cast("bigint").alias("vec_id"), "x")
    return rows.mapInArrow(run, RESULT)
