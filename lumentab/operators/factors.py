"""Least squares from one pass: additive moments for folds, orthogonal factors for ill-conditioned designs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumentab.operators.splits import fold_blocks
from lumentab.session import cut_lineage, ship_package

#: Tasks of the first merging of factors.
FAN_IN = 64


class Moments:
    """Count, means and centred products of some columns; sums and differences need no rows."""

    def __init__(self, n: float, mean: np.ndarray, products: np.ndarray):
        self.n, self.mean, self.products = n, mean, products

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * other.n / n, self.products + other.products + np.outer(gap, gap) * self.n * other.n / n)

    def __sub__(self, part: Moments) -> Moments:
        n = self.n - part.n
        if not n:
            return Moments(0.0, np.zeros_like(self.mean), np.zeros_like(self.products))
        mean = (self.mean * self.n - part.mean * part.n) / n
        gap = part.mean - mean
        return Moments(n, mean, self.products - part.products - np.outer(gap, gap) * n * part.n / self.n)

    def line(self, penalty: float = 0.0) -> tuple[np.ndarray, float]:
        """Weights of all columns but the last, which is the label, and the bias."""
        c = self.products / max(self.n, 1.0)
        weights = np.linalg.lstsq(c[:-1, :-1] + penalty * np.eye(len(c) - 1), c[:-1, -1], rcond=None)[0]
        return weights, float(self.mean[-1] - weights @ self.mean[:-1])


def moments(df: DataFrame, columns: list[str], by: str) -> dict[int, Moments]:
    """Moments of each group of ``by``, combined map-side; one row per group reaches the driver."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    means = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]
    products = [F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]
    out = {}
    for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *means, *products).collect():
        c = np.zeros((len(columns), len(columns)))
        for i, j in pairs:
            c[i, j] = c[j, i] = r[f"c{i}_{j}"] * r["n"]
        out[r[by]] = Moments(float(r["n"]), np.array([r[f"m{i}"] for i in range(len(columns))]), c)
    return out


def k_fold_log_rmse(df: DataFrame, key: str, label: str, features: list[str], k: int, penalty: float = 0.0) -> DataFrame:
    """``fold, part, log_rmse`` of every contiguous fold.

    The rows are numbered once. One pass gives the moments of every block; a fold learns from the
    total less its own block, and one more pass scores each row under all k lines where it stands,
    so no row is copied and nothing is cached. A fold without rows to learn from has no errors.
    """
    blocks = cut_lineage(fold_blocks(df.select(key, label, *features), key, k).select("block", label, *features))
    each = moments(blocks, [*features, label], "block")
    if not each:
        return df.sparkSession.createDataFrame([], "fold int, part string, log_rmse double")
    total = reduce(Moments.__add__, each.values())
    errors = []
    for fold in sorted(each):
        weights, bias = (total - each[fold]).line(penalty)
        pred = sum((F.col(c) * float(w) for c, w in zip(features, weights)), F.lit(bias))
        gap = F.log(F.greatest(pred, F.lit(1.0))) - F.log(F.col(label))
        for part, here in (("train", F.col("block") != fold), ("valid", F.col("block") == fold)):
            errors.append(F.struct(F.lit(fold).cast("int").alias("fold"), F.lit(part).alias("part"), F.sqrt(F.avg(F.when(here, gap * gap))).alias("log_rmse")))
    return blocks.agg(F.array(*errors).alias("e")).select(F.explode("e").alias("e")).select("e.*").filter("log_rmse is not null")


def triangle(df: DataFrame, row: Column, width: int) -> np.ndarray:
    """R of the QR factors of the matrix whose rows are the array column ``row``, ``width`` wide.

    Every task folds its rows into one small triangle; triangles meet in ``FAN_IN`` tasks and then
    in one, a triangle at a time, so nothing that is held grows with the rows.
    """
    ship_package(df.sparkSession)

    def folded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for part in parts:
            if part.num_rows:
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                r = np.linalg.qr(np.concatenate([r, x]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(r.ravel()), width).cast(pa.list_(pa.float64()))], names=["x"])

    fold = lambda rows: rows.mapInArrow(folded, "x array<double>")
    lines = fold(fold(fold(df.select(row.alias("x"))).withColumn("_t", F.spark_partition_id() % FAN_IN).repartition(FAN_IN, "_t").select("x")).repartition(1)).collect()
    r = np.zeros((width, width))
    if lines:
        r[: len(lines)] = [line["x"] for line in lines]
    return r


def solved(r: np.ndarray, terms: int, penalty: float = 0.0, free: int = 0) -> np.ndarray:
    """Weights of the first ``terms`` columns for the last one; the ``free`` first are not penalised.

    The leading columns of R are the factor of the leading columns, so one triangle serves all
    nested models. ``penalty`` adds its square root as rows under R.
    """
    lines = np.concatenate([r[:, :terms], np.sqrt(penalty) * np.eye(terms)[free:]])
    target = np.concatenate([r[:, -1], np.zeros(terms - free)])
    return np.linalg.lstsq(lines, target, rcond=None)[0]


def ridge_sweep(df: DataFrame, label: str, features: list[str], penalties: list[float]) -> DataFrame:
    """``penalty, weight_norm, intercept, mse``: one pass for all penalties, the error from the same triangle."""
    width = len(features) + 2
    row = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in (*features, label)])
    r, n = triangle(df, row, width), df.count()
    out = []
    for p in penalties:
        w = solved(r, width - 1, p * n, 1)
        rest = r @ np.append(w, -1.0)
        out.append((float(p), float(np.linalg.norm(w[1:])), float(w[0]), float(rest @ rest / max(n, 1))))
    return df.sparkSession.createDataFrame(out, "penalty double, weight_norm double, intercept double, mse double")


def nested_fits(df: DataFrame, label: str, degrees: list[int], column: str = "poly") -> DataFrame:
    """``degree, train_mse, test_mse`` for growing numbers of terms (``part`` = train or test).

    One triangle of the training rows serves all degrees; one more pass scores both parts.
    """
    width = max(degrees) + 2
    terms = F.slice(F.col(column), 1, max(degrees) + 1)
    r = triangle(df.filter("part = 'train'"), F.concat(terms, F.array(F.col(label).cast("double"))), width)
    errors = []
    for d in degrees:
        pred = F.aggregate(F.zip_with(F.slice(F.col(column), 1, d + 1), F.array(*[F.lit(float(w)) for w in solved(r, d + 1)]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        mean = lambda part, gap=pred - F.col(label): F.avg(F.when(F.col("part") == part, gap * gap))
        errors.append(F.struct(F.lit(d).alias("degree"), mean("train").alias("train_mse"), mean("test").alias("test_mse")))
    return df.agg(F.array(*errors).alias("e")).select(F.explode("e").alias("e")).select("e.*")
