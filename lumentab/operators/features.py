"""Tabular feature preparation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lumentab.functions.numeric import hash_uniform


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def impute_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill missing numbers with column means; all means come from one pass."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]))
    m = df.withColumn("_m", means.scalar())
    return m.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col("_m")[c]) for c in columns}).drop("_m")


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / sample deviation over all rows, then missing values become 0."""
    stats = df.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns]))
    m = df.withColumn("_s", stats.scalar())
    scaled = {c: F.coalesce((F.col(c) - F.col("_s")[c]["m"]) / F.nullif(F.col("_s")[c]["s"], F.lit(0.0)), F.lit(0.0)) for c in columns}
    return m.withColumns(scaled).drop("_s")


def levels_of(df: DataFrame, column: str, most: int) -> list[str]:
    """Sorted distinct values; they become columns, so more than ``most`` of them are refused."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"column {column} has more than {most} levels; use one_hot_long or raise max_levels")
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, columns: list[str], levels: dict[str, list[str]] | None = None, max_levels: int = 10_000) -> DataFrame:
    """0/1 columns per level plus a missing-value column for every text column, even an unused one.

    A level is a column of the result, so a column of more than ``max_levels`` levels is an
    error; ``one_hot_long`` has no such limit.
    """
    levels = levels or {c: levels_of(df, c, max_levels) for c in columns}
    keep = [c for c in df.columns if c not in columns]
    new: list[Column] = []
    for c in columns:
        new += [F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in levels[c]]
        new.append(F.col(c).isNull().cast("int").alias(f"{c}_nan"))
    return df.select(*keep, *new)


def one_hot_long(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The ones of ``one_hot`` as rows ``key, feature, level``; a missing value has a null level."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in columns])
    return df.select(key, F.explode(pairs).alias("p")).select(key, "p.feature", "p.level")


def polynomial(x: Column, degree: int) -> Column:
    """Array x^i / i! for i = 0..degree."""
    return F.array(*[F.pow(x, F.lit(float(i))) / float(math.factorial(i)) for i in range(degree + 1)])


def gaussian(seed: int | str, *keys: str) -> Column:
    """Reproducible standard normal number per row (Box-Muller on two hashed uniforms)."""
    u1 = F.greatest(hash_uniform(f"{seed}:a", *keys), F.lit(1e-12))
    u2 = hash_uniform(f"{seed}:b", *keys)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * math.pi * u2)


def synthetic_linear(ids: DataFrame, key: str, weights: list[float], bias: float, noise: float, seed: int) -> DataFrame:
    """y = Xw + b + noise for every id; a row depends on its id only."""
    rows = ids.select(key, *[gaussian(f"{seed}:x{i}", key).alias(f"x{i}") for i in range(len(weights))])
    total = sum((F.col(f"x{i}") * w for i, w in enumerate(weights)), F.lit(float(bias)))
    return rows.withColumn("y", total + gaussian(f"{seed}:noise", key) * noise)
