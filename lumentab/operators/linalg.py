"""Matrices as ``i, j, v`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def multiply(a: DataFrame, b: DataFrame, salts: int = 1) -> DataFrame:
    """a(i,j) x b(i,j). A small b is broadcast by the planner after its size check.

    With two large sides the inner index is the join key; ``salts`` spreads each inner
    index over several tasks by row of a, at the price of so many copies of b.
    """
    right = b.select(F.col("i").alias("inner"), F.col("j").alias("k"), F.col("v").alias("bv"))
    left = a.select("i", F.col("j").alias("inner"), F.col("v").alias("av"))
    keys = ["inner"]
    if salts > 1:
        left = left.withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int"))
        right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys.append("salt")
    return left.join(right, keys).groupBy("i", F.col("k").alias("j")).agg(F.sum(F.col("av") * F.col("bv")).alias("v"))


def multiply_vector(a: DataFrame, vector: DataFrame) -> DataFrame:
    v = vector.select(F.col("i").alias("j"), F.col("v").alias("bv"))
    return a.join(v, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("bv")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def asymmetric_cells(a: DataFrame) -> DataFrame:
    """Cells that differ from their mirror cell; none means symmetric."""
    mirrored = transpose(a).withColumnRenamed("v", "m")
    return a.join(mirrored, ["i", "j"], "full_outer").filter(~F.col("v").eqNullSafe(F.col("m")))


def reshape(a: DataFrame, old_width: int, new_width: int) -> DataFrame:
    flat = F.col("i").cast("bigint") * old_width + F.col("j")
    return a.select(F.expr(f"(cast(i as bigint) * {old_width} + j) div {new_width}").alias("i"), (flat % new_width).cast("int").alias("j"), "v")


def hadamard(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Cells ``key, j`` with both factors and their product ``v``, from matrices kept as row arrays."""
    cells = F.zip_with(a, b, lambda x, y: F.struct(x.alias(a), y.alias(b), (x * y).alias("v")))
    return rows.select(key, F.posexplode(cells).alias("j", "c")).select(key, "j", "c.*")


def centre(a: DataFrame) -> DataFrame:
    mean = a.agg(F.avg("v"))
    return a.withColumn("v", F.col("v") - mean.scalar())
