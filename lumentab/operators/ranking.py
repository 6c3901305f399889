"""Exact global running sums, row numbers and quantiles without one-task windows.

A window without a partition (or with one hot partition) runs in a single task. Here
rows are cut into order slices first: a bounded sample gives the slice bounds, slice
totals (at most ``slices`` rows per key) give each slice its start, and only the rows
of one slice are sorted together. Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

SAMPLE_ROWS = 4096


def _bounds(df: DataFrame, key: Column, slices: int) -> list:
    """Slice bounds from at most SAMPLE_ROWS rows, picked by hash so that reruns agree.

    An input of any size is cut the same way; one with fewer rows than slices has equal bounds.
    """
    picked = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE_ROWS)
    packed = picked.agg(F.count("*").alias("n"), F.sort_array(F.collect_list("k")).alias("a"))
    if slices < 2:
        return []
    cuts = F.expr(f"array_distinct(transform(sequence(1, {slices - 1}), i -> a[cast(floor(i * n / {slices}) as int)]))")
    return packed.select(F.when(F.col("n") > 0, cuts).alias("b")).first()["b"] or []


def _literal(bound, key_type) -> Column:
    if isinstance(key_type, T.StructType):
        return F.struct(*[F.lit(bound[f.name]).cast(f.dataType).alias(f.name) for f in key_type.fields])
    return F.lit(bound).cast(key_type)


def _slice_of(key: Column, cuts: list[Column], low: int = 0) -> Column:
    """Number of cuts below the key, as a balanced tree of comparisons."""
    if not cuts:
        return F.lit(low)
    middle = len(cuts) // 2
    above = _slice_of(key, cuts[middle + 1 :], low + middle + 1)
    return F.when(key > cuts[middle], above).otherwise(_slice_of(key, cuts[:middle], low))


def running_sums(
    df: DataFrame,
    order: Sequence[str],
    values: dict[str, Column],
    partition: Sequence[str] = (),
    slices: int | None = None,
    sample_from: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running sums of ``values`` in the given total order, per partition key.

    ``slices`` follows ``spark.sql.shuffle.partitions`` unless given. ``sample_from`` may name a cheaper table with the order columns; any sample gives
    right results, it only shapes the slices.
    """
    parts = list(partition)
    key = F.struct(*order) if len(order) > 1 else F.col(order[0])
    within = lambda extra: Window.partitionBy(*parts, *extra).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(df if sample_from is None else sample_from, key, slices)
    if not bounds:
        return df.withColumns({n: F.sum(v).over(within([])) for n, v in values.items()})
    key_type = df.select(key.alias("k")).schema["k"].dataType
    cuts = [_literal(b, key_type) for b in bounds]
    cut = df.withColumns({"_slice": _slice_of(key, cuts), **{f"_v_{n}": v for n, v in values.items()}})
    totals = cut.groupBy(*parts, "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = Window.partitionBy(*parts).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*parts, "_slice", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in values])
    if not parts:
        starts = F.broadcast(starts)  # at most ``slices`` rows
    joined = cut.join(starts, [*parts, "_slice"])
    summed = joined.withColumns({n: F.col(f"_s_{n}") + F.sum(f"_v_{n}").over(within(["_slice"])) for n in values})
    return summed.select(*df.columns, *values)


def running_sum(df: DataFrame, order: Sequence[str], value: Column, name: str, partition: Sequence[str] = (), **kw) -> DataFrame:
    return running_sums(df, order, {name: value}, partition, **kw)


def row_numbers(df: DataFrame, order: Sequence[str], name: str, partition: Sequence[str] = (), **kw) -> DataFrame:
    """``row_number()`` in the given total order, exact and sliced."""
    return running_sums(df, order, {name: F.lit(1).cast("bigint")}, partition, **kw)


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row of linearly interpolated quantiles: ``name -> (column, probability)``.

    Equal values are counted before the ordering step, so a value that fills a third of
    the rows is one row there. All columns share one pass and one ordering.
    """
    columns = sorted({c for c, _ in wanted.values()})
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("q")) for c in columns])
    long = df.select(F.explode(pairs).alias("m")).select("m.*").filter(F.col("q").isNotNull())
    counts = long.groupBy("measure", "q").agg(F.count("*").alias("n"))
    ordered = running_sum(counts, ["q"], F.col("n"), "upto", ["measure"], sample_from=long)
    totals = counts.groupBy("measure").agg(F.sum("n").alias("total"))  # one row per named column
    ranked = ordered.join(F.broadcast(totals), "measure")
    aggs = []
    for name, (column, p) in wanted.items():
        here = F.col("measure") == column
        rank = F.lit(float(p)) * (F.col("total") - 1)
        low = F.min(F.when(here & (F.col("upto") > F.floor(rank)), F.col("q")))
        high = F.min(F.when(here & (F.col("upto") > F.ceil(rank)), F.col("q")))
        share = F.max(F.when(here, rank - F.floor(rank)))
        aggs.append((low + (high - low) * share).alias(name))
    return ranked.agg(*aggs)
