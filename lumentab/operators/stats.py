"""Per-image statistics, histograms, reductions, losses and training-history rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumentab.operators import stencils
from lumentab.operators.ranking import exact_quantiles


def channel_stats(long: DataFrame, keys=("image_id", "c")) -> DataFrame:
    v = F.col("v").cast("double")
    return long.groupBy(*keys).agg(F.max("v").alias("max_v"), F.min("v").alias("min_v"), F.avg(v).alias("mean_v"), F.stddev_pop(v).alias("std_v"))


def quality_features(tiles: DataFrame) -> DataFrame:
    """Brightness, contrast (population deviation) and Laplacian variance per image."""
    cells = stencils.filter_mirror(tiles, stencils.LAPLACIAN, "lap")
    return cells.groupBy("image_id").agg(F.avg("src").alias("brightness"), F.stddev_pop("src").alias("contrast"), F.var_pop("lap").alias("blur"))


def inventory_summary(dims: DataFrame) -> DataFrame:
    """Counts by class, by size text and by channel count in one pass."""
    keyed = dims.select(
        F.explode(
            F.array(
                F.struct(F.lit("class").alias("kind"), F.col("class_index").cast("string").alias("key")),
                F.struct(F.lit("size").alias("kind"), F.concat_ws("x", "w", "h").alias("key")),
                F.struct(F.lit("channels").alias("kind"), F.col("channels").cast("string").alias("key")),
                F.struct(F.lit("all").alias("kind"), F.lit("").alias("key")),
            )
        ).alias("k")
    )
    return keyed.groupBy("k.kind", "k.key").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, keys: list[str], column: str, bins: int, low: float, high: float) -> DataFrame:
    """Half-open equal-width bins, empty ones included; at most ``bins`` cells per key are gathered."""
    inside = (F.col(column) >= low) & (F.col(column) < high)
    b = F.when(inside, F.floor((F.col(column) - low) * bins / (high - low)).cast("int"))
    counts = df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    cells = F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))
    packed = counts.groupBy(*keys).agg(F.map_from_entries(cells).alias("m"))
    return packed.select(*keys, "m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select(
        *keys, "bin", F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).cast("bigint").alias("n")
    )


def histogram_2d(df: DataFrame, first: tuple[str, int, float], second: tuple[str, int, float]) -> DataFrame:
    """Joint histogram over [0, limit) ranges, all cells present."""
    (a, na, la), (b, nb, lb) = first, second
    cell = F.floor(F.col(a) * na / la).cast("int") * nb + F.floor(F.col(b) * nb / lb).cast("int")
    flat = histogram(df.select(cell.alias("cell")), [], "cell", na * nb, 0, na * nb)
    return flat.select(F.expr(f"cast(bin div {nb} as int)").alias("a_bin"), (F.col("bin") % nb).alias("b_bin"), "n")


def quality_thresholds(stats: DataFrame) -> DataFrame:
    """One row: exact 1st and 99th percentiles of the quality features.

    ``stats`` is read several times; cut its lineage when it comes from pixels.
    """
    return exact_quantiles(stats, {
        "brightness_low": ("brightness", 0.01), "brightness_high": ("brightness", 0.99),
        "contrast_low": ("contrast", 0.01), "blur_low": ("blur", 0.01),
    })


def outlier_reasons(stats: DataFrame, thresholds: DataFrame, common_sizes: list[tuple[int, int]]) -> DataFrame:
    """Rows with at least one reason, joined as ``a|b|c``."""
    t = thresholds.select(F.struct("*").alias("t")).scalar()
    with_t = stats.withColumn("t", t)
    common = F.lit(False)
    for w, h in common_sizes:
        common = common | ((F.col("w") == w) & (F.col("h") == h))
    reasons = F.concat_ws(
        "|",
        F.when(F.col("brightness") <= F.col("t.brightness_low"), "very_dark"),
        F.when(F.col("brightness") >= F.col("t.brightness_high"), "very_bright"),
        F.when(F.col("contrast") <= F.col("t.contrast_low"), "low_contrast"),
        F.when(F.col("blur") <= F.col("t.blur_low"), "low_laplacian_variance"),
        F.when(~common, "uncommon_size"),
    )
    return with_t.withColumn("reasons", reasons).drop("t").filter(F.col("reasons") != "")


def reason_counts(outliers: DataFrame) -> DataFrame:
    return outliers.select(F.explode(F.split("reasons", "\\|")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def equal_width_histogram(df: DataFrame, columns: dict[str, Column], bins: int) -> DataFrame:
    """Histogram between the minimum and maximum of each measure; the last bin is closed."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), c.alias("v")) for n, c in columns.items()])).alias("m")).select("m.*")
    edges = long.groupBy("measure").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    table = edges.agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("lo", "hi")))).alias("e"))
    e = F.col("e")[F.col("measure")]
    width = e["hi"] - e["lo"]
    b = F.when(width == 0, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - e["lo"]) / F.when(width == 0, 1.0).otherwise(width) * bins)))
    binned = long.withColumn("e", table.scalar()).withColumn("b", b.cast("int"))
    return histogram(binned, ["measure"], "b", bins, 0, bins)


def reductions(mat: DataFrame) -> DataFrame:
    """Sum, mean and count over rows, columns and everything in one pass."""
    sets = mat.groupingSets([["i"], ["j"], []], "i", "j")
    return sets.agg(F.sum("v").alias("sum_v"), F.avg("v").alias("mean_v"), F.count("v").alias("n"))


def norms(mat: DataFrame) -> DataFrame:
    sets = mat.groupingSets([["i"], []], "i")
    v = F.col("v")
    return sets.agg(F.sqrt(F.sum(v * v)).alias("l2"), F.sum(F.abs(v)).alias("l1"), (F.sum(v * v) / 2).alias("l2_penalty"))


def with_group_value(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates by join: a hot group is pre-aggregated map-side and the
    join can split it, which a window over the group could not."""
    groups = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(groups, keys)


def regression_losses(df: DataFrame, pred: Column, truth: Column, sigma: float = 1.0) -> DataFrame:
    err = pred - truth
    size = F.abs(err)
    smooth = F.when(size < 1 / sigma**2, (err * sigma) ** 2 / 2).otherwise(size - 0.5 / sigma**2)
    logs = F.log(F.greatest(pred, F.lit(1.0))) - F.log(truth)
    return df.agg(
        F.avg(err * err / 2).alias("half_squared"),
        F.avg(err * err).alias("mse"),
        F.sqrt(F.avg(logs * logs)).alias("log_rmse"),
        F.avg(smooth).alias("smooth_l1"),
        F.avg(size).alias("l1"),
    )


def focal(p: Column, gamma: float) -> Column:
    return -F.pow(F.lit(1.0) - p, F.lit(float(gamma))) * F.log(p)


def batch_statistics(mat: DataFrame, batch: Column) -> DataFrame:
    return mat.groupBy(batch.alias("batch"), "j").agg(F.avg("v").alias("mean_v"), F.var_pop("v").alias("var_v"))


def moving_statistics(batches: DataFrame, momentum: float) -> DataFrame:
    """Exponential moving average from 0, written as a weighted sum so that it aggregates in parallel."""
    last = batches.agg(F.max("batch"))
    weight = F.pow(F.lit(momentum), (F.col("last") - F.col("batch")).cast("double")) * (1 - momentum)
    return batches.withColumn("last", last.scalar()).groupBy("j").agg(
        F.sum(weight * F.col("mean_v")).alias("moving_mean"), F.sum(weight * F.col("var_v")).alias("moving_var")
    )


def best_epoch(history: DataFrame, patience: int, run: list[str] | None = None) -> DataFrame:
    """Epoch of the first strict best and the epoch where training would have stopped.

    Epochs per run are few, so one window per run is bounded.
    """
    keys = run or []
    w = Window.partitionBy(*keys).orderBy("epoch")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    h = history.withColumns({"step": F.row_number().over(w), "prior": F.max("metric").over(before)})
    h = h.withColumn("better", F.col("prior").isNull() | (F.col("metric") > F.col("prior")))
    h = h.withColumn("waited", F.col("step") - F.max(F.when(F.col("better"), F.col("step"))).over(upto))
    stop = F.min(F.when(F.col("waited") >= patience, F.col("step")))
    stops = h.groupBy(*keys).agg(stop.alias("stop_step"))
    joined = h.join(stops, keys) if keys else h.withColumn("stop_step", stops.scalar())
    seen = F.col("stop_step").isNull() | (F.col("step") <= F.col("stop_step"))
    pick = F.struct(F.col("metric"), -F.col("step"), F.col("epoch"))
    return joined.filter(seen).groupBy(*keys).agg(
        F.max(pick)["epoch"].alias("best_epoch"), F.max("metric").alias("best_metric"),
        F.max(F.when(F.col("step") == F.col("stop_step"), F.col("epoch"))).alias("stop_epoch"), F.count("*").alias("epochs_run"),
    )
