"""Window-like operators written as aggregate-and-join, so that one hot image can be split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lumentab.functions.numeric import saturate
from lumentab.operators.stats import with_group_value


def equalise(px: DataFrame) -> DataFrame:
    """Histogram equalisation per image; the look-up table has at most 256 rows per image."""
    counts = px.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("image_id").orderBy("v")
    lut = counts.withColumn("cdf", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lut = lut.withColumns({
        "low": F.first("cdf").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum("n").over(Window.partitionBy("image_id")),
    })
    span = F.col("total") - F.col("low")
    mapped = F.when(span != 0, saturate((F.col("cdf") - F.col("low")) * 255.0 / F.when(span != 0, span)))
    lut = lut.select("image_id", "v", F.coalesce(mapped, F.col("v")).alias("q"))
    return px.join(lut, ["image_id", "v"]).select("image_id", "y", "x", F.col("q").alias("v"))


def min_max(px: DataFrame) -> DataFrame:
    ranged = with_group_value(px, ["image_id"], lo=F.min("v"), hi=F.max("v"))
    span = F.col("hi") - F.col("lo")
    return ranged.select("image_id", "y", "x", F.when(span == 0, F.lit(0.0)).otherwise((F.col("v") - F.col("lo")) / F.when(span != 0, span)).alias("v"))
