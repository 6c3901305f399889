"""Classification and segmentation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumentab.functions.numeric import ratio
from lumentab.operators.ranking import exact_quantiles, row_numbers
from lumentab.session import cut_lineage

EPSILON = 1e-7


def overall(preds: DataFrame) -> DataFrame:
    """Accuracy, counts and mean cross-entropy; ``preds`` has ``correct`` and ``p``, the true class's probability."""
    hit = F.col("correct").cast("bigint")
    return preds.agg(
        F.count("*").alias("images"), F.sum(hit).alias("correct"), F.sum(1 - hit).alias("incorrect"),
        F.avg(hit.cast("double")).alias("accuracy"), F.avg(-F.log(F.greatest(F.col("p"), F.lit(1e-9)))).alias("loss"),
    )


def class_dimension(spark, count: int) -> DataFrame:
    return spark.range(count).select(F.col("id").cast("int").alias("class_index"))


def per_class_report(preds: DataFrame, classes: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support for every listed class, 0 where undefined."""
    sides = F.array(
        F.struct(F.col("true_index").alias("class_index"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.col("correct").cast("int").alias("c")),
        F.struct(F.col("predicted_index").alias("class_index"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("c")),
    )
    counts = preds.select(F.explode(sides).alias("s")).select("s.*").groupBy("class_index").agg(
        F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("c").alias("correct")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    r = classes.join(counts, "class_index", "left").select("class_index", zero("support"), zero("predicted"), zero("correct"))
    r = r.withColumns({"precision": ratio(F.col("correct"), F.col("predicted")), "recall": ratio(F.col("correct"), F.col("support"))})
    total = F.col("precision") + F.col("recall")
    f1 = F.when(total == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / F.when(total != 0, total))
    return r.select("class_index", "precision", "recall", f1.alias("f1_score"), "support", "correct", (F.col("support") - F.col("correct")).alias("incorrect"))


def macro_f1(report: DataFrame) -> DataFrame:
    return report.agg(F.avg("f1_score").alias("macro_f1"), F.count("*").alias("classes"))


def confusion_matrix(preds: DataFrame, classes: int) -> DataFrame:
    """Dense matrix, raw and divided by the row sum (0 for absent classes)."""
    spark = preds.sparkSession
    grid = class_dimension(spark, classes).withColumnRenamed("class_index", "true_index").withColumn("predicted_index", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    counts = preds.groupBy("true_index", "predicted_index").agg(F.count("*").alias("c"))
    dense = grid.join(counts, ["true_index", "predicted_index"], "left").withColumn("n", F.coalesce("c", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("true_index"))
    return dense.select("true_index", "predicted_index", "n", ratio(F.col("n"), total).alias("share"))


def confusion_pairs(preds: DataFrame) -> DataFrame:
    pairs = preds.filter("true_index <> predicted_index").groupBy("true_index", "predicted_index").agg(F.count("*").alias("n"))
    return pairs.orderBy(F.col("n").desc(), "true_index", "predicted_index")


def topk_flags(topk: DataFrame) -> DataFrame:
    """One row per image: first guess right, any of the first three right."""
    same = F.col("class_index") == F.col("expected_index")
    return topk.groupBy("image_id", "expected_index", "view_type", "test_type").agg(
        F.max(F.when(F.col("k") == 1, same).otherwise(F.lit(False))).alias("top1"), F.max(same & (F.col("k") <= 3)).alias("top3")
    )


def topk_accuracy(flags: DataFrame) -> DataFrame:
    """Overall, per view and per class in one pass."""
    n = F.count("*")
    one, three = F.sum(F.col("top1").cast("bigint")), F.sum(F.col("top3").cast("bigint"))
    sets = flags.groupingSets([["view_type"], ["expected_index"], []], "view_type", "expected_index")
    return sets.agg(
        n.alias("images"), F.coalesce(one, F.lit(0)).alias("top1_correct"), ratio(F.coalesce(one, F.lit(0)), n).alias("top1_accuracy"),
        F.coalesce(three, F.lit(0)).alias("top3_correct"), ratio(F.coalesce(three, F.lit(0)), n).alias("top3_accuracy"),
    )


def confidence_audit(first_guesses: DataFrame, level: float = 0.8) -> DataFrame:
    return first_guesses.agg(
        F.count("*").alias("images"), F.count(F.when(F.col("p") >= level, 1)).alias("high_confidence"),
        F.avg("p").alias("mean_confidence"), F.max("p").alias("max_confidence"),
    )


def prediction_bias(preds: DataFrame) -> DataFrame:
    return preds.groupBy("predicted_index").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "predicted_index")


# ---- segmentation -----------------------------------------------------------------------


def mask_parts(masks: DataFrame) -> DataFrame:
    """Per image: intersection, prediction, target and union sums and the pixel count."""
    t, p = F.col("t"), F.col("p")
    return masks.groupBy("image_id").agg(
        F.sum(t * p).alias("both"), F.sum(p).alias("pred"), F.sum(t).alias("truth"), F.sum(F.greatest(t, p)).alias("either"), F.count("*").alias("pixels")
    )


def mask_scores(parts: DataFrame) -> DataFrame:
    dice = (2 * F.col("both") + EPSILON) / (F.col("pred") + F.col("truth") + EPSILON)
    return parts.select(
        "image_id", dice.alias("dice"), ((F.col("both") + EPSILON) / (F.col("either") + EPSILON)).alias("iou"), (F.col("truth") / F.col("pixels")).alias("foreground_ratio")
    )


def global_mask_scores(parts: DataFrame) -> DataFrame:
    s = lambda c: F.sum(c)
    return parts.agg(
        (2 * s("both") / (s("pred") + s("truth") + EPSILON)).alias("global_dice"), (s("both") / (s("either") + EPSILON)).alias("global_iou"), F.count("*").alias("images")
    )


def score_distribution(scores: DataFrame) -> DataFrame:
    """Mean, extremes and exact medians; one row per image goes in, written once because it is read twice."""
    scores = cut_lineage(scores.select("dice", "iou"))
    simple = scores.agg(F.avg("dice").alias("mean_dice"), F.min("dice").alias("min_dice"), F.max("dice").alias("max_dice"), F.avg("iou").alias("mean_iou"))
    medians = exact_quantiles(scores, {"median_dice": ("dice", 0.5), "median_iou": ("iou", 0.5)})
    m = medians.select(F.struct("*").alias("m"))
    return simple.withColumn("m", m.scalar()).select("*", "m.*").drop("m")


def foreground_bucket(share: Column, low: float = 0.01, high: float = 0.99) -> Column:
    return F.when(share == 0, "all_background").when(share < low, "near_background").when(share > high, "near_foreground").otherwise("valid")


def pick_cases(scores: DataFrame) -> DataFrame:
    """Worst three, middle three and best three by dice (ties by image id)."""
    n = scores.agg(F.count("*"))
    ranked = row_numbers(scores, ["dice", "image_id"], "r").withColumn("n", n.scalar())
    middle = F.floor(F.col("n") / 2)
    case = F.array_compact(
        F.array(
            F.when(F.col("r") <= 3, "worst"),
            F.when((F.col("r") >= middle) & (F.col("r") <= middle + 2), "median"),
            F.when(F.col("r") > F.col("n") - 3, "best"),
        )
    )
    return ranked.withColumn("case_name", F.explode(case)).select("case_name", "image_id", "dice", "iou")


def soft_losses(masks: DataFrame, probability: Column) -> DataFrame:
    """Per image mean binary cross-entropy and 1 - soft dice."""
    p, t = probability, F.col("t")
    bce = -(t * F.log(p) + (1 - t) * F.log(1 - p))
    return masks.groupBy("image_id").agg(F.avg(bce).alias("bce"), (1 - (2 * F.sum(p * t) + EPSILON) / (F.sum(p) + F.sum(t) + EPSILON)).alias("dice_loss"))
