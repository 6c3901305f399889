"""Scores to predictions: scoring, softmax, arg-max, top-k, ensembles and submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumentab.functions.numeric import dot, let
from lumentab.operators.ranking import row_numbers


def linear_scores(vectors: DataFrame, weights: DataFrame, scale: float = 1.0, joined: bool = False) -> DataFrame:
    """``id, scores`` with scores an array of (class_index, z) in class order.

    ``vectors`` has ``id, v`` (array), ``weights`` has ``class_index, i, w``. The model is one
    array value, so the corpus is scored in its scan without a shuffle; the caller asks for
    ``joined`` where the model is too large to be held by every task.
    """
    if joined:
        cells = vectors.select("id", F.posexplode("v").alias("i", "x"))
        sums = cells.join(weights, "i").groupBy("id", "class_index").agg((F.sum(F.col("x") * F.col("w")) * scale).alias("z"))
        return sums.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("class_index", "z"))).alias("scores"))
    rows = weights.groupBy("class_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]).alias("w"))
    model = rows.agg(F.sort_array(F.collect_list(F.struct("class_index", "w"))))
    score = lambda c: F.struct(c["class_index"].alias("class_index"), (dot(F.col("v"), c["w"]) * scale).alias("z"))
    return vectors.withColumn("m", model.scalar()).select("id", F.transform("m", score).alias("scores"))


def softmax(scores: Column) -> Column:
    """Stable softmax of one row's array of (class_index, z): an array of (class_index, p)."""
    raised = lambda m: F.transform(scores, lambda c: F.struct(c["class_index"].alias("class_index"), F.exp(c["z"] - m).alias("e")))
    shares = lambda r: let(F.aggregate(r, F.lit(0.0), lambda t, c: t + c["e"]), lambda t: F.transform(r, lambda c: F.struct(c["class_index"].alias("class_index"), (c["e"] / t).alias("p"))))
    return let(F.array_max(F.transform(scores, lambda c: c["z"])), lambda m: let(raised(m), shares))


def argmax(probs: DataFrame) -> DataFrame:
    """Best class and its probability; equal values go to the lower class. Combines map-side."""
    best = F.max(F.struct("p", (-F.col("class_index")).alias("n")))
    return probs.groupBy("image_id").agg(best.alias("b")).select("image_id", (-F.col("b.n")).alias("predicted_index"), F.col("b.p").alias("confidence"))


def top_k(probs: DataFrame, k: int, classes: int | None = None) -> DataFrame:
    """First k classes per image; a rank limit is pushed below the shuffle."""
    if k < 1 or (classes is not None and k > classes):
        raise ValueError("top_k must be between one and the class count")
    w = Window.partitionBy("image_id").orderBy(F.col("p").desc(), "class_index")
    return probs.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k)


def crop_ensemble(crops: list[Column]) -> Column:
    """Mean over crops of the softmax of each crop; all crops list the classes in one order."""
    total = softmax(crops[0])
    for crop in crops[1:]:
        total = F.zip_with(total, softmax(crop), lambda a, b: F.struct(a["class_index"].alias("class_index"), (a["p"] + b["p"]).alias("p")))
    return F.transform(total, lambda c: F.struct(c["class_index"].alias("class_index"), (c["p"] / float(len(crops))).alias("p")))


def best_classes(probs: Column, k: int, digits: int = 9) -> Column:
    """The first k classes of one row's array of (class_index, p), equal values by lower class."""
    ranked = F.sort_array(F.transform(probs, lambda c: F.struct((-F.round(c["p"], digits)).alias("n"), c["class_index"].alias("class_index"))))
    return F.transform(F.slice(ranked, 1, k), lambda c: c["class_index"])


def wide_submission(probs: DataFrame, classes: list[int], prefix: str = "class_") -> DataFrame:
    """One probability column per class; the class list is given, so no extra pass is needed."""
    wide = probs.groupBy("image_id").pivot("class_index", classes).agg(F.first("p"))
    return wide.select("image_id", *[F.col(str(c)).alias(f"{prefix}{c}") for c in classes])


def string_ordered(preds: DataFrame, key: str) -> DataFrame:
    """Submission rows numbered with the ids sorted as text."""
    return row_numbers(preds.withColumn("id_text", F.col(key).cast("string")), ["id_text"], "position")

