"""Box tables: overlap joins, anchors, assignment, suppression and decoding.

Tables carry ``image_id, k`` (box number in its image) and corners. Sequential rules
(greedy matching, suppression) run as an array fold per image while an image has at most
``fold_limit`` boxes; larger images go through rounds of joins that give the same answer.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumentab.functions.geometry import CORNERS, decode_offsets, encode_offsets, iou
from lumentab.operators.ranking import row_numbers, running_sums
from lumentab.session import cut_lineage, ship_package

FOLD_LIMIT = 512
#: Best open boxes of a tile that one round judges, and binary size classes that share a tile grid.
TILE_BOXES, TILE_LEVELS = 800, 3
#: Below this threshold boxes of very different size suppress each other, and tiles would not part them.
LEAST_TILED = 0.125
MIN_CONFIDENCE = 0.009999999  # fixed value: boxes fainter than this become background


def _levelled(boxes: DataFrame) -> DataFrame:
    """Boxes with an area and their size class: the power of two that the longer side fits in."""
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return boxes.filter("x2 > x1 and y2 > y1").withColumn("level", F.ceil(F.log2(side)).cast("int"))


def _gridded(boxes: DataFrame, levels: Column, span: int | None = None) -> DataFrame:
    """One row per size class from the box's own up, and per cell of that class it lies in (four at most).

    ``span`` keeps the classes that are at most so many above the box's own.
    """
    near = lambda v: (v >= F.col("level")) & (F.lit(True) if span is None else v <= F.col("level") + span)
    wide = boxes.withColumn("_levels", levels).withColumn("at", F.explode(F.filter("_levels", near))).drop("_levels")
    cell = F.pow(F.lit(2.0), F.col("at"))
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    return wide.withColumn("gy", F.explode(span("y1", "y2"))).withColumn("gx", F.explode(span("x1", "x2")))


def _size_span(threshold: float) -> int:
    """Binary size classes by which two boxes with an IoU above the threshold differ at most."""
    return math.ceil(math.log2(1 / threshold))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """Pairs of boxes of one image with IoU > ``least``; pairs that do not touch have IoU 0 and no row.

    Boxes meet in the grid of the larger box's size class, whatever the unit: cells are as
    wide as the larger box, so each box lies in four cells at most. The cell that holds the
    upper-left corner of the shared area reports the pair, so each pair appears once without
    a distinct. The list of size classes in use holds at most one entry per binary exponent.
    """
    keys = keys or ["image_id"]
    a = _levelled(left.select(*keys, F.col("k").alias("ka"), F.struct(*CORNERS).alias("a"), *CORNERS))
    b = _levelled(right.select(*keys, F.col("k").alias("kb"), F.struct(*CORNERS).alias("b"), *CORNERS))
    levels = a.select("level").unionByName(b.select("level")).agg(F.collect_set("level")).scalar()
    span = _size_span(least) if least > 0 else None  # the sides of such boxes differ by less than a factor of 1 / least
    a = _gridded(a, levels, span).drop(*CORNERS).withColumnRenamed("level", "la")
    b = _gridded(b, levels, span).drop(*CORNERS).withColumnRenamed("level", "lb")
    j = a.join(b, [*keys, "at", "gy", "gx"]).filter(F.col("at") == F.greatest("la", "lb"))
    cell = F.pow(F.lit(2.0), F.col("at"))
    first = (F.floor(F.greatest("a.y1", "b.y1") / cell) == F.col("gy")) & (F.floor(F.greatest("a.x1", "b.x1") / cell) == F.col("gx"))
    j = j.filter(first).withColumn("iou", iou(F.col("a"), F.col("b")))
    return j.filter(F.col("iou") > least).select(*keys, "ka", "kb", "iou", "a", "b")


def crowded_images(boxes: DataFrame, limit: int) -> DataFrame | None:
    """Images with more than ``limit`` boxes, None when there are none (one pruned scan)."""
    found = boxes.groupBy("image_id").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("image_id")
    return None if found.isEmpty() else cut_lineage(found)


def _number_in_image(df: DataFrame, order: list[str], name: str, crowded: DataFrame | None) -> DataFrame:
    """Row number per image: a plain window while images are small, sliced otherwise."""
    if crowded is not None:
        return row_numbers(df, order, name, ["image_id"])
    return df.withColumn(name, F.row_number().over(Window.partitionBy("image_id").orderBy(*order)).cast("bigint"))


def greedy_match(pairs: DataFrame, keys: list[str], order: list[Column], crowded: DataFrame | None = None) -> DataFrame:
    """Take pairs (ka, kb) in the given total order while both ends are free, per key.

    Crowded images: a pair that is first for both of its ends is taken by the greedy rule
    in any case, so all such pairs are taken at once, their ends leave, and so on.
    """
    ranked = pairs.select(*keys, F.struct(*order, F.col("ka").alias("ka"), F.col("kb").alias("kb")).alias("p"))
    small = ranked if crowded is None else ranked.join(crowded, "image_id", "left_anti")
    lists = small.groupBy(*keys).agg(F.sort_array(F.collect_list("p")).alias("ps"))
    none = F.array().cast("array<struct<ka:int,kb:int>>")

    def step(taken: Column, p: Column) -> Column:
        free = ~F.exists(taken, lambda t: (t["ka"] == p["ka"]) | (t["kb"] == p["kb"]))
        return F.when(free, F.concat(taken, F.array(F.struct(p["ka"].cast("int").alias("ka"), p["kb"].cast("int").alias("kb"))))).otherwise(taken)

    out = lists.select(*keys, F.explode(F.aggregate("ps", none, step)).alias("t")).select(*keys, "t.ka", "t.kb")
    if crowded is None:
        return out
    open_ = cut_lineage(ranked.join(crowded, "image_id", "left_semi").select(*keys, "p", F.col("p.ka").cast("int").alias("ka"), F.col("p.kb").cast("int").alias("kb")))
    rounds = 0
    while not open_.isEmpty():
        a_best = open_.groupBy(*keys, "ka").agg(F.min("p").alias("pa"))
        b_best = open_.groupBy(*keys, "kb").agg(F.min("p").alias("pb"))
        both = open_.join(a_best, [*keys, "ka"]).join(b_best, [*keys, "kb"])
        taken = cut_lineage(both.filter("p = pa and p = pb").select(*keys, "ka", "kb"))
        out, rounds = out.unionByName(taken), rounds + 1
        if rounds % 8 == 0:
            out = cut_lineage(out)
        rest = open_.join(taken.select(*keys, "ka"), [*keys, "ka"], "left_anti").join(taken.select(*keys, "kb"), [*keys, "kb"], "left_anti")
        open_ = cut_lineage(rest)
    return out


def anchor_grid(maps: DataFrame, sizes: list[float], ratios: list[float]) -> DataFrame:
    """Anchors of every map cell: all sizes with the first ratio, the first size with the others.

    ``maps`` has ``image_id, fh, fw``. Columns ``k`` (position in the list) and corners.
    """
    shapes = [(s, ratios[0]) for s in sizes] + [(sizes[0], r) for r in ratios[1:]]
    table = F.array(*[F.struct(F.lit(float(s * r**0.5)).alias("w"), F.lit(float(s / r**0.5)).alias("h")) for s, r in shapes])
    cells = maps.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("fh") * F.col("fw") - 1)))
    rows = cells.select("*", F.posexplode(table).alias("n", "s"))
    cy = (F.floor(F.col("p") / F.col("fw")) + 0.5) / F.col("fh")
    cx = (F.col("p") % F.col("fw") + 0.5) / F.col("fw")
    w, h = F.col("s.w") * F.col("fh") / F.col("fw"), F.col("s.h")
    keep = [c for c in maps.columns if c not in ("fh", "fw")]
    return rows.select(
        *keep, (F.col("p") * len(shapes) + F.col("n")).alias("k"),
        (cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"),
    )


def assign_anchors(anchors: DataFrame, truths: DataFrame, threshold: float = 0.5, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """``image_id, k, truth``: each anchor's truth box, anchors without one left out.

    First every truth takes its anchor greedily by (IoU desc, anchor, truth); pairs with
    IoU 0 follow at the end, which pairs the remaining truths with the remaining anchors in
    number order. Other anchors take their best truth when its IoU reaches the threshold.
    """
    pairs = cut_lineage(overlap_pairs(anchors, truths).select("image_id", "ka", "kb", "iou"))  # read by both rules
    crowded = crowded_images(anchors.select("image_id").unionByName(truths.select("image_id")), fold_limit)
    greedy = greedy_match(pairs, ["image_id"], [(-F.col("iou")).alias("o")], crowded).select("image_id", F.col("ka").alias("k"), F.col("kb").alias("truth"))
    left_truths = truths.select("image_id", F.col("k").alias("truth")).join(greedy.select("image_id", "truth"), ["image_id", "truth"], "left_anti")
    needy = left_truths.select("image_id").distinct()
    left_anchors = anchors.select("image_id", "k").join(needy, "image_id", "left_semi").join(greedy.select("image_id", "k"), ["image_id", "k"], "left_anti")
    zipped = _number_in_image(left_anchors, ["k"], "r", crowded).join(_number_in_image(left_truths, ["truth"], "r", crowded), ["image_id", "r"])
    forced = greedy.unionByName(zipped.select("image_id", "k", "truth"))
    best = pairs.groupBy("image_id", F.col("ka").alias("k")).agg(F.min(F.struct((-F.col("iou")).alias("o"), F.col("kb").alias("truth"))).alias("b"))
    by_threshold = best.filter(-F.col("b.o") >= threshold).select("image_id", "k", F.col("b.truth").alias("truth"))
    rest = by_threshold.join(forced.select("image_id", "k"), ["image_id", "k"], "left_anti")
    return forced.unionByName(rest)


def anchor_targets(anchors: DataFrame, truths: DataFrame, **kw) -> DataFrame:
    """Per anchor: class (0 background, else truth class + 1), mask, and masked offsets."""
    assigned = assign_anchors(anchors, truths, **kw)
    t = truths.select("image_id", F.col("k").alias("truth"), F.col("class_index").alias("tc"), F.struct(*CORNERS).alias("t"))
    j = anchors.join(assigned, ["image_id", "k"], "left").join(t, ["image_id", "truth"], "left")
    have = F.col("t").isNotNull()
    offsets = encode_offsets({c: F.col(c) for c in CORNERS}, {c: F.col("t")[c] for c in CORNERS})
    names = ["dx", "dy", "dw", "dh"]
    return j.select(
        "image_id", "k", "truth", F.coalesce(F.col("tc") + 1, F.lit(0)).alias("target_class"), F.when(have, 1).otherwise(0).alias("mask"),
        *[F.when(have, o).otherwise(F.lit(0.0)).alias(n) for n, o in zip(names, offsets)],
    )


def suppress(boxes: DataFrame, threshold: float, fold_limit: int = FOLD_LIMIT, crowded: DataFrame | None = None) -> DataFrame:
    """Boxes kept by greedy suppression: by (score desc, k), dropped when IoU with a kept one exceeds the threshold."""
    crowded = crowded if crowded is not None else crowded_images(boxes, fold_limit)
    small = boxes if crowded is None else boxes.join(crowded, "image_id", "left_anti")
    item = F.struct((-F.col("score")).alias("neg"), F.col("k").cast("int").alias("k"), *CORNERS)
    lists = small.groupBy("image_id").agg(F.sort_array(F.collect_list(item)).alias("bs"))

    def step(kept: Column, b: Column) -> Column:
        hit = F.exists(kept, lambda q: iou(q, b) > threshold)
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(b)))

    folded = F.aggregate("bs", F.slice("bs", 1, 0), step)
    out = lists.select("image_id", F.explode(folded).alias("b")).select("image_id", "b.k")
    if crowded is None:
        return out
    return out.unionByName(_suppress_in_rounds(boxes.join(crowded, "image_id", "left_semi"), threshold))


def _tiled(boxes: DataFrame, threshold: float) -> DataFrame:
    """A row per box and tile that may own a box with an IoU above the threshold; ``own`` marks its own tile.

    A box's own tile holds its centre, on the grid of its size class (four times the largest side
    of the class). Such a pair overlaps on both axes by more than the threshold's share of the
    wider side, so its sides differ by less than 1 / threshold and its centres by ``reach`` sides.
    """
    span, reach = _size_span(threshold), 1.001 * (1 - threshold) * max(1.0, 1 / (2 * threshold))
    group = lambda v: F.floor((F.col("level") + v) / TILE_LEVELS).cast("int")
    rows = _levelled(boxes).withColumn("at", F.explode(F.sequence(group(-span), group(span))))
    edge = F.pow(F.lit(2.0), F.col("at") * TILE_LEVELS + TILE_LEVELS + 1)
    tile = lambda a, b, part: F.floor(((F.col(a) + F.col(b)) / 2 + (F.col(b) - F.col(a)) * part) / edge)
    tiles = lambda a, b: F.explode(F.sequence(tile(a, b, -reach), tile(a, b, reach)))
    rows = rows.withColumn("ty", tiles("y1", "y2")).withColumn("tx", tiles("x1", "x2"))
    own = (F.col("at") == group(0)) & (F.col("ty") == tile("y1", "y2", 0.0)) & (F.col("tx") == tile("x1", "x2", 0.0))
    return rows.select("image_id", "at", "ty", "tx", "k", "neg", *CORNERS, own.alias("own"))


def _overlaps(b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the boxes (columns x1, y1, x2, y2) have an IoU above the threshold, in the arithmetic of ``iou``."""
    x1, y1, x2, y2 = b.T
    width = np.maximum(np.minimum(x2[:, None], x2) - np.maximum(x1[:, None], x1), 0.0)
    shared = width * np.maximum(np.minimum(y2[:, None], y2) - np.maximum(y1[:, None], y1), 0.0)
    area = (x2 - x1) * (y2 - y1)
    return shared / (area[:, None] + area - shared) > threshold


def _judge(threshold: float):
    """Greedy rule over the best boxes of one tile as far as the tile decides it; gives its own boxes that are kept.

    A box under a kept one is dropped. One whose better overlapping boxes are all dropped is kept,
    if the tile is its own, as only there all of them are seen. Any other waits for the next round.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        over, own = _overlaps(rows[CORNERS].to_numpy(), threshold), rows["own"].to_numpy()
        kept, waits = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
        for i in range(len(rows)):
            better = over[i, :i]
            if not (better & kept[:i]).any():
                sure = own[i] and not (better & waits[:i]).any()
                kept[i], waits[i] = sure, not sure
        return rows.loc[kept, ["image_id", "k", *CORNERS]]

    return run


def _suppress_in_rounds(boxes: DataFrame, threshold: float) -> DataFrame:
    """Suppression for images of any size, in rounds of tiles.

    Every round judges the best open boxes of each tile (at most ``TILE_BOXES``, picked map-side), and
    the boxes under those kept leave by a join on a grid. So a group is bounded however crowded a
    place is, and a round is needed for a chain of overlaps that crosses a border, not for each
    box of a place. The best open box of an image is always decided, so the rounds end.
    """
    if threshold < LEAST_TILED:
        return _suppress_by_minima(boxes, threshold)
    ship_package(boxes.sparkSession)
    open_ = cut_lineage(boxes.select("image_id", F.col("k").cast("int").alias("k"), *[F.col(c).cast("double").alias(c) for c in CORNERS], (-F.col("score")).alias("neg")))
    flat = ~F.coalesce((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False))
    out, rounds = open_.filter(flat).select("image_id", "k"), 0  # a box without an area overlaps nothing
    open_ = open_.filter(~flat)
    tile = ["image_id", "at", "ty", "tx"]
    place = F.row_number().over(Window.partitionBy(*tile).orderBy("neg", "k"))
    columns = [c for c in open_.columns if c != "neg"]
    schema = open_.select(*columns).schema
    while not open_.isEmpty():
        best = _tiled(open_, threshold).withColumn("place", place).filter(F.col("place") <= TILE_BOXES)
        kept = cut_lineage(best.groupBy(*tile).applyInPandas(_judge(threshold), schema))
        out, rounds = out.unionByName(kept.select("image_id", "k")), rounds + 1
        if rounds % 8 == 0:
            out = cut_lineage(out)
        rest = open_.join(kept.select("image_id", "k"), ["image_id", "k"], "left_anti")
        under = overlap_pairs(rest, kept, least=threshold).select("image_id", F.col("ka").alias("k")).distinct()
        open_ = cut_lineage(rest.join(under, ["image_id", "k"], "left_anti"))
    return out


def _suppress_by_minima(boxes: DataFrame, threshold: float) -> DataFrame:
    """Suppression in rounds that keep the best box of its cells, for any threshold.

    Boxes that overlap meet in a cell of the larger one's size class. A box that ranks before
    all boxes in the cells of its own class, and before the boxes of the class in the cells of
    larger classes, has no better box over it, so it is kept. The best open box of an image
    is always kept, so the rounds end.
    """
    rank = F.struct((-F.col("score")).alias("neg"), F.col("k").cast("int").alias("k"))
    open_ = cut_lineage(boxes.select("image_id", F.col("k").cast("int").alias("k"), *CORNERS, rank.alias("r")))
    levelled = _levelled(open_)
    levels = levelled.select("level").agg(F.collect_set("level")).scalar()
    out, rounds = open_.select("image_id", "k").limit(0), 0
    cells = ["image_id", "at", "gy", "gx"]
    while not open_.isEmpty():
        covered = _gridded(_levelled(open_), levels).select(*cells, "k", "r", (F.col("level") == F.col("at")).alias("own"))
        best = covered.groupBy(*cells).agg(F.min("r").alias("best"), F.min(F.when(F.col("own"), F.col("r"))).alias("best_own"))
        better = F.when(F.col("own"), F.col("best")).otherwise(F.col("best_own")) < F.col("r")
        beaten = covered.join(best, cells).filter(better).select("image_id", "k").distinct()
        kept = cut_lineage(open_.join(beaten, ["image_id", "k"], "left_anti"))
        out, rounds = out.unionByName(kept.select("image_id", "k")), rounds + 1
        if rounds % 8 == 0:
            out = cut_lineage(out)
        rest = open_.join(kept.select("image_id", "k"), ["image_id", "k"], "left_anti")
        under = overlap_pairs(rest, kept).filter(F.col("iou") > threshold).select("image_id", F.col("ka").alias("k")).distinct()
        open_ = cut_lineage(rest.join(under, ["image_id", "k"], "left_anti"))
    return out


def decode_detections(
    anchors: DataFrame, class_scores: list[str], offsets: list[str], threshold: float = 0.5, min_confidence: float = MIN_CONFIDENCE, fold_limit: int = FOLD_LIMIT
) -> DataFrame:
    """Best foreground class, decoded box, suppression; dropped or faint boxes become class -1.

    ``class_scores`` are the foreground columns. ``position`` is the place in the output
    list: kept boxes by score, then the others by number.
    """
    best = F.greatest(*class_scores)
    index = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(class_scores))):
        index = F.when(F.col(c) == best, F.lit(i)).otherwise(index)
    box = decode_offsets({c: F.col(c) for c in CORNERS}, *[F.col(o) for o in offsets])
    decoded = anchors.select("image_id", F.col("k").cast("int").alias("k"), best.alias("score"), index.alias("best_class"), *box)
    crowded = crowded_images(decoded, fold_limit)
    kept = suppress(decoded, threshold, fold_limit, crowded).withColumn("kept", F.lit(True))
    j = decoded.join(kept, ["image_id", "k"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    ordered = j.withColumns({"_d": F.when(F.col("kept"), 0).otherwise(1), "_s": F.when(F.col("kept"), -F.col("score")).otherwise(F.lit(0.0))})
    placed = _number_in_image(ordered, ["_d", "_s", "k"], "position", crowded)
    faint = F.col("score") < min_confidence
    return placed.select(
        "image_id", "k", "position", "kept", F.when(F.col("kept") & ~faint, F.col("best_class")).otherwise(F.lit(-1)).alias("class_index"),
        F.when(faint, 1 - F.col("score")).otherwise(F.col("score")).alias("confidence"), *CORNERS,
    )


def non_kept(all_boxes: DataFrame, kept: DataFrame) -> DataFrame:
    """Numbers that occur once in the union of all and kept."""
    both = all_boxes.select("image_id", F.col("k").cast("int").alias("k")).unionByName(kept.select("image_id", "k"))
    return both.groupBy("image_id", "k").agg(F.count("*").alias("n")).filter("n = 1").select("image_id", "k")


def stack_levels(levels: list[DataFrame], sizes: list[Column], maps: DataFrame) -> DataFrame:
    """Concatenate per-level lists; a level starts where the earlier ones of its image end."""
    out, offset = None, F.lit(0).cast("bigint")
    for number, (level, size) in enumerate(zip(levels, sizes)):
        starts = maps.select("image_id", offset.alias("_offset"))
        part = level.join(starts, "image_id").withColumns({"level": F.lit(number), "position": F.col("_offset") + F.col("k")}).drop("_offset")
        out = part if out is None else out.unionByName(part)
        offset = offset + size
    return out


def average_precision(truths: DataFrame, detections: DataFrame, thresholds: list[float], fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Per class and IoU threshold: precision and recall over all detections and 101-point AP.

    In each image detections take, by score, the best free truth of their class. The curve
    is a global running sum by score; the 101 levels come from one aggregate per recall step.
    """
    keys = ["image_id", "class_index"]
    crowded = crowded_images(truths.select("image_id").unionByName(detections.select("image_id")), fold_limit)
    pairs = overlap_pairs(detections, truths, keys=keys).join(detections.select(*keys, F.col("k").alias("ka"), "score"), [*keys, "ka"])
    levels = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("iou") >= t)
    graded = pairs.withColumn("threshold", F.explode(levels))
    matched = greedy_match(graded, [*keys, "threshold"], [(-F.col("score")).alias("s"), F.col("ka").alias("o1"), (-F.col("iou")).alias("o2")], crowded)
    hits = matched.select(*keys, "threshold", F.col("ka").alias("k"), F.lit(1).alias("hit"))
    every = detections.select(*keys, F.col("k").cast("int").alias("k"), "score").withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    scored = every.join(hits, [*keys, "threshold", "k"], "left").withColumns({"hit": F.coalesce("hit", F.lit(0)).cast("bigint"), "neg": -F.col("score")})
    scored = cut_lineage(scored)  # read by the slice totals, the curve and the counts
    order = ["neg", "image_id", "k"]
    keys_only = detections.select((-F.col("score")).alias("neg"), "image_id", F.col("k").cast("int").alias("k"))
    curve = running_sums(scored, order, {"tp": F.col("hit"), "seen": F.lit(1).cast("bigint")}, ["class_index", "threshold"], sample_from=keys_only)
    counts = truths.groupBy("class_index").agg(F.count("*").alias("truths"))
    c = curve.join(counts, "class_index").withColumns({"recall": F.col("tp") / F.col("truths"), "precision": F.col("tp") / F.col("seen")})
    steps = c.groupBy("class_index", "threshold", F.floor(F.col("tp") * 100 / F.col("truths")).alias("step")).agg(F.max("precision").alias("best"))
    # recall levels 0, 0.01, ..., 1: the best precision at or beyond the level
    filled = steps.groupBy("class_index", "threshold").agg(F.map_from_entries(F.collect_list(F.struct("step", "best"))).alias("m"))
    grid = filled.select("class_index", "threshold", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("level"), "m")
    onward = Window.partitionBy("class_index", "threshold").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    env = grid.withColumn("best", F.max(F.try_element_at("m", F.col("level").cast("bigint"))).over(onward))
    ap = env.groupBy("class_index", "threshold").agg((F.sum(F.coalesce("best", F.lit(0.0))) / 101).alias("ap"))
    totals = scored.groupBy("class_index", "threshold").agg(F.sum("hit").alias("tp"), F.count("*").alias("detections"))
    return totals.join(ap, ["class_index", "threshold"]).join(counts, "class_index").select(
        "class_index", "threshold", "truths", "detections", "tp", (F.col("tp") / F.col("detections")).alias("precision"), (F.col("tp") / F.col("truths")).alias("recall"), "ap"
    )
