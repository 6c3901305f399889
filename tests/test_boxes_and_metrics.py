"""Worked box examples, crowded images against the plain rule, and metric edge cases."""

import random

import numpy as np
import pytest

from lumentab.operators import boxes as B, features as Fe, metrics as E, models as Mo, predictions as P

COLS = "image_id long, k int, class_index int, score double, x1 double, y1 double, x2 double, y2 double"


def table(spark, rows):
    return spark.createDataFrame(rows, COLS)


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    s = max(w, 0) * max(h, 0)
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return s / (area(a) + area(b) - s)


def test_worked_anchor_labels(spark):
    truths = table(spark, [(0, 0, 0, 1.0, 0.0, 0.0, 0.4, 0.4), (0, 1, 1, 1.0, 0.5, 0.5, 0.9, 0.9)])
    raw = [(0.05, 0.0, 0.45, 0.4), (0.5, 0.5, 0.9, 0.8), (0.6, 0.0, 0.8, 0.2), (0.52, 0.5, 0.92, 0.9)]
    anchors = table(spark, [(0, i, 0, 1.0, *b) for i, b in enumerate(raw)])
    got = {r["k"]: r for r in B.anchor_targets(anchors, truths).collect()}
    assert [got[i]["target_class"] for i in range(4)] == [1, 2, 0, 2]
    assert [got[i]["mask"] for i in range(4)] == [1, 1, 0, 1]
    assert np.allclose([got[0][c] for c in ("dx", "dy", "dw", "dh")], [-1.25, 0.0, 0.0, 0.0], atol=0.001)


def test_worked_suppression(spark):
    raw = [(0.0, 0.0, 0.4, 0.4), (0.02, 0.0, 0.42, 0.4), (0.6, 0.6, 0.9, 0.9), (0.61, 0.6, 0.91, 0.9)]
    first, second = [0.9, 0.7, 0.2, 0.1], [0.1, 0.2, 0.8, 0.6]
    df = table(spark, [(0, i, 0, 0.0, *b) for i, b in enumerate(raw)]).drop("score")
    scores = spark.createDataFrame([(i, first[i], second[i], 0.0) for i in range(4)], "k int, p1 double, p2 double, o double")
    out = B.decode_detections(df.join(scores, "k"), ["p1", "p2"], ["o"] * 4, 0.5).orderBy("position").collect()
    assert [(r["k"], r["class_index"], r["confidence"]) for r in out] == [(0, 0, 0.9), (2, 1, 0.8), (1, -1, 0.7), (3, -1, 0.6)]


def many(seed, images=6, per=40):
    rng = random.Random(seed)
    rows = []
    for i in range(images):
        for k in range(per):
            x, y, w, h = rng.random(), rng.random(), 0.02 + rng.random() * 0.5, 0.02 + rng.random() * 0.5
            rows.append((i, k, rng.randrange(2), round(rng.random(), 2), x, y, x + w, y + h))
    return rows


@pytest.mark.parametrize("limit", [2000, 1])
def test_suppression_by_fold_and_by_rounds(spark, limit):
    rows = many(1)
    want = set()
    for i in range(6):
        kept = []
        for r in sorted((r for r in rows if r[0] == i), key=lambda r: (-r[3], r[1])):
            if all(iou(q[4:], r[4:]) <= 0.3 for q in kept):
                kept.append(r)
        want |= {(i, r[1]) for r in kept}
    assert {tuple(r) for r in B.suppress(table(spark, rows), 0.3, fold_limit=limit).collect()} == want


@pytest.mark.parametrize("limit", [2000, 1])
def test_assignment_by_fold_and_by_rounds(spark, limit):
    anchors = many(2)
    truths = [r for r in many(3, per=9)] + [(1, 100, 0, 0.5, 50.0, 50.0, 51.0, 51.0), (1, 101, 0, 0.5, 60.0, 50.0, 61.0, 51.0)]
    want = {}
    for i in range(6):
        a, t = [r for r in anchors if r[0] == i], [r for r in truths if r[0] == i]
        j = np.array([[iou(x[4:], y[4:]) for y in t] for x in a])
        for n in range(len(a)):
            if j[n].max() >= 0.5:
                want[i, a[n][1]] = t[int(j[n].argmax())][1]
        for _ in t:
            n, m = divmod(int(j.argmax()), len(t))
            want[i, a[n][1]] = t[m][1]
            j[n, :] = -1
            j[:, m] = -1
    got = {(r["image_id"], r["k"]): r["truth"] for r in B.assign_anchors(table(spark, anchors), table(spark, truths), fold_limit=limit).collect()}
    assert got == want


def greedy(rows, threshold):
    kept, solid = [], lambda r: r[6] > r[4] and r[7] > r[5]
    for r in sorted(rows, key=lambda r: (r[0], -r[3], r[1])):
        if all(q[0] != r[0] or not (solid(q) and solid(r)) or iou(q[4:], r[4:]) <= threshold for q in kept):
            kept.append(r)
    return {(r[0], r[1]) for r in kept}


def crowd(seed, n=900, scale=1.0):
    """Boxes of very different sizes, copies of one, a row of boxes that hang together, and boxes without an area."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        side = 2.0 ** rng.integers(-6, 4)
        cx, cy, w, h = rng.normal(0, 2 * side), rng.normal(0, 2 * side), side * rng.uniform(0.5, 1), side * rng.uniform(0.5, 1)
        rows.append((k % 2, k, 0, float(rng.integers(0, 50)) / 50, cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2))
    rows += [(0, n + k, 0, 0.5, 1.0, 1.0, 2.0, 2.0) for k in range(60)]
    rows += [(1, n + 60 + k, 0, 2.0 - k / 100, 50 + k / 4, 50.0, 51 + k / 4, 51.0) for k in range(40)]
    rows += [(1, n + 100, 0, 3.0, 50.0, 50.0, 50.0, 51.0), (0, n + 101, 0, 0.0, 1.0, 2.0, 2.0, 1.0)]
    return [(*r[:4], *(float(c * scale) for c in r[4:])) for r in rows]


@pytest.mark.parametrize("threshold,tile,scale", [(0.5, 800, 1.0), (0.5, 7, 300.0), (0.3, 25, 1e-3), (0.7, 3, 1.0), (0.15, 40, 1.0), (0.05, 800, 1.0)])
def test_crowded_suppression_by_tiles(spark, monkeypatch, threshold, tile, scale):
    monkeypatch.setattr(B, "TILE_BOXES", tile)
    rows = crowd(21, 300, scale)
    assert {tuple(r) for r in B.suppress(table(spark, rows), threshold, fold_limit=1).collect()} == greedy(rows, threshold)


def test_rounds_do_not_follow_the_boxes_of_a_place(spark, monkeypatch):
    rows = [(0, *r[1:]) for r in crowd(22, 700)]
    cuts = []
    monkeypatch.setattr(B, "cut_lineage", lambda df, cut=B.cut_lineage: cuts.append(1) or cut(df))
    assert {tuple(r) for r in B.suppress(table(spark, rows), 0.5, fold_limit=1).collect()} == greedy(rows, 0.5)
    # two before the rounds and two per round; a box per place and round would take dozens
    assert len(cuts) <= 12


@pytest.mark.parametrize("limit", [2000, 1])
def test_average_precision(spark, limit):
    det, tru = many(4, per=25), many(5, per=12)
    rows = {r["class_index"]: r for r in B.average_precision(table(spark, tru), table(spark, det), [0.3], fold_limit=limit).collect()}
    for c in range(2):
        free = {(r[0], r[1]): r for r in tru if r[2] == c}
        total, tp, curve = len(free), 0, []
        hit = {}
        for i in range(6):
            for d in sorted((r for r in det if r[0] == i and r[2] == c), key=lambda r: (-r[3], r[1])):
                best = max(((iou(d[4:], t[4:]), -t[1], k) for k, t in free.items() if k[0] == i), default=None)
                if best and best[0] >= 0.3:
                    hit[d[0], d[1]] = 1
                    del free[best[2]]
        ordered = sorted((r for r in det if r[2] == c), key=lambda r: (-r[3], r[0], r[1]))
        for n, d in enumerate(ordered, 1):
            tp += hit.get((d[0], d[1]), 0)
            curve.append((tp, tp / n))
        ap = sum(max((p for t, p in curve if t * 100 // total >= lv), default=0) for lv in range(101)) / 101
        assert rows[c]["tp"] == tp and abs(rows[c]["ap"] - ap) < 1e-9


def test_overlap_pairs_report_each_pair_once(spark):
    rows = many(6, images=2)
    got = [(r["image_id"], r["ka"], r["kb"]) for r in B.overlap_pairs(table(spark, rows), table(spark, rows)).collect()]
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and iou(a[4:], b[4:]) > 0}
    assert len(got) == len(set(got)) and set(got) == want


def test_report_has_absent_classes_and_zero_division(spark):
    preds = spark.createDataFrame([(0, 0, 0, True), (1, 0, 2, False)], "image_id long, true_index int, predicted_index int, correct boolean")
    r = {x["class_index"]: x for x in E.per_class_report(preds, E.class_dimension(spark, 4)).collect()}
    assert r[3]["f1_score"] == 0 and r[3]["support"] == 0 and r[2]["precision"] == 0 and abs(r[0]["f1_score"] - 2 / 3) < 1e-12


def test_empty_masks_score_one(spark):
    m = spark.createDataFrame([(0, 0, 0), (0, 0, 0), (1, 0, 1), (1, 0, 0)], "image_id long, t int, p int")
    r = {x["image_id"]: x for x in E.mask_scores(E.mask_parts(m)).collect()}
    assert r[0]["dice"] == 1 and r[0]["iou"] == 1 and r[1]["dice"] < 1e-6


def test_empty_topk_gives_zero(spark):
    flags = spark.createDataFrame([], "view_type string, expected_index int, top1 boolean, top3 boolean")
    rows = E.topk_accuracy(flags).collect()
    assert all(r["top1_accuracy"] == 0 for r in rows)


def test_top_k_bounds(spark):
    probs = spark.createDataFrame([(0, 0, 0.2), (0, 1, 0.2), (0, 2, 0.6)], "image_id long, class_index int, p double")
    assert [r["class_index"] for r in P.top_k(probs, 2, 3).orderBy("k").collect()] == [2, 0]
    for k in (0, 4):
        with pytest.raises(ValueError):
            P.top_k(probs, k, 3)
    assert P.argmax(probs.filter("class_index < 2")).first()["predicted_index"] == 0


def test_joined_models_score_alike(spark):
    v = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0])], "id long, v array<double>")
    w = spark.createDataFrame([(c, i, float(c + i)) for c in range(3) for i in range(2)], "class_index int, i int, w double")
    assert sorted(P.linear_scores(v, w).collect()) == sorted(P.linear_scores(v, w, joined=True).collect())


def test_synthetic_line_is_recovered(spark):
    data = Fe.synthetic_linear(spark.range(5000), "id", [2.0, -3.4], 4.2, 0.01, 1)
    m = Mo.linear_fit(Mo.assemble(data, ["x0", "x1"]), "y")
    assert np.allclose([*m.coefficients, m.intercept], [2.0, -3.4, 4.2], atol=0.002)
    assert sorted(data.limit(50).collect()) == sorted(Fe.synthetic_linear(spark.range(5000).repartition(3), "id", [2.0, -3.4], 4.2, 0.01, 1).filter("id < 50").collect())


def test_feature_preparation_on_the_tiny_table(spark):
    t = spark.createDataFrame([(None, "gravel", 90500), (3.0, None, 99000), (5.0, None, 150250), (None, None, 120000)], "rooms double, alley string, price int")
    filled = Fe.one_hot(Fe.impute_means(t, ["rooms"]), ["alley"])
    assert [tuple(r) for r in filled.orderBy("price").collect()] == [(4.0, 90500, 1, 0), (3.0, 99000, 0, 1), (4.0, 120000, 0, 1), (5.0, 150250, 0, 1)]
    assert Fe.numeric_columns(t) == ["rooms", "price"] and Fe.text_columns(t) == ["alley"]
    z = [r["rooms"] for r in Fe.standardise(t, ["rooms"]).orderBy("price").collect()]
    assert np.allclose(z, [0, -1 / 2**0.5, 0, 1 / 2**0.5])


def test_level_count_is_checked(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, s string")
    with pytest.raises(ValueError):
        Fe.one_hot(t, ["s"], max_levels=2)
    assert [tuple(r) for r in Fe.one_hot_long(t, "id", ["s"]).orderBy("id").collect()] == [(1, "s", "a"), (2, "s", "b"), (3, "s", "c"), (4, "s", None)]


@pytest.mark.parametrize("scale", [1.0, 400.0, 1e-3])
def test_overlap_pairs_in_any_unit(spark, scale):
    rows = [(*r[:4], *(c * scale for c in r[4:])) for r in many(8, images=2)] + [(0, 900, 0, 1.0, 0.0, 0.0, 90 * scale, 90 * scale), (0, 901, 0, 1.0, 0.5 * scale, 0.5 * scale, 0.5 * scale, 0.9 * scale)]
    got = [(r["image_id"], r["ka"], r["kb"]) for r in B.overlap_pairs(table(spark, rows), table(spark, rows)).collect()]
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[6] > a[4] and b[6] > b[4] and iou(a[4:], b[4:]) > 0}
    assert len(got) == len(set(got)) and set(got) == want
