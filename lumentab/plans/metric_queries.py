"""Registered prediction, mask and box queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentab.functions import geometry as G
from lumentab.functions.numeric import r6, sigmoid
from lumentab.operators import boxes as B, metrics as E, predictions as P
from lumentab.operators.ranking import row_numbers
from lumentab.plans import views as V
from lumentab.plans.sqltext import R
from lumentab.plans.views import duck

Q = {}
CLASSES = 12  # two more than occur, so that absent classes show


def query(name, sql=None, **kw):
    def add(fn):
        Q[name] = (fn, duck(sql, **kw) if sql else None)
        return fn

    return add


@query("A14_overall_metrics", f"select count(*) images, count(*) filter (where correct) correct, count(*) filter (where not correct) incorrect, {R('avg(case when correct then 1e0 else 0 end)')} accuracy, {R('avg(-ln(greatest(b.p,1e-9)))')} loss from preds a join probs b on a.image_id=b.image_id and a.true_index=b.class_index")
def _(s, d):
    true = F.get(F.filter("s", lambda c: c["class_index"] == F.col("label")), F.lit(0))["p"]
    rows = V.class_probs(s, d).select((F.get(P.best_classes(F.col("s"), 1), F.lit(0)) == F.col("label")).alias("correct"), true.alias("p"))
    return E.overall(rows.filter("p is not null")).select("images", "correct", "incorrect", r6("accuracy").alias("accuracy"), r6("loss").alias("loss"))


REPORT = {
    "report": "select *, case when pr+rc=0 then 0 else 2*pr*rc/(pr+rc) end f1 from (select c class_index, t support, k correct, case when p=0 then 0e0 else k*1e0/p end pr, case when t=0 then 0e0 else k*1e0/t end rc from (select c, (select count(*) from preds where true_index=c) t, (select count(*) from preds where predicted_index=c) p, (select count(*) from preds where predicted_index=c and correct) k from (select cast(i as int) c from range(0,12) r(i)) z) q) w"
}
NAMES = ["precision", "recall", "f1_score"]


@query("A15_per_class_report", f"select class_index, {R('pr')} \"precision\", {R('rc')} recall, {R('f1')} f1_score, support, correct, support-correct incorrect from report", extra=REPORT)
def _(s, d):
    r = E.per_class_report(V.preds(s, d), E.class_dimension(s, CLASSES))
    return r.select("class_index", *[r6(c).alias(c) for c in NAMES], "support", "correct", "incorrect")


@query("A16_macro_f1", f"select {R('avg(f1)')} macro_f1, count(*) classes from report", extra=REPORT)
def _(s, d):
    return E.macro_f1(E.per_class_report(V.preds(s, d), E.class_dimension(s, CLASSES))).select(r6("macro_f1").alias("macro_f1"), "classes")


@query("K05_weakest_classes", f"select class_index, {R('f1')} f1_score, {R('rc')} recall, support from report order by f1, rc, class_index limit 10", extra=REPORT)
def _(s, d):
    r = E.per_class_report(V.preds(s, d), E.class_dimension(s, CLASSES))
    return r.orderBy("f1_score", "recall", "class_index").limit(10).select("class_index", r6("f1_score").alias("f1_score"), r6("recall").alias("recall"), "support")


@query("A17_confusion_matrix", f"select cast(a as int) true_index, cast(b as int) predicted_index, n, {R('case when sum(n) over (partition by a)=0 then 0 else n/sum(n) over (partition by a) end')} share from (select a, b, (select count(*) from preds where true_index=a and predicted_index=b) n from range(0,12) x(a), range(0,12) y(b)) q")
def _(s, d):
    m = E.confusion_matrix(V.preds(s, d), CLASSES)
    return m.select("true_index", "predicted_index", "n", r6("share").alias("share"))


@query("A18_confusion_pairs", "select true_index, predicted_index, count(*) n from preds where true_index<>predicted_index group by 1,2")
def _(s, d):
    return E.confusion_pairs(V.preds(s, d))


FLAGS = {"flags": "select image_id, expected_index, view_type, test_type, bool_or(k=1 and class_index=expected_index) top1, bool_or(class_index=expected_index) top3 from preds_topk group by 1,2,3,4"}


@query("A19_topk_accuracy", f"select view_type, expected_index, count(*) images, count(*) filter (where top1) top1_correct, {R('avg(case when top1 then 1e0 else 0 end)')} top1_accuracy, count(*) filter (where top3) top3_correct, {R('avg(case when top3 then 1e0 else 0 end)')} top3_accuracy from flags where test_type='positive' group by grouping sets ((view_type),(expected_index),())", extra=FLAGS)
def _(s, d):
    t = E.topk_accuracy(E.topk_flags(V.preds_topk(s, d).filter("test_type = 'positive'")))
    return t.select("view_type", "expected_index", "images", "top1_correct", r6("top1_accuracy").alias("top1_accuracy"), "top3_correct", r6("top3_accuracy").alias("top3_accuracy"))


@query("A20_negative_confidence", f"select count(*) images, count(*) filter (where p>=8e-1) high_confidence, {R('avg(p)')} mean_confidence, {R('max(p)')} max_confidence from preds_topk where k=1 and test_type='negative'")
def _(s, d):
    t = E.confidence_audit(V.preds_topk(s, d).filter("k = 1 and test_type = 'negative'"))
    return t.select("images", "high_confidence", r6("mean_confidence").alias("mean_confidence"), r6("max_confidence").alias("max_confidence"))


@query("A21_prediction_bias", "select predicted_index, count(*) n from preds group by 1")
def _(s, d):
    return E.prediction_bias(V.preds(s, d))


SCORES = {
    "parts": "select image_id, sum(t*p)::bigint both_, sum(p)::bigint pred_, sum(t)::bigint truth_, sum(greatest(t,p))::bigint either_, count(*) pixels from masks group by 1",
    "scores": "select image_id, (2*both_+1e-7)/(pred_+truth_+1e-7) dice, (both_+1e-7)/(either_+1e-7) iou, truth_*1e0/pixels fg from parts",
}


def scores(s, d):
    return E.mask_scores(E.mask_parts(V.masks(s, d)))


@query("A22_mask_scores", f"select image_id, {R('dice')} dice, {R('iou')} iou, {R('fg')} foreground_ratio from scores", extra=SCORES)
def _(s, d):
    return scores(s, d).select("image_id", *[r6(c).alias(c) for c in ("dice", "iou", "foreground_ratio")])


@query("A23_global_mask_scores", f"select {R('2*sum(both_)/(sum(pred_)+sum(truth_)+1e-7)')} global_dice, {R('sum(both_)/(sum(either_)+1e-7)')} global_iou, count(*) images from parts", extra=SCORES)
def _(s, d):
    return E.global_mask_scores(E.mask_parts(V.masks(s, d))).select(r6("global_dice").alias("global_dice"), r6("global_iou").alias("global_iou"), "images")


@query("A24_score_distribution", f"select {R('avg(dice)')} mean_dice, {R('min(dice)')} min_dice, {R('max(dice)')} max_dice, {R('avg(iou)')} mean_iou, {R('quantile_cont(dice,5e-1)')} median_dice, {R('quantile_cont(iou,5e-1)')} median_iou from scores", extra=SCORES)
def _(s, d):
    t = E.score_distribution(scores(s, d))
    return t.select(*[r6(c).alias(c) for c in t.columns])


@query("A25_mask_audit", "select case when fg=0 then 'all_background' when fg<45e-2 then 'near_background' when fg>55e-2 then 'near_foreground' else 'valid' end bucket, count(*) n from scores group by 1", extra=SCORES)
def _(s, d):
    return scores(s, d).groupBy(E.foreground_bucket(F.col("foreground_ratio"), 0.45, 0.55).alias("bucket")).agg(F.count("*").alias("n"))


@query("K03_case_picks", f"select unnest(list_filter([case when r<=3 then 'worst' end, case when r between n//2 and n//2+2 then 'median' end, case when r>n-3 then 'best' end], lambda x: x is not null)) case_name, image_id, {R('dice')} dice, {R('iou')} iou from (select *, row_number() over (order by dice, image_id) r, count(*) over () n from scores) q", extra=SCORES)
def _(s, d):
    return E.pick_cases(scores(s, d)).select("case_name", "image_id", r6("dice").alias("dice"), r6("iou").alias("iou"))


@query("K04_worst_valid", f"select image_id, {R('dice')} dice, {R('fg')} foreground_ratio from scores where fg between 1e-2 and 99e-2 order by dice, image_id limit 9", extra=SCORES)
def _(s, d):
    v = scores(s, d).filter(F.col("foreground_ratio").between(0.01, 0.99)).orderBy("dice", "image_id").limit(9)
    return v.select("image_id", r6("dice").alias("dice"), r6("foreground_ratio").alias("foreground_ratio"))


@query("A32_soft_losses", f"select image_id, {R('avg(-(t*ln(q)+(1-t)*ln(1-q)))')} bce, {R('1-(2*sum(q*t)+1e-7)/(sum(q)+sum(t)+1e-7)')} dice_loss from (select m.image_id, m.t, 1/(1+exp(-(v*4))) q from masks m join px x on m.image_id=x.image_id and m.y=x.y and m.x=x.x) z group by 1")
def _(s, d):
    return E.soft_losses(V.masks(s, d, "z"), sigmoid(F.col("z") * 4)).select("image_id", r6("bce").alias("bce"), r6("dice_loss").alias("dice_loss"))


@query("A37_generalisation_gap", f"select {R('avg(case when image_id%4<>0 then c end)')} internal, {R('avg(case when image_id%4=0 then c end)')} external_, {R('avg(case when image_id%4<>0 then c end)-avg(case when image_id%4=0 then c end)')} gap from (select image_id, case when correct then 1e0 else 0 end c from preds) q")
def _(s, d):
    c = F.col("correct").cast("double")
    inside = F.col("image_id") % 4 != 0
    m = V.preds(s, d).agg(F.avg(F.when(inside, c)).alias("i"), F.avg(F.when(~inside, c)).alias("e"))
    return m.select(r6("i").alias("internal"), r6("e").alias("external_"), r6(F.col("i") - F.col("e")).alias("gap"))


@query("K01_top_k", f"select image_id, cast(k as int) k, class_index, printf('class_%02d',class_index) class_name, {R('p')} p from preds_topk")
def _(s, d):
    t = P.top_k(V.probs(s, d), 3, 10)
    return t.select("image_id", "k", "class_index", F.format_string("class_%02d", "class_index").alias("class_name"), r6("p").alias("p"))


@query("K02_argmax", f"select image_id, predicted_index, {R('confidence')} confidence from preds")
def _(s, d):
    return P.argmax(V.probs(s, d)).select("image_id", "predicted_index", r6("confidence").alias("confidence"))


@query("K06_confident_errors", f"select image_id, true_index, predicted_index, {R('confidence')} confidence, row_number() over (order by confidence desc, image_id) place from preds where not correct")
def _(s, d):
    bad = V.preds(s, d).filter("not correct").withColumn("neg", -F.col("confidence"))
    return row_numbers(bad, ["neg", "image_id"], "place").select("image_id", "true_index", "predicted_index", r6("confidence").alias("confidence"), "place")


@query("L05_softmax_cross_entropy", f"select l.image_id, l.class_index, {R('exp(z-m)/t')} p, {R('case when label=l.class_index then -ln(exp(z-m)/t) else 0 end')} loss from logits l join (select image_id, max(z) m from logits group by 1) a on l.image_id=a.image_id join (select l.image_id, sum(exp(z-m)) t from logits l join (select image_id, max(z) m from logits group by 1) b on l.image_id=b.image_id group by 1) c on l.image_id=c.image_id join embeddings e on e.vec_id=l.image_id")
def _(s, d):
    j = V.class_scores(s, d).select("image_id", "label", F.explode(P.softmax(F.col("s"))).alias("c")).select("image_id", "label", "c.*")
    return j.select("image_id", "class_index", r6("p").alias("p"), r6(F.when(F.col("label") == F.col("class_index"), -F.log("p")).otherwise(0.0)).alias("loss"))


@query("L06_linear_scores", f"select image_id, class_index, {R('z')} z from logits")
def _(s, d):
    return V.logits(s, d).select("image_id", "class_index", r6("z").alias("z"))


@query("L11_class_means", f"select class_index, i, {R('w')} w from centroid")
def _(s, d):
    return V.centroid(s, d).select("class_index", "i", r6("w").alias("w"))


CROPS = {
    "crops": "select image_id, cast(c as int) crop, class_index, z*(1+c/10e0)+case when (class_index+c)%3=0 then 5e-1 else 0 end z from logits, range(0,5) r(c)",
    "ensemble": "select image_id, class_index, avg(p) p from (select image_id, crop, class_index, exp(z-m)/sum(exp(z-m)) over (partition by image_id, crop) p from (select *, max(z) over (partition by image_id, crop) m from crops) q) w group by 1,2",
    "single": "select image_id, class_index, exp(z-m)/sum(exp(z-m)) over (partition by image_id) p from (select *, max(z) over (partition by image_id) m from crops where crop=4) q",
}


def crop_scores(k):
    """Scores of crop k, made from the row's own scores."""
    bump = lambda c: F.when((c["class_index"] + k) % 3 == 0, 0.5).otherwise(0.0)
    return F.transform("s", lambda c: F.struct(c["class_index"].alias("class_index"), (c["z"] * (1 + k / 10.0) + bump(c)).alias("z")))


@query("L07_crop_ensemble", f"select image_id, class_index, {R('p')} p from ensemble", extra=CROPS)
def _(s, d):
    mean = V.class_scores(s, d).select("image_id", F.explode(P.crop_ensemble([crop_scores(k) for k in range(5)])).alias("c"))
    return mean.select("image_id", "c.class_index", r6("c.p").alias("p"))


@query("L08_baseline_vs_crops", """select count(*) images, count(*) filter (where a.c=label) baseline_top1, count(*) filter (where list_contains(a.t,label)) baseline_top3, count(*) filter (where b.c=label) crops_top1, count(*) filter (where list_contains(b.t,label)) crops_top3, count(*) filter (where a.c<>b.c) changed
 from (select image_id, first(class_index order by round(p,9) desc, class_index) c, list(class_index order by round(p,9) desc, class_index)[1:3] t from single group by 1) a join (select image_id, first(class_index order by round(p,9) desc, class_index) c, list(class_index order by round(p,9) desc, class_index)[1:3] t from ensemble group by 1) b using (image_id) join embeddings e on e.vec_id=image_id""", extra=CROPS)
def _(s, d):
    rows = V.class_scores(s, d).select(
        "label", P.best_classes(P.softmax(crop_scores(4)), 3).alias("baseline"), P.best_classes(P.crop_ensemble([crop_scores(k) for k in range(5)]), 3).alias("crops"),
    )
    n = lambda c: F.count(F.when(c, 1))
    first = lambda m: F.get(m, F.lit(0))
    aggs = [n(first(m) == F.col("label")).alias(f"{m}_top1") for m in ("baseline", "crops")]
    aggs += [n(F.array_contains(m, F.col("label"))).alias(f"{m}_top3") for m in ("baseline", "crops")]
    return rows.agg(F.count("*").alias("images"), *aggs, n(first("baseline") != first("crops")).alias("changed"))


@query("S09_wide_submission", "select image_id, " + ", ".join(f"max(case when class_index={c} then p end) class_{c}" for c in range(10)) + " from probs group by 1")
def _(s, d):
    return P.wide_submission(V.probs(s, d), list(range(10)))


@query("S10_string_ordered_submission", "select image_id, printf('class_%02d',predicted_index) label, row_number() over (order by cast(image_id as varchar)) position from preds")
def _(s, d):
    p = P.string_ordered(P.argmax(V.probs(s, d)), "image_id")
    return p.select("image_id", F.format_string("class_%02d", "predicted_index").alias("label"), "position")


# ---- boxes ------------------------------------------------------------------------------


def truth(s, d):
    return V.boxes(s, d).filter("kind = 'truth'")


def det(s, d):
    return V.boxes(s, d).filter("kind = 'det'")


IOU = "(greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0)/((a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1)-greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0)))"
DET = {
    "det": "select image_id, k, class_index, score, x1, y1, x2, y2 from boxes where kind='det'",
    "tru": "select image_id, k, class_index, score, x1, y1, x2, y2 from boxes where kind='truth'",
    "ious": f"select a.image_id, a.k ka, b.k kb, {IOU} iou from det a join tru b on a.image_id=b.image_id",
}


@query("J06_iou_pairs", f"select image_id, ka det_k, kb truth_k, {R('iou')} iou from ious where iou>0", extra=DET)
def _(s, d):
    p = B.overlap_pairs(det(s, d), truth(s, d))
    return p.select("image_id", F.col("ka").alias("det_k"), F.col("kb").alias("truth_k"), r6("iou").alias("iou"))


PIXEL_BOXES = {
    "pixel_boxes": "select b.image_id, b.k, b.kind, b.class_index, b.score, b.x1*g.w x1, b.y1*g.h y1, b.x2*g.w x2, b.y2*g.h y2 from boxes b join img_dims g on b.image_id=g.image_id",
    "pixel_ious": f"select a.image_id, a.k ka, b.k kb, {IOU} iou from pixel_boxes a join pixel_boxes b on a.image_id=b.image_id where a.kind='det' and b.kind='truth'",
}


def pixel_boxes(s, d):
    """Boxes in pixels of their image, a few hundred units wide."""
    b = V.boxes(s, d).join(V.img_dims(s, d).select("image_id", "w", "h"), "image_id")
    scaled = {c: F.col(c) * F.col("w" if c[0] == "x" else "h") for c in G.CORNERS}
    return b.withColumns(scaled).drop("w", "h")


@query("J06_pixel_boxes", f"select image_id, ka det_k, kb truth_k, {R('iou')} iou from pixel_ious where iou>0", extra=PIXEL_BOXES)
def _(s, d):
    b = pixel_boxes(s, d)
    p = B.overlap_pairs(b.filter("kind = 'det'"), b.filter("kind = 'truth'"))
    return p.select("image_id", F.col("ka").alias("det_k"), F.col("kb").alias("truth_k"), r6("iou").alias("iou"))


@query("B01_corner_centre", f"select image_id, k, {R('(x1+x2)/2')} cx, {R('(y1+y2)/2')} cy, {R('x2-x1')} bw, {R('y2-y1')} bh, {R('x1')} back_x1, {R('y2')} back_y2 from boxes")
def _(s, d):
    c = V.boxes(s, d).select("image_id", "k", *G.corner_to_centre(*[F.col(n) for n in G.CORNERS]))
    back = G.centre_to_corner(*[F.col(n) for n in ("cx", "cy", "bw", "bh")])
    return c.select("image_id", "k", *[r6(n).alias(n) for n in ("cx", "cy", "bw", "bh")], r6(back[0]).alias("back_x1"), r6(back[3]).alias("back_y2"))


@query("B02_centre_to_pixels", f"select b.image_id, k, {R('x1*w')} px_left, {R('y1*h')} px_top, {R('(x2-x1)*w')} px_w, {R('(y2-y1)*h')} px_h from (select image_id, k, x1, y1, x2, y2 from boxes) b join (select image_id, w, h from img_dims) g on b.image_id=g.image_id")
def _(s, d):
    c = V.boxes(s, d).select("image_id", "k", *G.corner_to_centre(*[F.col(n) for n in G.CORNERS])).join(V.img_dims(s, d).select("image_id", "w", "h"), "image_id")
    left, top = (F.col("cx") - F.col("bw") / 2) * F.col("w"), (F.col("cy") - F.col("bh") / 2) * F.col("h")
    return c.select("image_id", "k", r6(left).alias("px_left"), r6(top).alias("px_top"), r6(F.col("bw") * F.col("w")).alias("px_w"), r6(F.col("bh") * F.col("h")).alias("px_h"))


SIZES, RATIOS = [0.8, 0.4, 0.2], [1, 3, 0.4]
SHAPES = ", ".join(f"({i},{float(sz)!r}::double,{float(r)!r}::double)" for i, (sz, r) in enumerate([(0.8, 1), (0.4, 1), (0.2, 1), (0.8, 3), (0.8, 0.4)]))


def anchor_sql(div, level):
    return f"select image_id, {level} as level, (gy*fw+gx)*5+n k, (gx+5e-1)/fw-sz*sqrt(r)*fh/fw/2 x1, (gy+5e-1)/fh-sz/sqrt(r)/2 y1, (gx+5e-1)/fw+sz*sqrt(r)*fh/fw/2 x2, (gy+5e-1)/fh+sz/sqrt(r)/2 y2, fh*fw*5 size from (select image_id, greatest(1,h//{div}) fh, greatest(1,w//{div}) fw from img_dims) m, lateral (select unnest(range(0,fh)) gy) a, lateral (select unnest(range(0,fw)) gx) b, (values {SHAPES}) t(n,sz,r)"


def maps(s, d, div):
    part = lambda c: F.greatest(F.lit(1), F.expr(f"cast({c} div {div} as int)"))
    return V.img_dims(s, d).select("image_id", part("h").alias("fh"), part("w").alias("fw"))


def rounded_boxes(df, *keys):
    return df.select(*keys, *[r6(c).alias(c) for c in G.CORNERS])


@query("B03_anchor_grid", f"select image_id, cast(k as int) k, {R('x1')} x1, {R('y1')} y1, {R('x2')} x2, {R('y2')} y2 from ({anchor_sql(64, 0)}) q")
def _(s, d):
    return rounded_boxes(B.anchor_grid(maps(s, d, 64), SIZES, RATIOS), "image_id", "k")


@query("U03_stacked_levels", f"select image_id, level, cast(k as int) k, position, {R('x1')} x1, {R('y1')} y1, {R('x2')} x2, {R('y2')} y2 from (select a.*, k + case level when 0 then 0 when 1 then s0 else s0+s1 end position from (select * from l0 union all select * from l1 union all select * from l2) a join (select image_id, greatest(1,h//128)*greatest(1,w//128)*5 s0, greatest(1,h//256)*greatest(1,w//256)*5 s1 from img_dims) g using (image_id)) q",
       extra={"l0": anchor_sql(128, 0), "l1": anchor_sql(256, 1), "l2": anchor_sql(512, 2)})
def _(s, d):
    divs = (128, 256, 512)
    levels = [B.anchor_grid(maps(s, d, v), SIZES, RATIOS) for v in divs]
    dims = maps(s, d, 128).withColumnsRenamed({"fh": "h0", "fw": "w0"})
    second = maps(s, d, 256).withColumnsRenamed({"fh": "h1", "fw": "w1"})
    sizes = [F.col("h0") * F.col("w0") * 5, F.col("h1") * F.col("w1") * 5, F.lit(0)]
    return rounded_boxes(B.stack_levels(levels, sizes, dims.join(second, "image_id")), "image_id", "level", "k", "position")


ASSIGN = {
    **DET,
    "pick": """select image_id, 0 step, []::bigint[] used_a, []::bigint[] used_b from (select distinct image_id from tru) z
      union all select w.image_id, w.step+1, list_append(used_a, n.ka), list_append(used_b, n.kb) from pick w, lateral (select ka, kb from ious i where i.image_id=w.image_id and not list_contains(w.used_a, i.ka) and not list_contains(w.used_b, i.kb) order by iou desc, ka, kb limit 1) n where w.step<4""",
    "forced": "select image_id, unnest(used_a) k, unnest(used_b) truth from pick where step=4",
    "assigned": "select * from forced union all select image_id, ka, kb from (select *, row_number() over (partition by image_id, ka order by iou desc, kb) r from ious) q where r=1 and iou>=5e-1 and not exists (select 1 from forced f where f.image_id=q.image_id and f.k=q.ka)",
    "targets": "select d.image_id, d.k, a.truth, coalesce(t.class_index+1,0) target_class, case when t.k is null then 0 else 1 end mask, case when t.k is null then 0 else 10*((t.x1+t.x2)/2-(d.x1+d.x2)/2)/(d.x2-d.x1) end dx, case when t.k is null then 0 else 10*((t.y1+t.y2)/2-(d.y1+d.y2)/2)/(d.y2-d.y1) end dy, case when t.k is null then 0 else 5*ln(1e-6+(t.x2-t.x1)/(d.x2-d.x1)) end dw, case when t.k is null then 0 else 5*ln(1e-6+(t.y2-t.y1)/(d.y2-d.y1)) end dh from det d left join assigned a on a.image_id=d.image_id and a.k=d.k left join tru t on t.image_id=d.image_id and t.k=a.truth",
}
OFFS = ["dx", "dy", "dw", "dh"]


@query("B04_anchor_assignment", "select image_id, cast(k as int) k, cast(truth as int) truth from assigned", extra=ASSIGN, recursive=True)
def _(s, d):
    return B.assign_anchors(det(s, d), truth(s, d))


@query("B04_assignment_by_rounds", "select image_id, cast(k as int) k, cast(truth as int) truth from assigned", extra=ASSIGN, recursive=True)
def _(s, d):
    """As above, with every image taken for a crowded one: rounds of joins, no fold."""
    return B.assign_anchors(det(s, d), truth(s, d), fold_limit=1)


PIXEL_ASSIGN = {
    **PIXEL_BOXES,
    **{k: ASSIGN[k].replace("ious", "pixel_ious").replace("from tru)", "from pixel_boxes where kind='truth')") for k in ("pick", "forced", "assigned")},
}


@query("B04_pixel_boxes", "select image_id, cast(k as int) k, cast(truth as int) truth from assigned", extra=PIXEL_ASSIGN, recursive=True)
def _(s, d):
    b = pixel_boxes(s, d)
    return B.assign_anchors(b.filter("kind = 'det'"), b.filter("kind = 'truth'"))


@query("B05_encode_offsets", "select image_id, k, " + ", ".join(f"{R(c)} {c}" for c in OFFS) + " from targets where mask=1", extra=ASSIGN, recursive=True)
def _(s, d):
    t = B.anchor_targets(det(s, d), truth(s, d)).filter("mask = 1")
    return t.select("image_id", "k", *[r6(c).alias(c) for c in OFFS])


@query("B06_anchor_targets", "select image_id, k, cast(truth as int) truth, target_class, mask, " + ", ".join(f"{R(c)} {c}" for c in OFFS) + " from targets", extra=ASSIGN, recursive=True)
def _(s, d):
    t = B.anchor_targets(det(s, d), truth(s, d))
    return t.select("image_id", "k", "truth", "target_class", "mask", *[r6(c).alias(c) for c in OFFS])


@query("B10_detection_errors", f"select {R('1-avg(case when (k+image_id)%3=target_class then 1e0 else 0 end)')} class_error, {R('avg((abs(dx)+abs(dy)+abs(dw)+abs(dh))*mask)/4')} box_mae from targets", extra=ASSIGN, recursive=True)
def _(s, d):
    t = B.anchor_targets(det(s, d), truth(s, d))
    hit = ((F.col("k") + F.col("image_id")) % 3 == F.col("target_class")).cast("double")
    miss = sum((F.abs(c) for c in OFFS[1:]), F.abs(OFFS[0])) * F.col("mask")
    return t.agg(r6(1 - F.avg(hit)).alias("class_error"), r6(F.avg(miss) / 4).alias("box_mae"))


RAW = {
    **DET,
    "raw": "select image_id, cast(k as int) k, score p1, ((image_id*11+k*53)%1000)/1e3 p2, score-5e-1 o1, 5e-1-score o2, (x1+x2)/2 cx, (y1+y2)/2 cy, x2-x1 bw, y2-y1 bh from det",
    "dec": "select image_id, k, greatest(p1,p2) score, case when p1>=p2 then 0 else 1 end cls, o1*bw/10+cx-exp(2e-1/5)*bw*5e-1 x1, o2*bh/10+cy-exp(-2e-1/5)*bh*5e-1 y1, o1*bw/10+cx+exp(2e-1/5)*bw*5e-1 x2, o2*bh/10+cy+exp(-2e-1/5)*bh*5e-1 y2 from raw",
    "ord": "select *, row_number() over (partition by image_id order by score desc, k) r from dec",
    "overlapped": f"select a.image_id, a.r ra, b.r rb from ord a join ord b on a.image_id=b.image_id and a.r<b.r where {IOU}>5e-1",
    "sweep": """select image_id, 0::bigint r, []::bigint[] kept from (select distinct image_id from ord) z
      union all select w.image_id, w.r+1, case when exists (select 1 from overlapped o where o.image_id=w.image_id and o.rb=w.r+1 and list_contains(w.kept,o.ra)) then w.kept else list_append(w.kept,w.r+1) end from sweep w where w.r<12""",
    "keeps": "select image_id, unnest(kept) r from sweep where r=12",
}


def raw_detections(s, d):
    b = det(s, d)
    return b.withColumns({
        "p1": F.col("score"), "p2": (F.col("image_id") * 11 + F.col("k") * 53) % 1000 / F.lit(1000.0),
        "o1": F.col("score") - 0.5, "o2": F.lit(0.5) - F.col("score"), "o3": F.lit(0.2), "o4": F.lit(-0.2),
    }).drop("score")


def decoded(s, d):
    raw = raw_detections(s, d)
    box = G.decode_offsets({c: F.col(c) for c in G.CORNERS}, *[F.col(o) for o in ("o1", "o2", "o3", "o4")])
    return raw.select("image_id", "k", F.greatest("p1", "p2").alias("score"), *box)


@query("B07_decode_offsets", f"select image_id, k, {R('x1')} x1, {R('y1')} y1, {R('x2')} x2, {R('y2')} y2 from dec", extra=RAW)
def _(s, d):
    return rounded_boxes(decoded(s, d), "image_id", "k")


@query("B08_suppression", "select o.image_id, o.k from ord o join keeps using (image_id, r)", extra=RAW, recursive=True)
def _(s, d):
    return B.suppress(decoded(s, d), 0.5)


CROWD = {
    **{k: v for k, v in RAW.items() if k != "sweep" and k != "keeps" and k != "dec"},
    "solo": RAW["dec"],
    "dec": "select g.class_index::bigint image_id, cast(s.image_id*16+s.k as int) k, score, cls, x1+s.image_id%25*75e-2 x1, y1+s.image_id//25%20*75e-2 y1, x2+s.image_id%25*75e-2 x2, y2+s.image_id//25%20*75e-2 y2 from solo s join img_dims g on s.image_id=g.image_id",
    "sweep": """select image_id, 0::bigint r, []::bigint[] kept from (select distinct image_id from ord) z
      union all select w.image_id, w.r+1, case when exists (select 1 from overlapped o where o.image_id=w.image_id and o.rb=w.r+1 and list_contains(w.kept,o.ra)) then w.kept else list_append(w.kept,w.r+1) end from sweep w where w.r<(select max(r) from ord)""",
    "keeps": "select s.image_id, unnest(kept) r from sweep s join (select max(r) n from ord) m on s.r=m.n",
}


@query("B08_crowded_images", "select o.image_id, o.k from ord o join keeps using (image_id, r)", extra=CROWD, recursive=True)
def _(s, d):
    """All boxes of a class stand in one wide image: hundreds of boxes, beyond what a fold takes."""
    label = V.img_dims(s, d).select("image_id", F.col("class_index").cast("bigint").alias("c"))
    b = decoded(s, d).join(label, "image_id").withColumn("k", (F.col("image_id") * 16 + F.col("k")).cast("int"))
    move = {"x": F.col("image_id") % 25 * 0.75, "y": F.floor(F.col("image_id") / 25) % 20 * 0.75}
    b = b.withColumns({c: F.col(c) + move[c[0]] for c in G.CORNERS})
    return B.suppress(b.withColumn("image_id", F.col("c")).drop("c"), 0.5, fold_limit=64)


@query("B09_decoded_detections", f"select image_id, k, row_number() over (partition by image_id order by kept desc, case when kept then -score else 0 end, k) position, kept, case when kept and score>=0.009999999 then cls else -1 end class_index, {R('case when score<0.009999999 then 1-score else score end')} confidence, {R('x1')} x1, {R('y1')} y1, {R('x2')} x2, {R('y2')} y2 from (select o.*, s.r is not null kept from ord o left join keeps s using (image_id, r)) q", extra=RAW, recursive=True)
def _(s, d):
    t = B.decode_detections(raw_detections(s, d), ["p1", "p2"], ["o1", "o2", "o3", "o4"])
    return t.select("image_id", "k", "position", "kept", "class_index", r6("confidence").alias("confidence"), *[r6(c).alias(c) for c in G.CORNERS])


@query("U05_non_kept", "select o.image_id, o.k from ord o left join keeps s using (image_id, r) where s.r is null", extra=RAW, recursive=True)
def _(s, d):
    b = decoded(s, d)
    return B.non_kept(b, B.suppress(b, 0.5))


@query("B11_scaled_labels", f"select image_id, k, {R('trunc(x1*256)/256')} x1, {R('trunc(y1*256)/256')} y1, {R('trunc(x2*256)/256')} x2, {R('trunc(y2*256)/256')} y2 from boxes")
def _(s, d):
    edge = V.boxes(s, d).select("image_id", "k", *[(F.col(c) * 256).cast("int").alias(c) for c in G.CORNERS])
    return edge.select("image_id", "k", *[r6(F.col(c) / 256).alias(c) for c in G.CORNERS])


@query("A26_detected_images", "select g.class_index, count(distinct g.image_id) images, count(distinct b.image_id) detected, count(b.k) boxes_found from (select image_id, class_index from img_dims) g left join (select image_id, k from boxes where kind='det' and score>=9e-1) b on g.image_id=b.image_id group by 1")
def _(s, d):
    from lumentab.operators.batch import detected_per_group

    return detected_per_group(V.img_dims(s, d).select("image_id", "class_index"), det(s, d).filter("score >= 0.9"), "class_index")


def ap_views(thresholds: str) -> dict[str, str]:
    """Greedy matching and precision-recall curve for the listed IoU thresholds."""
    return {
        **DET,
        "levels": thresholds,
        "cand": "select i.image_id, th, i.ka, i.kb, i.iou, d.class_index, d.score from ious i join det d on d.image_id=i.image_id and d.k=i.ka join tru t on t.image_id=i.image_id and t.k=i.kb and t.class_index=d.class_index join levels on i.iou>=th",
        "matching": """select image_id, class_index, th, 0 step, []::bigint[] a, []::bigint[] b from (select distinct image_id, class_index, th from cand) z
      union all select w.image_id, w.class_index, w.th, w.step+1, list_append(w.a,n.ka), list_append(w.b,n.kb) from matching w, lateral (select ka, kb from cand c where c.image_id=w.image_id and c.class_index=w.class_index and c.th=w.th and not list_contains(w.a,c.ka) and not list_contains(w.b,c.kb) order by score desc, ka, iou desc limit 1) n""",
        "hits": "select distinct image_id, th, unnest(a) k from matching",
        "curve": "select d.class_index, l.th, d.image_id, d.k, case when h.k is null then 0 else 1 end hit, sum(case when h.k is null then 0 else 1 end) over w tp, count(*) over w seen from det d cross join levels l left join hits h on h.image_id=d.image_id and h.k=d.k and h.th=l.th window w as (partition by d.class_index, l.th order by d.score desc, d.image_id, d.k rows between unbounded preceding and current row)",
        "tcount": "select class_index, count(*) truths from tru group by 1",
        "stepbest": "select c.class_index, th, cast(floor(tp*100/truths) as bigint) lv, max(tp/seen) best from curve c join tcount t on c.class_index=t.class_index group by 1,2,3",
        "ap_rows": "select c.class_index, c.th, t.truths, count(*) detections, sum(hit)::bigint tp, (select sum(coalesce((select max(best) from stepbest q where q.class_index=c.class_index and q.th=c.th and q.lv>=l),0))/101 from range(0,101) r(l)) ap from curve c join tcount t on c.class_index=t.class_index group by 1,2,3",
    }


@query("A27_average_precision", f"select class_index, th as threshold, truths, detections, tp, {R('tp/detections')} \"precision\", {R('tp/truths')} recall, {R('ap')} ap from ap_rows", extra=ap_views("select 5e-1 th"), recursive=True)
def _(s, d):
    t = B.average_precision(truth(s, d), det(s, d), [0.5])
    return t.select("class_index", "threshold", "truths", "detections", "tp", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("ap").alias("ap"))


@query("A27_mean_average_precision", f"select {R('avg(case when th=5e-1 then ap end)')} map50, {R('avg(ap)')} map50_95 from ap_rows", extra=ap_views("select 5e-1+5e-2*i th from range(0,10) r(i)"), recursive=True)
def _(s, d):
    t = B.average_precision(truth(s, d), det(s, d), [0.5 + 0.05 * i for i in range(10)])
    return t.agg(r6(F.avg(F.when(F.col("threshold") == 0.5, F.col("ap")))).alias("map50"), r6(F.avg("ap")).alias("map50_95"))


@query("A27_precision_by_rounds", f"select class_index, th as threshold, truths, detections, tp, {R('ap')} ap from ap_rows", extra=ap_views("select 5e-1 th"), recursive=True)
def _(s, d):
    """As A27_average_precision, with every image taken for a crowded one: rounds of joins, no fold."""
    t = B.average_precision(truth(s, d), det(s, d), [0.5], fold_limit=1)
    return t.select("class_index", "threshold", "truths", "detections", "tp", r6("ap").alias("ap"))
