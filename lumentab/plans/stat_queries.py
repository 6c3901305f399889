"""Registered statistics, windows, stencils and matrix queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentab.functions.numeric import r6
from lumentab.operators.blocks import multiply_blocks
from lumentab.operators import linalg as M, pixels as P, stats as A, stencils as W
from lumentab.operators.ranking import running_sum
from lumentab.plans import views as V
from lumentab.plans.pixel_queries import HSV
from lumentab.plans.sqltext import R, SAT
from lumentab.plans.views import duck
from lumentab.session import cut_lineage

Q = {}


def query(name, sql=None, **kw):
    def add(fn):
        Q[name] = (fn, duck(sql, **kw) if sql else None)
        return fn

    return add


LONG = {"chan": "select image_id, y, x, 0 c, b v from bgr union all select image_id, y, x, 1, g from bgr union all select image_id, y, x, 2, r from bgr"}


def mirror_sql(e):
    return f"(case when abs({e})>7 then 14-abs({e}) else abs({e}) end)"


def stencil_sql(kernel, source="px8", centred=True):
    """Same-size filter with mirrored borders over the 8x8 rasters."""
    cy, cx = (len(kernel) // 2, len(kernel[0]) // 2) if centred else (0, 0)
    vals = ", ".join(f"({dy - cy},{dx - cx},{float(k)!r}::double)" for dy, row in enumerate(kernel) for dx, k in enumerate(row) if k)
    return f"select p.image_id, p.y, p.x, sum(s.v*kv) v from {source} p cross join (values {vals}) k(dy,dx,kv) join {source} s on s.image_id=p.image_id and s.y={mirror_sql('(p.y+dy)')} and s.x={mirror_sql('(p.x+dx)')} group by 1,2,3"


PX_STATS = {
    "lap": stencil_sql(W.LAPLACIAN),
    "px_stats": "select p.image_id, avg(p.v) brightness, stddev_pop(p.v) contrast, var_pop(l.v) blur from px8 p join lap l on p.image_id=l.image_id and p.y=l.y and p.x=l.x group by 1",
    "px_stats6": f"select p.image_id, {R('brightness')} brightness, {R('contrast')} contrast, {R('blur')} blur, w, h, class_index from px_stats p join img_dims d on p.image_id=d.image_id",
}


def px_stats6(s, d):
    """Quality features rounded to six places, with sizes and classes."""
    q = A.quality_features(W.tiles_from_rasters(V.byte_rasters(s, d)))
    q = q.select("image_id", *[r6(c).alias(c) for c in ("brightness", "contrast", "blur")])
    return q.join(V.img_dims(s, d).select("image_id", "w", "h", "class_index"), "image_id")


def tiles(s, d):
    return W.tiles_from_rasters(V.rasters(s, d))


def byte_tiles(s, d):
    return W.tiles_from_rasters(V.byte_rasters(s, d))


@query("A01_channel_stats", f"select image_id, c, max(v) max_v, min(v) min_v, {R('avg(v)')} mean_v, {R('stddev_pop(v)')} std_v from chan group by 1,2", extra=LONG)
def _(s, d):
    return A.channel_stats(P.split_channels(V.bgr(s, d))).select("image_id", "c", "max_v", "min_v", r6("mean_v").alias("mean_v"), r6("std_v").alias("std_v"))


@query("A02_quality_features", "select image_id, brightness, contrast, blur from px_stats6", extra=PX_STATS)
def _(s, d):
    return px_stats6(s, d).select("image_id", "brightness", "contrast", "blur")


@query("A03_inventory_summary", "select 'class' kind, cast(class_index as varchar) \"key\", count(*) n from img_dims group by 1,2 union all select 'size', concat_ws('x',w,h), count(*) from img_dims group by 1,2 union all select 'channels', cast(channels as varchar), count(*) from img_dims group by 1,2 union all select 'all', '', count(*) from img_dims")
def _(s, d):
    return A.inventory_summary(V.img_dims(s, d))


@query("A04_histogram_256", "select i.image_id, cast(b as int) bin, count(p.v) n from (select vec_id image_id from embeddings) i cross join range(0,256) r(b) left join px8 p on p.image_id=i.image_id and p.v=b group by 1,2")
def _(s, d):
    return A.histogram(V.px8(s, d), ["image_id"], "v", 256, 0, 256)


@query("A05_histogram_2d", "select cast(ra as int) a_bin, cast(rb as int) b_bin, count(v) n from range(0,48) ta(ra) cross join range(0,48) tb(rb) left join hsv on cast(floor(h*48/180e0) as int)=ra and cast(floor(s*48/256e0) as int)=rb group by 1,2", extra=HSV)
def _(s, d):
    return A.histogram_2d(P.to_hsv(V.bgr(s, d)), ("h", 48, 180.0), ("s", 48, 256.0))


THRESH_SQL = f"select {R('quantile_cont(brightness,1e-2)')} brightness_low, {R('quantile_cont(brightness,99e-2)')} brightness_high, {R('quantile_cont(contrast,1e-2)')} contrast_low, {R('quantile_cont(blur,1e-2)')} blur_low from px_stats6"


@query("A06_percentile_thresholds", THRESH_SQL, extra=PX_STATS)
def _(s, d):
    t = A.quality_thresholds(cut_lineage(px_stats6(s, d)))
    return t.select(*[r6(c).alias(c) for c in t.columns])


OUTLIERS = {
    **PX_STATS,
    "thr": "select quantile_cont(brightness,1e-2) bl, quantile_cont(brightness,99e-2) bh, quantile_cont(contrast,1e-2) cl, quantile_cont(blur,1e-2) ul from px_stats6",
    "outliers": "select * from (select p.*, concat_ws('|', case when brightness<=bl then 'very_dark' end, case when brightness>=bh then 'very_bright' end, case when contrast<=cl then 'low_contrast' end, case when blur<=ul then 'low_laplacian_variance' end, case when not ((w=303 and h=412) or (w=252 and h=296) or w<330) then 'uncommon_size' end) reasons from px_stats6 p, thr) q where reasons<>''",
}
COMMON = [(303, 412), (252, 296)]


def outliers(s, d):
    st = cut_lineage(px_stats6(s, d))
    # every width below 330 counts as common here; the rule itself takes a list of sizes
    wide = st.withColumn("h", F.when(F.col("w") < 330, 412).otherwise(F.col("h"))).withColumn("w", F.when(F.col("w") < 330, 303).otherwise(F.col("w")))
    found = A.outlier_reasons(wide, A.quality_thresholds(st), COMMON)
    return found.select("image_id", "class_index", "brightness", "contrast", "blur", "reasons")


@query("F07_outlier_reasons", "select image_id, class_index, brightness, contrast, blur, reasons from outliers", extra=OUTLIERS)
def _(s, d):
    return outliers(s, d)


@query("A35_reason_counts", "select reason, count(*) n from (select unnest(string_split(reasons,'|')) reason from outliers) q group by 1 union all select 'class_min', min(n) from (select count(*) n from img_dims group by class_index) z union all select 'class_max', max(n) from (select count(*) n from img_dims group by class_index) z", extra=OUTLIERS)
def _(s, d):
    classes = V.img_dims(s, d).groupBy("class_index").agg(F.count("*").alias("n")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    balance = classes.select(F.expr("stack(2, 'class_min', lo, 'class_max', hi) as (reason, n)"))
    return A.reason_counts(outliers(s, d)).unionByName(balance)


@query("A38_equal_width_histograms", """select measure, bin, count(v) n from (select * from (select unnest(['brightness','contrast','log_blur']) measure) m, (select cast(b as int) bin from range(0,40) r(b)) b) g left join
 (select measure m2, v, least(39,cast(floor((v-lo)/(hi-lo)*40) as int)) vb from (select *, min(v) over (partition by measure) lo, max(v) over (partition by measure) hi from (select 'brightness' measure, brightness v from px_stats6 union all select 'contrast', contrast from px_stats6 union all select 'log_blur', ln(1+blur) from px_stats6) a) b2) v on measure=m2 and bin=vb group by 1,2""", extra=PX_STATS)
def _(s, d):
    st = px_stats6(s, d)
    return A.equal_width_histogram(st, {"brightness": F.col("brightness"), "contrast": F.col("contrast"), "log_blur": F.log(F.col("blur") + 1)}, 40)


@query("A29_reductions", f"select i, j, {R('sum(v)')} sum_v, {R('avg(v)')} mean_v, count(*) n from mat group by grouping sets ((i),(j),())")
def _(s, d):
    return A.reductions(V.mat(s, d)).select("i", "j", r6("sum_v").alias("sum_v"), r6("mean_v").alias("mean_v"), "n")


@query("A29_keepdims", f"select m.i, m.j, {R('m.v/q.t')} share, {R('q.t')} row_sum from mat m join (select i, sum(abs(v)) t from mat group by i) q on m.i=q.i")
def _(s, d):
    m = A.with_group_value(V.mat(s, d), ["i"], t=F.sum(F.abs("v")))
    return m.select("i", "j", r6(F.col("v") / F.col("t")).alias("share"), r6("t").alias("row_sum"))


@query("A30_norms", f"select i, {R('sqrt(sum(v*v))')} l2, {R('sum(abs(v))')} l1, {R('sum(v*v)/2')} l2_penalty from mat group by grouping sets ((i),())")
def _(s, d):
    n = A.norms(V.mat(s, d))
    return n.select("i", *[r6(c).alias(c) for c in ("l2", "l1", "l2_penalty")])


@query("A31_losses", f"""select {R('avg(e*e/2)')} half_squared, {R('avg(e*e)')} mse, {R('sqrt(avg(g*g))')} log_rmse, {R('avg(case when abs(e)<25e-2 then (2*e)*(2*e)/2 else abs(e)-125e-3 end)')} smooth_l1, {R('avg(abs(e))')} l1, {R('avg(-pow(1-x,2)*ln(x))')} focal
 from (select p-price e, ln(greatest(p,1))-ln(price) g, price/(price+1000) x from (select price, 900+coalesce(size,0)*10 p from house) a) b""")
def _(s, d):
    h = V.house(s, d).withColumn("p", F.coalesce("size", F.lit(0.0)) * 10 + 900)
    losses = A.regression_losses(h, F.col("p"), F.col("price"), 2.0)
    foc = h.agg(F.avg(A.focal(F.col("price") / (F.col("price") + 1000), 2)))
    return losses.withColumn("focal", foc.scalar()).select(*[r6(c).alias(c) for c in ("half_squared", "mse", "log_rmse", "smooth_l1", "l1", "focal")])


@query("A33_accumulator", f"select count(*) n, {R('sum(value)')} total, sum(case when event_type='click' then 1 else 0 end)::bigint hits, {R('sum(value)/count(*)')} mean_value, {R('avg(case when event_type=chr(99)||chr(108)||chr(105)||chr(99)||chr(107) then 1.0 else 0.0 end)')} hit_rate from events")
def _(s, d):
    e = V.table(s, d, "events")
    hit = F.col("event_type") == "click"
    n = F.count("*")
    return e.agg(n.alias("n"), r6(F.sum("value")).alias("total"), F.sum(hit.cast("bigint")).alias("hits"), r6(F.sum("value") / n).alias("mean_value"), r6(F.sum(hit.cast("bigint")) / n).alias("hit_rate"))


@query("A34_best_epoch", """select (select epoch from seen order by metric desc, epoch limit 1) best_epoch, (select max(metric) from seen) best_metric, (select max(epoch) from seen where step=stop_step) stop_epoch, (select count(*) from seen) epochs_run""",
       extra={"steps": "select *, row_number() over (order by epoch) step, max(metric) over (order by epoch rows between unbounded preceding and 1 preceding) prior from history",
              "waits": "select *, step-max(case when prior is null or metric>prior then step end) over (order by epoch rows between unbounded preceding and current row) waited from steps",
              "seen": "select * from (select *, (select min(step) from waits where waited>=5) stop_step from waits) q where stop_step is null or step<=stop_step"})
def _(s, d):
    return A.best_epoch(V.history(s, d), 5)


BATCH = {"bstat": "select i//64 batch, j, avg(v) mean_v, var_pop(v) var_v from mat group by 1,2"}


@query("A36_batch_norm", f"select m.i, m.j, {R('(m.v-b.mean_v)/sqrt(b.var_v+1e-5)')} v from mat m join bstat b on m.i//64=b.batch and m.j=b.j", extra=BATCH)
def _(s, d):
    m = V.mat(s, d).withColumn("batch", F.expr("i div 64"))
    b = A.batch_statistics(m, F.col("batch"))
    return m.join(b, ["batch", "j"]).select("i", "j", r6((F.col("v") - F.col("mean_v")) / F.sqrt(F.col("var_v") + 1e-5)).alias("v"))


@query("A36_moving_stats", f"select j, {R('sum(pow(9e-1,l-batch)*1e-1*mean_v)')} moving_mean, {R('sum(pow(9e-1,l-batch)*1e-1*var_v)')} moving_var from bstat, (select max(batch) l from bstat) q group by j", extra=BATCH)
def _(s, d):
    b = A.batch_statistics(V.mat(s, d), F.expr("i div 64"))
    return A.moving_statistics(b, 0.9).select("j", r6("moving_mean").alias("moving_mean"), r6("moving_var").alias("moving_var"))


@query("W01_cumulative_sum", f"select i, j, {R('sum(v) over (partition by j order by i)')} v from mat")
def _(s, d):
    return running_sum(V.mat(s, d), ["i"], F.col("v"), "c", ["j"]).select("i", "j", r6("c").alias("v"))


@query("W02_equalise", f"select p.image_id, p.y, p.x, {SAT('(l.cdf-l.cmin)*255e0/nullif(64-l.cmin,0)')} v from px8 p join (select *, first_value(cdf) over (partition by image_id order by v) cmin from (select image_id, v, sum(n) over (partition by image_id order by v)::bigint cdf from (select image_id, v, count(*) n from px8 group by 1,2) a) b) l on p.image_id=l.image_id and p.v=l.v")
def _(s, d):
    return P_equalise(V.px8(s, d))


def P_equalise(px):
    from lumentab.operators.windows import equalise

    return equalise(px)


@query("W03_min_max", f"select image_id, y, x, {R('(v-min(v) over (partition by image_id))/(max(v) over (partition by image_id)-min(v) over (partition by image_id))')} v from px")
def _(s, d):
    from lumentab.operators.windows import min_max

    return min_max(V.px(s, d)).select("image_id", "y", "x", r6("v").alias("v"))


@query("W04_row_normalise", f"select i, j, {R('v/sum(v) over (partition by i)')} v from (select i, j, abs(v)+1e-2 v from mat) q")
def _(s, d):
    m = V.mat(s, d).withColumn("v", F.abs("v") + 0.01)
    return A.with_group_value(m, ["i"], t=F.sum("v")).select("i", "j", r6(F.col("v") / F.col("t")).alias("v"))


KERNEL = [[0.0, 1.0, 0.5], [2.0, 3.0, -1.0], [0.25, 0.0, 1.5]]
WIDE = [[0.5, 1, 0, -1, 2], [1, 0.25, 3, 0, 1], [0, 2, -1, 1, 0.5]]


def taps_sql(kernel):
    return ", ".join(f"({dy},{dx},{float(k)!r}::double)" for dy, row in enumerate(kernel) for dx, k in enumerate(row))


@query("W05_correlate", f"select p.image_id, p.y-dy y, p.x-dx x, {R('sum(p.v*kv)')} v from px p, (values {taps_sql(KERNEL)}) k(dy,dx,kv) group by 1,2,3 having count(*)=9")
def _(s, d):
    return W.correlate(tiles(s, d), [[KERNEL]]).select("image_id", "y", "x", r6("v").alias("v"))


@query("W06_correlate_pad_stride", f"select image_id, ty//3 y, tx//4 x, {R('sum(v*kv)')} v from (select image_id, p.y-dy ty, p.x+1-dx tx, v, kv from px p, (values {taps_sql(WIDE)}) k(dy,dx,kv)) q where ty>=0 and tx>=0 and ty%3=0 and tx%4=0 and ty<=5 and tx<=5 group by 1,2,3")
def _(s, d):
    return W.correlate(tiles(s, d), [[WIDE]], pad=(0, 1), stride=(3, 4)).select("image_id", "y", "x", r6("v").alias("v"))


BANK = [[[[0.25, -1.5], [0.75, 0.5]], [[-0.125, 0.375], [1.25, -0.5]], [[0.5, 0.0], [0.0, 0.5]]],
        [[[-2.0, 0.5], [1.75, -0.25]], [[0.625, 1.5], [-1.0, 0.875]], [[1.0, -1.0], [-1.0, 1.0]]]]


def bank_sql(bank):
    return ", ".join(f"({o},{c},{dy},{dx},{float(v)!r}::double)" for o, b in enumerate(bank) for c, k in enumerate(b) for dy, row in enumerate(k) for dx, v in enumerate(row))


def colour_tiles(s, d):
    """4x4 three-plane rasters from the interleaved cells."""
    plane = lambda c: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.get("cells", p * 4 + c))
    planes = F.array(*[plane(c) for c in range(3)])
    r = V.byte_rasters(s, d).withColumns({"h": F.lit(4), "w": F.lit(4)})
    return W.tiles_from_rasters(r, planes)


@query("W07_multi_channel", f"select image_id, o c, y-dy y, x-dx x, {R('sum(v*kv)')} v from chan join (values {bank_sql(BANK)}) k(o,ci,dy,dx,kv) on c=ci group by 1,2,3,4 having count(*)=12", extra=LONG)
def _(s, d):
    return W.correlate(colour_tiles(s, d), BANK).select("image_id", "c", "y", "x", r6("v").alias("v"))


POINT = [[[[0.5]], [[0.25]], [[0.25]]], [[[-1.0]], [[0.0]], [[1.0]]]]


@query("W07_one_by_one", f"select image_id, o c, y, x, {R('sum(v*kv)')} v from chan join (values {bank_sql(POINT)}) k(o,ci,dy,dx,kv) on c=ci group by 1,2,3,4", extra=LONG)
def _(s, d):
    return W.correlate(colour_tiles(s, d), POINT).select("image_id", "c", "y", "x", r6("v").alias("v"))


@query("W08_transposed", f"select image_id, y*2+dy y, x*2+dx x, {R('sum(v*kv)')} v from px, (values {taps_sql(KERNEL)}) k(dy,dx,kv) group by 1,2,3")
def _(s, d):
    return W.transpose_correlate(tiles(s, d), KERNEL, stride=2).select("image_id", "y", "x", r6("v").alias("v"))


@query("W09_pooling", f"select 'max' kind, image_id, cast(a as int) y, cast(b as int) x, {R('max(v)')} v from px join range(0,4) r(a) on y between a*2-1 and a*2+1 join range(0,4) q(b) on x between b*2-1 and b*2+1 group by 1,2,3,4 union all select 'avg', image_id, y//2, x//2, {R('avg(v)')} from px group by 1,2,3,4")
def _(s, d):
    big = W.pool(tiles(s, d), (3, 3), "max", stride=(2, 2), pad=(1, 1)).withColumn("kind", F.lit("max"))
    avg = W.pool(tiles(s, d), (2, 2), "avg").withColumn("kind", F.lit("avg"))
    return big.unionByName(avg).select("kind", "image_id", "y", "x", r6("v").alias("v"))


BOX = [[1 / 25] * 5 for _ in range(5)]
G7 = W.gaussian_weights(7, 1.5)
GAUSS = [[a * b for b in G7] for a in G7]


@query("W10_box_blur", f"select image_id, y, x, {SAT('v')} v from ({stencil_sql(BOX)}) q")
def _(s, d):
    return W.box_blur(byte_tiles(s, d), 5)


@query("W11_gaussian_blur", f"select image_id, y, x, {SAT('v')} v from ({stencil_sql(GAUSS)}) q")
def _(s, d):
    return W.gaussian_blur(byte_tiles(s, d), 7, 1.5)


@query("W12_bilateral", f"""select image_id, y, x, {R('sum(wt*sv)/sum(wt)')} v from (select p.image_id, p.y, p.x, s.v sv, exp(-(dy*dy+dx*dx)/8e0)*exp(-(s.v-p.v)*(s.v-p.v)/2e-2) wt from px p cross join range(-2,3) a(dy) cross join range(-2,3) b(dx) join px s on s.image_id=p.image_id and s.y={mirror_sql('(p.y+dy)')} and s.x={mirror_sql('(p.x+dx)')} where dy*dy+dx*dx<=4) q group by 1,2,3""")
def _(s, d):
    return W.bilateral(tiles(s, d), 2, 0.1, 2.0).select("image_id", "y", "x", r6("v").alias("v"))


@query("W13_laplacian", f"select image_id, y, x, {R('v')} v from lap", extra=PX_STATS)
def _(s, d):
    return W.filter_mirror(byte_tiles(s, d), W.LAPLACIAN).select("image_id", "y", "x", r6("v").alias("v"))


UP = W.bilinear_kernel(4)


@query("W15_bilinear_upsample", f"select image_id, y*2+dy-1 y, x*2+dx-1 x, {R('sum(v*kv)')} v from px, (values {taps_sql(UP)}) k(dy,dx,kv) where y*2+dy-1 between 0 and 15 and x*2+dx-1 between 0 and 15 group by 1,2,3")
def _(s, d):
    return W.transpose_correlate(tiles(s, d), UP, stride=2, pad=1).select("image_id", "y", "x", r6("v").alias("v"))


@query("M01_matrix_product", f"select a.i, b.j, {R('sum(a.v*b.v)')} v from mat a join mat_b b on a.j=b.i group by 1,2")
def _(s, d):
    return M.multiply(V.mat(s, d), V.mat_b(s, d)).select("i", "j", r6("v").alias("v"))


@query("M01_block_product", f"select a.j i, b.j, {R('sum(a.v*b.v)')} v from mat a join mat b on a.i=b.i group by 1,2")
def _(s, d):
    m = V.mat(s, d)
    return multiply_blocks(M.transpose(m), m, 32).select("i", "j", r6("v").alias("v"))


@query("M02_matrix_vector", f"select a.i, {R('sum(a.v*b.v)')} v from mat a join (select i, sum(v) v from mat_b group by 1) b on a.j=b.i group by 1")
def _(s, d):
    vector = V.mat_b(s, d).groupBy("i").agg(F.sum("v").alias("v"))
    return M.multiply_vector(V.mat(s, d), vector).select("i", r6("v").alias("v"))


GRAM = {"gram": "select a.j i, b.j, round(sum(a.v*b.v),6) v from mat a join mat b on a.i=b.i group by 1,2"}


@query("M03_transpose", f"select j i, i j, {R('v')} v from mat")
def _(s, d):
    return M.transpose(V.mat(s, d)).select("i", "j", r6("v").alias("v"))


@query("M03_symmetry_check", "select (select count(*) from mat_b a full join (select j i, i j, v from mat_b) b on a.i=b.i and a.j=b.j where a.v is distinct from b.v) mean_cells, 0::bigint gram_cells")
def _(s, d):
    b = V.mat_b(s, d).select(F.col("i").cast("bigint").alias("i"), "j", "v")
    gram = M.multiply(M.transpose(V.mat_b(s, d)), V.mat_b(s, d)).select("i", "j", F.round("v", 6).alias("v"))
    one = M.asymmetric_cells(b).agg(F.count("*").alias("mean_cells"))
    two = M.asymmetric_cells(gram).agg(F.count("*").alias("gram_cells"))
    return one.withColumn("gram_cells", two.scalar())


@query("M04_reshape", f"select (i*64+j)//48 i, cast((i*64+j)%48 as int) j, {R('v')} v from mat")
def _(s, d):
    return M.reshape(V.mat(s, d), 64, 48).select("i", "j", r6("v").alias("v"))


@query("M05_hadamard", f"select a.i, a.j, {R('a.v*b.v')} product, {R('a.v*2+3')} scaled from mat a join (select 63-j j, i, v from mat) b on a.i=b.i and a.j=b.j")
def _(s, d):
    rows = V.rasters(s, d).select(F.col("image_id").alias("i"), F.col("cells").alias("a"), F.reverse("cells").alias("b"))
    cells = M.hadamard(rows, "i", "a", "b").withColumnRenamed("v", "product")
    return cells.select("i", "j", r6("product").alias("product"), r6(F.col("a") * 2 + 3).alias("scaled"))


@query("M06_centre", f"select i, j, {R('v-(select avg(v) from mat)')} v from mat")
def _(s, d):
    return M.centre(V.mat(s, d)).select("i", "j", r6("v").alias("v"))
