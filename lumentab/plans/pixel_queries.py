"""Registered pixel queries (projections and filters) with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lumentab.functions.numeric import r6, relu, sigmoid
from lumentab.operators import pixels as P
from lumentab.plans import views as V
from lumentab.plans.sqltext import R, SAT, U
from lumentab.plans.views import duck

Q = {}


def query(name, sql=None, **kw):
    def add(fn):
        Q[name] = (fn, duck(sql, **kw) if sql else None)
        return fn

    return add


@query("P01_negative", "select image_id, y, x, 255-v v, 255-v n from px8")
def _(s, d):
    p = V.px8(s, d)
    return P.negative(p).withColumn("n", F.bitwise_not(F.lit(255) - F.col("v")).bitwiseAND(F.lit(255)))


@query("P02_saturating_arithmetic", f"select image_id, y, x, {SAT('v+100e0')} v_add, {SAT('v-100e0')} v_subtract, {SAT('v*2e0')} v_multiply, {SAT('v/2e0')} v_divide, 0 v_zero from px8")
def _(s, d):
    p = V.px8(s, d)
    f = lambda op, c: P.saturating(op, F.col("v"), F.lit(c)).alias(f"v_{op}")
    return p.select("image_id", "y", "x", f("add", 100), f("subtract", 100), f("multiply", 2), f("divide", 2), P.saturating("divide", F.col("v"), F.lit(0)).alias("v_zero"))


@query("P03_contrast_lightness", f"select image_id, y, x, {SAT('v*15e-1+20')} v from px8")
def _(s, d):
    return P.weighted(V.px8(s, d), 1.5, 20)


@query("P04_image_and_or", "select a.image_id, a.y, a.x, a.v & b.v v_and, a.v | b.v v_or from px8 a join px8 b on b.image_id=a.image_id+1 and a.y=b.y and a.x=b.x")
def _(s, d):
    p = V.byte_rasters(s, d)
    return P.combine(p, p.withColumn("image_id", F.col("image_id") - 1), "and", "or")


@query("P05_gray", f"select image_id, y, x, {SAT('r*299e-3+g*587e-3+b*114e-3')} v from bgr")
def _(s, d):
    return P.to_gray(V.bgr(s, d))


HSV_SQL = f"""select image_id, y, x,
 cast(round_even((case when a<0 then a+360 else a end)/2,0) as int)%180 h,
 case when top=0 then 0 else {SAT('(top-low)*255e0/top')} end s, top v, b, g, r
 from (select *, case when top=low then 0e0 when top=r then (g-b)*60e0/(top-low) when top=g then (b-r)*60e0/(top-low)+120 else (r-g)*60e0/(top-low)+240 end a
       from (select *, greatest(b,g,r) top, least(b,g,r) low from bgr) q) q2"""
HSV = {"hsv": HSV_SQL}


@query("P06_hsv", "select image_id, y, x, h, s, v from hsv", extra=HSV)
def _(s, d):
    return P.to_hsv(V.bgr(s, d))


LOW, HIGH = {"h": 0, "s": 0, "v": 120}, {"h": 180, "s": 80, "v": 255}


@query("P07_in_range", "select image_id, y, x, case when h between 0 and 180 and s between 0 and 80 and v between 120 and 255 then 255 else 0 end mask from hsv", extra=HSV)
def _(s, d):
    return P.in_range(P.to_hsv(V.bgr(s, d)), LOW, HIGH).select("image_id", "y", "x", "mask")


@query("P08_background_removed", "select image_id, y, x, case when k then 0 else b end b, case when k then 0 else g end g, case when k then 0 else r end r from (select *, h between 0 and 180 and s between 0 and 80 and v between 120 and 255 k from hsv) q", extra=HSV)
def _(s, d):
    from lumentab.functions import colour

    p = V.bgr(s, d).withColumns({c: e for c, e in zip("hsv", colour.hsv(F.col("b"), F.col("g"), F.col("r")))})
    return P.keep_masked(P.in_range(p, LOW, HIGH), ["b", "g", "r"], invert=True).select("image_id", "y", "x", "b", "g", "r")


@query("P09_split_overwrite_merge", "select image_id, y, x, 255 b, g, r from bgr")
def _(s, d):
    return P.merge_channels(P.overwrite_channel(P.split_channels(V.bgr(s, d)), 0, 255))


@query("P10_mix_channels", "select image_id, y, x, r b, g g, b r from bgr")
def _(s, d):
    return P.mix_channels(V.bgr(s, d), [2, 0, 1, 1, 0, 2])


@query("P11_threshold", "select image_id, y, x, case when v>=128 then 255 else 0 end at_least, case when v>128 then 255 else 0 end above from px8")
def _(s, d):
    p = V.px8(s, d)
    return p.select("image_id", "y", "x", F.when(F.col("v") >= 128, 255).otherwise(0).alias("at_least"), F.when(F.col("v") > 128, 255).otherwise(0).alias("above"))


@query("P12_roi_crop", "select image_id, y-2 y, x-1 x, v from px8 where y>=2 and y<6 and x>=1 and x<7")
def _(s, d):
    return P.crop(V.px8(s, d), 2, 1, 6, 7)


@query("P12_roi_paste", "select image_id, y, x, case when y>=2 and y<6 and x>=1 and x<7 then v else 0 end v from px8")
def _(s, d):
    return P.paste_on_black(V.px8(s, d), 2, 1, 6, 7)


@query("P13_flip", "select 0 code, image_id, 7-y y, x, v from px8 union all select 1, image_id, y, 7-x, v from px8 union all select -1, image_id, 7-y, 7-x, v from px8")
def _(s, d):
    out = None
    for code in (0, 1, -1):
        one = P.flip(V.px8(s, d), code, 8, 8).withColumn("code", F.lit(code))
        out = one if out is None else out.unionByName(one)
    return out


@query("P13_flip_with_mask", "select image_id, y, 7-x x, t, p from masks")
def _(s, d):
    return P.flip(V.masks(s, d), 1, 8, 8)


@query("P14_resize_nearest", "select 75 pct, image_id, cast(b.d as int) y, cast(a.d as int) x, v from px8 join range(0,6) a(d) on x=least(floor(a.d/75e-2),7) join range(0,6) b(d) on y=least(floor(b.d/75e-2),7) union all select 200, image_id, cast(b.d as int), cast(a.d as int), v from px8 join range(0,16) a(d) on x=least(floor(a.d/2e0),7) join range(0,16) b(d) on y=least(floor(b.d/2e0),7)")
def _(s, d):
    small = P.resize_nearest(V.px8(s, d), 0.75, 0.75, 8, 8).withColumn("pct", F.lit(75))
    return small.unionByName(P.resize_nearest(V.px8(s, d), 2.0, 2.0, 8, 8).withColumn("pct", F.lit(200)))


AREA = "sum(v*(least(p.y+1,(a.d+1)*8e0/nh)-greatest(p.y,a.d*8e0/nh))*(least(p.x+1,(b.d+1)*8e0/nw)-greatest(p.x,b.d*8e0/nw)))/(8e0/nh*8e0/nw)"


@query("P14_resize_area", f"select p.image_id, cast(a.d as int) y, cast(b.d as int) x, {R(AREA)} v from (select *, 2+image_id%5 nh, 3+image_id%4 nw from px) p join range(0,6) a(d) on a.d<nh and p.y+1>a.d*8e0/nh and p.y<(a.d+1)*8e0/nh join range(0,6) b(d) on b.d<nw and p.x+1>b.d*8e0/nw and p.x<(b.d+1)*8e0/nw group by 1,2,3,nh,nw")
def _(s, d):
    i = F.col("image_id")
    return P.resize_area(V.rasters(s, d), i % 5 + 2, i % 4 + 3).select("image_id", "y", "x", r6("v").alias("v"))


SHAPED = {"shaped": "select image_id, cast((y*8+x)//w as int) y, cast((y*8+x)%w as int) x, v, h, w from (select *, cast(pow(2,1+image_id%4) as int) h, cast(pow(2,5-image_id%4) as int) w from px8) q"}


def shaped_rasters(s, d):
    """Rasters of 2 x 32, 4 x 16, 8 x 8 and 16 x 4 cells."""
    power = F.col("image_id") % 4
    size = lambda k: F.pow(F.lit(2), k).cast("int")
    return V.byte_rasters(s, d).withColumns({"h": size(1 + power), "w": size(5 - power)})


@query("P15_letterbox_pixels", """select g.image_id, cast(a.d as int) y, cast(b.d as int) x, cast(coalesce(p.v,114) as double) v from
 (select *, cast(floor((12-rh)/2e0) as int) tp, cast(floor((12-rw)/2e0) as int) lf from (select *, cast(round_even(h*sc,0) as int) rh, cast(round_even(w*sc,0) as int) rw from (select distinct image_id, h, w, least(12e0/w,12e0/h) sc from shaped) q) z) g
 join range(0,12) a(d) on true join range(0,12) b(d) on true
 left join shaped p on p.image_id=g.image_id and a.d>=tp and a.d<tp+rh and p.y=floor((a.d-tp)*g.h/cast(rh as double)) and b.d>=lf and b.d<lf+rw and p.x=floor((b.d-lf)*g.w/cast(rw as double))""", extra=SHAPED)
def _(s, d):
    return P.letterbox(shaped_rasters(s, d), 12, 114).select("image_id", "y", "x", "v")


COS, SIN = math.cos(math.radians(30)), math.sin(math.radians(30))


@query("P13_rotated", f"""select g.image_id, cast(a.d as int) y, cast(b.d as int) x, cast(coalesce(p.v,0) as double) v from
 (select *, cast(ceil(h*{COS!r}::double+w*{SIN!r}::double-1e-9) as int) nh, cast(ceil(h*{SIN!r}::double+w*{COS!r}::double-1e-9) as int) nw from (select distinct image_id, h, w from shaped) q) g
 join range(0,40) a(d) on a.d<nh join range(0,40) b(d) on b.d<nw
 left join shaped p on p.image_id=g.image_id and p.y=round_even((b.d-(nw-1)/2e0)*-{SIN!r}::double+(a.d-(nh-1)/2e0)*{COS!r}::double+(g.h-1)/2e0,0) and p.x=round_even((b.d-(nw-1)/2e0)*{COS!r}::double+(a.d-(nh-1)/2e0)*{SIN!r}::double+(g.w-1)/2e0,0)""", extra=SHAPED)
def _(s, d):
    return P.rotate(shaped_rasters(s, d), 30, 0).select("image_id", "y", "x", "v")


def letterbox_sql(size):
    return f"""select image_id, w, h, scale, rw, rh, lft, tp, {size}-rw-lft rgt, {size}-rh-tp bot from
 (select *, cast(floor(({size}-rw)/2e0) as int) lft, cast(floor(({size}-rh)/2e0) as int) tp from
 (select *, cast(round_even(w*scale,0) as int) rw, cast(round_even(h*scale,0) as int) rh from
 (select *, least({size}e0/w,{size}e0/h) scale from img_dims) a) b) c"""


@query("P15_letterbox_geometry", f'select image_id, {R("scale")} scale, rw, rh, lft "left", tp top, rgt "right", bot bottom from ({letterbox_sql(256)}) q')
def _(s, d):
    return P.letterbox_geometry(V.img_dims(s, d), 256).select("image_id", r6("scale").alias("scale"), "rw", "rh", "left", "top", "right", "bottom")


@query("P16_letterbox_inverse", f"select p.image_id, y, x, v, cast(floor((y-tp)*h/cast(rh as double)) as int) oy, cast(floor((x-lft)*w/cast(rw as double)) as int) ox from px8 p join ({letterbox_sql(8)}) g on p.image_id=g.image_id where y>=tp and y<8-bot and x>=lft and x<8-rgt")
def _(s, d):
    return P.letterbox_inverse(V.px8(s, d), P.letterbox_geometry(V.img_dims(s, d), 8), 8)


@query("P17_five_crops", """select image_id, rw, rh, crop, cast(top as int) top, cast("left" as int) "left" from (select *, unnest([{'crop':'top_left','top':0e0,'left':0e0},{'crop':'top_right','top':0e0,'left':rw-224e0},{'crop':'bottom_left','top':rh-224e0,'left':0e0},{'crop':'bottom_right','top':rh-224e0,'left':rw-224e0},{'crop':'centre','top':round_even((rh-224)/2e0,0),'left':round_even((rw-224)/2e0,0)}], recursive:=true) from (select image_id, case when w<=h then 256 else cast(floor(w*256/cast(h as double)) as int) end rw, case when w<=h then cast(floor(h*256/cast(w as double)) as int) else 256 end rh from img_dims) q) z""")
def _(s, d):
    return P.five_crops(V.img_dims(s, d), 256, 224)


@query("P18_normalise", f"select image_id, y, x, {R('(b/255e0-406e-3)/225e-3')} b, {R('(g/255e0-456e-3)/224e-3')} g, {R('(r/255e0-485e-3)/229e-3')} r from bgr")
def _(s, d):
    return P.normalise(V.bgr(s, d)).select("image_id", "y", "x", *[r6(c).alias(c) for c in "bgr"])


@query("P19_denormalise_clamp", f"select image_id, y, x, {R('least(1,greatest(0,(b/64e0-2)*225e-3+406e-3))')} b, {R('least(1,greatest(0,(g/64e0-2)*224e-3+456e-3))')} g, {R('least(1,greatest(0,(r/64e0-2)*229e-3+485e-3))')} r from bgr")
def _(s, d):
    raw = V.bgr(s, d).withColumns({c: F.col(c) / 64.0 - 2 for c in "bgr"})
    return P.denormalise(raw).select("image_id", "y", "x", *[r6(c).alias(c) for c in "bgr"])


def palette_values():
    from lumentab.functions.colour import PALETTE

    return ", ".join(f"({i},{r},{g},{b})" for i, (r, g, b) in enumerate(PALETTE))


@query("P20_palette_to_class", f"select image_id, y, x, coalesce(c,0) class_index from bgr left join (values {palette_values()}) t(c,pr,pg,pb) on r//64*64=pr and g//64*64=pg and b//64*64=pb")
def _(s, d):
    q = V.bgr(s, d).withColumns({c: F.expr(f"cast({c} div 64 * 64 as int)") for c in "bgr"})
    return P.palette_classes(q)


@query("P21_class_to_colour", f"select image_id, predicted_index, r, g, b from preds join (values {palette_values()}) t(c,r,g,b) on predicted_index=c")
def _(s, d):
    return P.class_colours(V.preds(s, d).select("image_id", "predicted_index"), "predicted_index")


@query("P22_lookup_table", "select image_id, y, x, v, 255-v b, (v*2)%256 g, v//2 r from px8")
def _(s, d):
    lut = s.range(256).select(F.col("id").cast("int").alias("v"), (F.lit(255) - F.col("id")).cast("int").alias("b"), (F.col("id") * 2 % 256).cast("int").alias("g"), F.expr("cast(id div 2 as int)").alias("r"))
    return P.apply_lut(V.px8(s, d), lut)


@query("P23_trimap_mask", "select image_id, y, x, v%3+1 v, case when v%3+1<>2 then 1 else 0 end mask from px8")
def _(s, d):
    return P.trimap_to_mask(V.px8(s, d).withColumn("v", F.col("v") % 3 + 1))


@query("P24_minimum_size", "select image_id, w, h, w>=320 and h>=480 crop_fits from img_dims where w>=224 and h>=224")
def _(s, d):
    return P.at_least(V.img_dims(s, d), 224, 224).select("image_id", "w", "h", ((F.col("w") >= 320) & (F.col("h") >= 480)).alias("crop_fits"))


@query("P25_detections_in_pixels", 'select b.image_id, k, score, cast(trunc(x1*w) as int) "left", cast(trunc(y1*h) as int) top, cast(trunc(x2*w) as int) "right", cast(trunc(y2*h) as int) bottom from (select image_id, k, score, x1, y1, x2, y2 from boxes) b join (select image_id, w, h from img_dims) g on b.image_id=g.image_id where score>5e-1')
def _(s, d):
    return P.detections_in_pixels(V.boxes(s, d), V.img_dims(s, d), 0.5)


@query("P26_elementwise_arrays", f"select vec_id, cast(i-1 as int) i, {R('a+b')} v_add, {R('a-b')} v_sub, {R('a*b')} v_mul, {R('a/b')} v_div, {R('pow(a,2)')} v_pow, {R('exp(a)')} v_exp, a>b-3 v_gt, a=b-3 v_eq from (select vec_id, i, cast(embedding[i] as double) a, cast(embedding[65-i] as double)+3 b from embeddings, range(1,65) r(i)) q")
def _(s, d):
    e = V.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    pairs = F.zip_with("a", F.transform(F.reverse("a"), lambda v: v + 3), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    z = e.select("vec_id", F.posexplode(pairs).alias("i", "z"))
    x, y = F.col("z.x"), F.col("z.y")
    return z.select("vec_id", "i", r6(x + y).alias("v_add"), r6(x - y).alias("v_sub"), r6(x * y).alias("v_mul"), r6(x / y).alias("v_div"), r6(F.pow(x, F.lit(2.0))).alias("v_pow"), r6(F.exp(x)).alias("v_exp"), (x > y - 3).alias("v_gt"), (x == y - 3).alias("v_eq"))


@query("P27_broadcast_add", f"select a.i, b.j, {R('a.v+b.v')} v from (select i, v from mat where j=0) a, (select j, avg(v) v from mat group by j) b")
def _(s, d):
    m = V.mat(s, d)
    row = m.groupBy("j").agg(F.avg("v").alias("v")).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("r"))
    col = V.table(s, d, "embeddings").select(F.col("vec_id").alias("i"), F.get("embedding", F.lit(0)).cast("double").alias("a"))
    return col.withColumn("r", row.scalar()).select("i", "a", F.posexplode("r").alias("j", "b")).select("i", "j", r6(F.col("a") + F.col("b")).alias("v"))


@query("P28_slice_assign", f"select i, j, {R('case when i=1 and j=2 then 9 when i<2 then 12 else v end')} v, i=(select max(i) from mat) last_row, i between 1 and 2 middle_rows from mat")
def _(s, d):
    m = V.mat(s, d)
    last = V.table(s, d, "embeddings").agg(F.max("vec_id"))
    return m.select("i", "j", r6(F.when((F.col("i") == 1) & (F.col("j") == 2), 9.0).when(F.col("i") < 2, 12.0).otherwise(F.col("v"))).alias("v"), (F.col("i") == last.scalar()).alias("last_row"), F.col("i").between(1, 2).alias("middle_rows"))


@query("P29_activations", f"select image_id, y, x, {R('greatest(v,0)')} relu, {R('1/(1+exp(-v))')} sigmoid, {R('(1/(1+exp(-v)))*(1-1/(1+exp(-v)))')} slope from px")
def _(s, d):
    y = sigmoid(F.col("v"))
    return V.px(s, d).select("image_id", "y", "x", r6(relu(F.col("v"))).alias("relu"), r6(y).alias("sigmoid"), r6(y * (1 - y)).alias("slope"))


@query("P30_dropout", f"select image_id, y, x, {R('case when u<5e-1 then 0 else v/5e-1 end')} half, {R('v')} kept, 0e0 gone from (select *, {U('7', 'image_id', 'y', 'x')} u from px) q")
def _(s, d):
    p = V.px(s, d).withColumns({"half": F.col("v"), "kept": F.col("v"), "gone": F.col("v")})
    keys = ["image_id", "y", "x"]
    for c, share in (("half", 0.5), ("kept", 0.0), ("gone", 1.0)):
        p = P.dropout(p, c, share, 7, keys)
    return p.select(*keys, r6("half").alias("half"), r6("kept").alias("kept"), "gone")


def u31(n):
    return U(f"42:{n}", "image_id")


@query("P31_augmentation_plan", f"""select image_id, {u31('flip')}<5e-1 flip, cast(floor({u31('top')}*(h-ch+1)) as int) top, cast(floor({u31('left')}*(w-cw+1)) as int) "left", cw crop_w, ch crop_h, {R(f"-10+{u31('rotation')}*20")} rotation, {R(f"85e-2+{u31('brightness')}*3e-1")} brightness, {R(f"85e-2+{u31('contrast')}*3e-1")} contrast, {R(f"9e-1+{u31('saturation')}*2e-1")} saturation, {R(f"-2e-2+{u31('hue')}*4e-2")} hue
 from (select *, case when tw<=w and th<=h then cast(tw as int) else w end cw, case when tw<=w and th<=h then cast(th as int) else h end ch from (select *, round_even(sqrt(area*asp),0) tw, round_even(sqrt(area/asp),0) th from (select *, w*h*(7e-1+{u31('area')}*3e-1) area, exp(ln(75e-2)+{u31('aspect')}*(ln(133e-2)-ln(75e-2))) asp from img_dims) a) b) c""")
def _(s, d):
    p = P.augmentation_plan(V.img_dims(s, d), 42)
    return p.select("image_id", "flip", "top", "left", "crop_w", "crop_h", *[r6(c).alias(c) for c in ("rotation", "brightness", "contrast", "saturation", "hue")])
