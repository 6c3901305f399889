"""Registered queries that apply plans, chains and named operations to whole images, with their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lumentab.functions.hashing import to_hex16
from lumentab.functions.numeric import r6
from lumentab.operators import batch as Ba, phash as H, pixels as P, stencils as W
from lumentab.plans import views as V
from lumentab.plans.pixel_queries import SHAPED, shaped_rasters, u31
from lumentab.plans.sqltext import R, SAT
from lumentab.plans.stat_queries import GAUSS, byte_tiles, stencil_sql
from lumentab.plans.table_queries import COS, EDGES, file_number, image_folder
from lumentab.plans.views import duck
from lumentab.session import ship_package
from lumentab.sources import images as I, paths as Pa
from lumentab.sources.bitmaps import encode, read_tiles
from lumentab.sources.folders import run_folder

Q = {}


def query(name, sql=None, **kw):
    def add(fn):
        Q[name] = (fn, duck(sql, **kw) if sql else None)
        return fn

    return add


def between(name, lo, hi):
    return f"({lo!r}::double+{u31(name)}*{hi - lo!r}::double)"


LOG_LOW, LOG_HIGH = math.log(0.75), math.log(1.33)
TURN = "(case when {0}<0 then {0}+6 when {0}>=6 then {0}-6 else {0} end)"
#: Stages of the augmentation: plan, source pixel, brightness, contrast, then hue and saturation.
AUGMENT = {
    "plan4": f"""select image_id, {u31('flip')}<5e-1 flip, floor({u31('top')}*(4-ch+1)) tp, floor({u31('left')}*(4-cw+1)) lf, cw, ch, {between('rotation', -10.0, 10.0)}*{math.pi / 180!r}::double ang,
 {between('brightness', 0.85, 1.15)} br, {between('contrast', 0.85, 1.15)} ct, {between('saturation', 0.9, 1.1)} sn, {between('hue', -0.02, 0.02)} hu
 from (select *, case when tw<=4 and th<=4 then cast(tw as int) else 4 end cw, case when tw<=4 and th<=4 then cast(th as int) else 4 end ch from (select *, round_even(sqrt(area*asp),0) tw, round_even(sqrt(area/asp),0) th from (select vec_id image_id, 16*{between('area', 0.7, 1.0)} area, exp({between('aspect', LOG_LOW, LOG_HIGH)}) asp from embeddings) a) b) c""",
    "sources": "select *, sy between 0 and 5 and sx between 0 and 5 ins, tp+floor((sy+5e-1)*ch/6) py, lf+floor((case when flip then 5-sx else sx end+5e-1)*cw/6) px_ from (select *, cast(a.d as int) y, cast(b.d as int) x, round_even((b.d-25e-1)*-sin(ang)+(a.d-25e-1)*cos(ang)+25e-1,0) sy, round_even((b.d-25e-1)*cos(ang)+(a.d-25e-1)*sin(ang)+25e-1,0) sx from plan4, range(0,6) a(d), range(0,6) b(d)) q",
    "lit": f"select s.image_id, s.y, s.x, ct, sn, hu, {SAT('coalesce(p.b,104)*br')} b, {SAT('coalesce(p.g,116)*br')} g, {SAT('coalesce(p.r,124)*br')} r from sources s left join bgr p on p.image_id=s.image_id and ins and p.y=py and p.x=px_",
    "grays": f"select image_id, sum({SAT('r*299e-3+g*587e-3+b*114e-3')})/36e0 m from lit group by 1",
    "flat": f"select l.image_id, y, x, sn, hu, {SAT('b*ct+m*(1-ct)')} b, {SAT('g*ct+m*(1-ct)')} g, {SAT('r*ct+m*(1-ct)')} r from lit l join grays k on k.image_id=l.image_id",
    "hexed": f"select *, {TURN.format('h0')} h6 from (select *, case when top=0 then 0e0 else least(1e0,cast(top-low as double)/top*sn) end st, case when top=low then 0e0 when top=r then (g-b)/cast(top-low as double) when top=g then (b-r)/cast(top-low as double)+2 else (r-g)/cast(top-low as double)+4 end+hu*6 h0 from (select *, greatest(b,g,r) top, least(b,g,r) low from flat) q) z",
    "four": "select image_id, y, x, cast(floor(h6) as int) i, cast(top as double) v, top*(1-st) p, top*(1-st*(h6-floor(h6))) q, top*(1-st*(1-(h6-floor(h6)))) t from hexed",
}


@query("P31_augmented_pixels", f"select image_id, y, x, {SAT('[p,p,t,v,v,q][i+1]')} b, {SAT('[t,v,v,q,p,p][i+1]')} g, {SAT('[v,q,p,p,t,v][i+1]')} r from four", extra=AUGMENT)
def _(s, d):
    plane = lambda c: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.get("cells", p * 4 + c))
    rows = V.byte_rasters(s, d).select("image_id", F.lit(4).alias("h"), F.lit(4).alias("w"), F.array(*[plane(c) for c in range(3)]).alias("planes"))
    return P.augmented(rows, 6, 42)


CROPS = "unnest([{'crop':'top_left','tp':0e0,'lf':0e0},{'crop':'top_right','tp':0e0,'lf':rw-4e0},{'crop':'bottom_left','tp':rh-4e0,'lf':0e0},{'crop':'bottom_right','tp':rh-4e0,'lf':rw-4e0},{'crop':'centre','tp':round_even((rh-4)/2e0,0),'lf':round_even((rw-4)/2e0,0)}], recursive:=true)"


@query("P17_cut_crops", f"""select g.image_id, crop, cast(a.d as int) y, cast(b.d as int) x, cast(p.v as double) v from
 (select *, {CROPS} from (select *, case when w<=h then 6 else cast(floor(w*6/cast(h as double)) as int) end rw, case when w<=h then cast(floor(h*6/cast(w as double)) as int) else 6 end rh from (select distinct image_id, h, w from shaped) q) z) g
 join range(0,4) a(d) on true join range(0,4) b(d) on true
 join shaped p on p.image_id=g.image_id and p.y=floor((a.d+tp)*g.h/cast(rh as double)) and p.x=floor((b.d+lf)*g.w/cast(rw as double))""", extra=SHAPED)
def _(s, d):
    return P.cut_crops(shaped_rasters(s, d), 6, 4)


@query("UDF_op_registry", f"""select image_id, 'gray' operation, 'done' status, y, x, cast(v as double) v from px8 where image_id%4=0
 union all select image_id, 'blur', 'done', y, x, cast({SAT('v')} as double) from ({stencil_sql(GAUSS)}) q where image_id%4=1
 union all select image_id, 'edge', 'done', y, x, 255e0 from hyst where image_id%4=2
 union all select vec_id, case when vec_id%8=3 then 'sharpen' end, 'unknown operation', null, null, null from embeddings where vec_id%4=3""", recursive=True, extra=EDGES)
def _(s, d):
    i = F.col("image_id")
    name = F.when(i % 4 == 0, "gray").when(i % 4 == 1, "blur").when(i % 4 == 2, "edge").when(i % 8 == 3, "sharpen")
    return Ba.run_operations(byte_tiles(s, d).withColumn("operation", name))


@query("UDF_transform_chain", f"""select image_id, 'done' status, y, x, cast(case image_id%5 when 0 then v when 1 then {SAT('(255-v)*15e-1+20')} when 2 then (case when v>=128 then 255 else 0 end) else {SAT('v*15e-1+20')} end as double) v
 from (select image_id, y, v, case when image_id%5 in (2,3) then 7-x else x end x from (select image_id, x, v, case when image_id%5=3 then 7-y else y end y from px8) q) z where image_id%5<4
 union all select vec_id, case when vec_id%10=4 then 'unknown step sepia' else 'unknown step null' end, null, null, null from embeddings where vec_id%5=4""")
def _(s, d):
    chains = [[], ["negative", "contrast"], ["mirror", "threshold"], ["upside_down", "mirror", "contrast"]]
    i = F.col("image_id")
    steps = F.when(i % 10 == 4, F.array(F.lit("mirror"), F.lit("sepia"))).otherwise(F.array(F.lit(None).cast("string")))
    for k, names in enumerate(chains):
        steps = F.when(i % 5 == k, F.array(*[F.lit(n) for n in names]).cast("array<string>")).otherwise(steps)
    done = Ba.run_chain(V.byte_rasters(s, d).withColumn("steps", steps))
    out = done.select("image_id", "status", F.posexplode_outer("cells").alias("p", "v"))
    return out.select("image_id", "status", F.floor(F.col("p") / V.SIDE).cast("int").alias("y"), (F.col("p") % V.SIDE).alias("x"), "v")


SEVEN = "(case when abs({0})%14>7 then 14-abs({0})%14 else abs({0})%14 end)"


@query("W10_box_blur_wide", f"select p.image_id, p.y, p.x, {SAT('sum(s.v)/961e0')} v from px8 p join range(-15,16) b(dy) on true join rowsums s on s.image_id=p.image_id and s.x=p.x and s.y={SEVEN.format('(p.y+dy)')} group by 1,2,3",
       extra={"rowsums": f"select p.image_id, p.y, p.x, sum(s.v) v from px8 p join range(-15,16) a(dx) on true join px8 s on s.image_id=p.image_id and s.y=p.y and s.x={SEVEN.format('(p.x+dx)')} group by 1,2,3"})
def _(s, d):
    return W.box_blur(byte_tiles(s, d), 31)


@query("W09_pooling_wide", f"select 'max' kind, image_id, cast(a as int) y, cast(b as int) x, {R('max(v)')} v from px join range(0,4) r(a) on y between a*2-4 and a*2+5 join range(0,4) q(b) on x between b*2-4 and b*2+5 group by 1,2,3,4 union all select 'avg', image_id, cast(a as int), cast(b as int), {R('sum(v)/81')} from px join range(0,2) r(a) on y between a*3-3 and a*3+5 join range(0,2) q(b) on x between b*3-3 and b*3+5 group by 1,2,3,4")
def _(s, d):
    t = W.tiles_from_rasters(V.rasters(s, d))
    widest = W.pool(t, (10, 10), "max", stride=(2, 2), pad=(4, 4)).withColumn("kind", F.lit("max"))
    mean = W.pool(t, (9, 9), "avg", stride=(3, 3), pad=(3, 3)).withColumn("kind", F.lit("avg"))
    return widest.unionByName(mean).select("kind", "image_id", "y", "x", r6("v").alias("v"))


MOSAIC = 16


def mosaic_folder(s, d) -> str:
    """Bitmaps of 16 x 16 rasters each, neighbours by id; places without a raster are black."""
    root = run_folder(s, "mosaics")
    ship_package(s)
    edge = MOSAIC * V.SIDE

    def write(key, rows):
        import pandas as pd
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(root)
        store.create_dir(place, recursive=True)
        image = np.zeros((edge, edge), np.uint8)
        for i, cells in zip(rows["image_id"], rows["cells"]):
            y, x = i % MOSAIC**2 // MOSAIC * V.SIDE, i % MOSAIC * V.SIDE
            image[y : y + V.SIDE, x : x + V.SIDE] = np.array(cells).reshape(V.SIDE, V.SIDE)
        with store.open_output_stream(f"{place}/mosaic_{key[0]}.bmp") as f:
            f.write(encode(image))
        return pd.DataFrame({"n": [len(rows)]})

    rows = V.byte_rasters(s, d).select(F.floor(F.col("image_id") / MOSAIC**2).alias("m"), "image_id", "cells")
    # a group holds the 256 rasters of one mosaic
    rows.groupBy("m").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    return root


WIDE = "(case when abs({0})>127 then 254-abs({0}) else abs({0}) end)"


LAPLACE = ", ".join(f"({dy - 1},{dx - 1},{float(k)!r}::double)" for dy, row in enumerate(W.LAPLACIAN) for dx, k in enumerate(row) if k)


@query("S07_large_image_tiles", f"select q.image_id, q.y, q.x, {R('sum(s.v*kv)')} v from (select p.image_id, p.y, p.x, kv, {WIDE.format('(p.y+dy)')} ny, {WIDE.format('(p.x+dx)')} nx from mosaic p cross join (values {LAPLACE}) k(dy,dx,kv)) q join mosaic s on s.image_id=q.image_id and s.y=q.ny and s.x=q.nx group by 1,2,3",
       extra={"mosaic": "select m.k image_id, cast(a.d as int) y, cast(b.d as int) x, coalesce(p.v,0) v from (select distinct vec_id//256 k from embeddings) m join range(0,128) a(d) on true join range(0,128) b(d) on true left join (select image_id//256 k, (image_id%256)//16*8+y my, image_id%16*8+x mx, v from px8) p on p.k=m.k and p.my=a.d and p.mx=b.d"})
def _(s, d):
    rows = read_tiles(s, mosaic_folder(s, d), side=48, halo=1, band_bytes=1 << 14)
    named = rows.filter("read_ok").withColumn("image_id", Pa.image_number(Pa.stem(F.col("path"))))
    return W.filter_mirror(named, W.LAPLACIAN).select("image_id", "y", "x", r6("v").alias("v"))


HEX = "lower(printf('%08x%08x', (h>>32)&4294967295, h&4294967295))"
BITS = "cast(bit_or(case when {0} then (case when {1}=0 then (-9223372036854775808)::bigint else cast(1 as bigint)<<(63-({1})) end) else 0::bigint end) as bigint) h"
#: Hashes of the images of 8 x 8 cells: at 8 rows of 9 pixels, and at 32 x 32.
FILE_HASHES = {
    "cosines": COS["cosines"],
    "half": COS["half"].replace("from px)", "from px8)"),
    "dct": f"select image_id, u, w, {R('v')} v from ({COS['dct']}) q",
    "meds": COS["meds"],
    "nine": f"select image_id, y, cast(b.d as int) x, {SAT(R('sum(v*(least(p.x+1,(b.d+1)*8e0/9)-greatest(p.x,b.d*8e0/9)))/(8e0/9)'))} v from px8 p join range(0,9) b(d) on p.x+1>b.d*8e0/9 and p.x<(b.d+1)*8e0/9 group by 1,2,3",
    "phashes": f"select image_id, {BITS.format('v>m', 'u*8+w')} from dct join meds using (image_id) group by 1",
    "dhashes": f"select image_id, {BITS.format('n>v', 'y*8+x')} from (select *, lead(v) over (partition by image_id, y order by x) n from nine) q where x<8 group by 1",
    "spreads": f"select image_id, {R('avg(v)')} mean_v, {R('stddev_pop(v)')} sd_v from px8 group by 1",
}


@query("E2E_file_features", f"select e.vec_id image_id, concat('class_',e.label) class_name, e.vec_id%13<>0 read_ok, case when e.vec_id%13<>0 then 8 end h, case when e.vec_id%13<>0 then 8 end w, mean_v, sd_v, p.x phash, d.x dhash from embeddings e left join (select * from spreads where image_id%13<>0) s on s.image_id=e.vec_id left join (select image_id, {HEX} x from phashes where image_id%13<>0) p on p.image_id=e.vec_id left join (select image_id, {HEX} x from dhashes where image_id%13<>0) d on d.image_id=e.vec_id", extra=FILE_HASHES)
def _(s, d):
    rows = I.file_features(s, image_folder(s, d))
    return rows.select(file_number(), "class_name", "read_ok", "h", "w", r6("mean_v").alias("mean_v"), r6("sd_v").alias("sd_v"), to_hex16(F.col("phash")).alias("phash"), to_hex16(F.col("dhash")).alias("dhash"))


@query("W17_resized_difference_hash", f"select image_id, {HEX} dhash from dhashes", extra=FILE_HASHES)
def _(s, d):
    return H.image_hashes(V.byte_rasters(s, d)).select("image_id", to_hex16(F.col("dhash")).alias("dhash"))


@query("W16_resized_perceptual_hash", f"select image_id, {HEX} phash from phashes", extra=FILE_HASHES)
def _(s, d):
    return H.image_hashes(V.byte_rasters(s, d)).select("image_id", to_hex16(F.col("phash")).alias("phash"))
