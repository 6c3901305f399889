"""Image-shaped views over the driver tables, in Spark and as DuckDB text.

Every embedding is read as an 8x8 raster. The Spark views that start from an
embedding stay inside the row (array expressions), so none of them shuffles
before an operator asks for it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumentab.functions.hashing import coefficient_bits
from lumentab.functions.numeric import let
from lumentab.operators.predictions import linear_scores
from lumentab.session import spread

SIDE = 8
CLASSES = 10


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rasters(spark, sf) -> DataFrame:
    """One row per image: image_id, h, w and the row-major cells."""
    return spread(table(spark, sf, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("image_id"),
        F.lit(SIDE).alias("h"),
        F.lit(SIDE).alias("w"),
        F.col("embedding").cast("array<double>").alias("cells"),
    )


def byte_rasters(spark, sf) -> DataFrame:
    return rasters(spark, sf).withColumn(
        "cells",
        F.transform(
            "cells",
            lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v + 0.5) * 255))).cast("double"),
        ),
    )


def px(spark, sf) -> DataFrame:
    cells = spread(table(spark, sf, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e")
    )
    return cells.select(
        "image_id",
        F.expr("cast(i div 8 as int)").alias("y"),
        (F.col("i") % SIDE).cast("int").alias("x"),
        F.col("e").cast("double").alias("v"),
    )


def byte_value(v):
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v + 0.5) * 255))).cast("int")


def px8(spark, sf) -> DataFrame:
    return px(spark, sf).withColumn("v", byte_value(F.col("v")))


def bgr(spark, sf) -> DataFrame:
    """4x4 three-channel pixels; cell 4p+c of the raster is channel c of pixel p."""
    cells = byte_rasters(spark, sf).select("image_id", "cells", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    return cells.select(
        "image_id",
        F.expr("cast(p div 4 as int)").alias("y"),
        (F.col("p") % 4).alias("x"),
        *[F.get("cells", F.col("p") * 4 + c).cast("int").alias(n) for c, n in enumerate("bgr")],
    )


def img_dims(spark, sf) -> DataFrame:
    vid = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        vid.alias("image_id"),
        F.col("label").alias("class_index"),
        (F.lit(200) + (vid * 13) % 300).cast("int").alias("w"),
        (F.lit(180) + (vid * 29) % 400).cast("int").alias("h"),
        F.lit(3).alias("channels"),
    )


def mat(spark, sf) -> DataFrame:
    """Every embedding is one matrix row: n x 64."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("i"), F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "v")
    )


def centroid(spark, sf) -> DataFrame:
    """Mean vector of each class, long form (64 x classes)."""
    return (
        table(spark, sf, "embeddings")
        .select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
        .groupBy(F.col("label").alias("class_index"), "i")
        .agg(F.avg("v").alias("w"))
    )


def mat_b(spark, sf) -> DataFrame:
    """Second matrix, 64 x classes: the class means (fixed in size for a fixed class list)."""
    return centroid(spark, sf).select("i", F.col("class_index").cast("bigint").alias("j"), F.round("w", 6).alias("v"))


def phash_base(spark, sf) -> DataFrame:
    """63 median bits of each embedding; bit 63 stays 0 in this view."""
    return spread(table(spark, sf, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("image_id"),
        "label",
        coefficient_bits(F.col("embedding").cast("array<double>")).bitwiseAND(F.lit((1 << 63) - 1)).alias("h"),
    )


def hashes(spark, sf) -> DataFrame:
    """Originals, flipped-bit copies and copies of copies, a few across classes."""
    base = phash_base(spark, sf)
    i = F.col("image_id")
    flip = lambda m: F.expr(f"shiftleft(1L, cast(image_id % {m} as int)) - 1L")
    return base.select(
        F.explode(
            F.array(
                F.struct(i.alias("image_id"), F.col("label").alias("class_index"), F.col("h").alias("phash"), F.col("h").alias("dhash")),
                F.struct(
                    (i + 100000).alias("image_id"),
                    F.col("label").alias("class_index"),
                    F.col("h").bitwiseXOR(flip(10)).alias("phash"),
                    F.col("h").bitwiseXOR(flip(8)).alias("dhash"),
                ),
                F.struct(
                    (i + 200000).alias("image_id"),
                    F.when(i % 50 == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label")).alias("class_index"),
                    F.col("h").bitwiseXOR(flip(10)).bitwiseXOR(F.lit(15728640)).alias("phash"),
                    F.col("h").bitwiseXOR(flip(8)).bitwiseXOR(F.lit(15728640)).alias("dhash"),
                ),
            )
        ).alias("r")
    ).select("r.*")


def class_scores(spark, sf) -> DataFrame:
    """image_id, label and the array of class scores in class order (stays one row per image)."""
    vectors = spread(table(spark, sf, "embeddings"), "vec_id").select(F.struct("vec_id", "label").alias("id"), F.col("embedding").alias("v"))
    scored = linear_scores(vectors, centroid(spark, sf), 20.0)
    rounded = F.transform("scores", lambda c: F.struct(c["class_index"].alias("class_index"), F.round(c["z"], 6).alias("z")))
    return scored.select(F.col("id.vec_id").alias("image_id"), F.col("id.label").alias("label"), rounded.alias("s"))


def logits(spark, sf) -> DataFrame:
    return class_scores(spark, sf).select("image_id", F.explode("s").alias("s")).select("image_id", "s.class_index", "s.z")


def class_probs(spark, sf) -> DataFrame:
    """image_id, label and array of (class_index, p) from the scores of one row."""
    raised = lambda m: F.transform("s", lambda c: F.struct(c["class_index"].alias("class_index"), F.exp(c["z"] - m).alias("e")))
    shares = lambda r: let(
        F.aggregate(r, F.lit(0.0), lambda a, c: a + c["e"]),
        lambda t: F.transform(r, lambda c: F.struct(c["class_index"].alias("class_index"), F.round(c["e"] / t, 9).alias("p"))),
    )
    return class_scores(spark, sf).select(
        "image_id", "label", let(F.array_max(F.transform("s", lambda c: c["z"])), lambda m: let(raised(m), shares)).alias("s")
    )


def probs(spark, sf) -> DataFrame:
    return class_probs(spark, sf).select("image_id", F.explode("s").alias("s")).select("image_id", "s.class_index", "s.p")


def _ranked_probs(spark, sf) -> DataFrame:
    return class_probs(spark, sf).withColumn(
        "s",
        F.sort_array(F.transform("s", lambda c: F.struct((-c["p"]).alias("n"), c["class_index"].alias("class_index"), c["p"].alias("p")))),
    )


def preds(spark, sf) -> DataFrame:
    best = _ranked_probs(spark, sf).select("image_id", "label", F.get("s", F.lit(0)).alias("b"))
    return best.select(
        "image_id",
        F.col("label").alias("true_index"),
        F.col("b.class_index").alias("predicted_index"),
        F.col("b.p").alias("confidence"),
        (F.col("label") == F.col("b.class_index")).alias("correct"),
    )


def preds_topk(spark, sf) -> DataFrame:
    top = _ranked_probs(spark, sf).select("image_id", "label", F.posexplode(F.slice("s", 1, 3)).alias("k", "b"))
    i = F.col("image_id")
    return top.select(
        "image_id",
        F.col("label").alias("expected_index"),
        F.when(i % 4 == 0, "negative").otherwise("positive").alias("test_type"),
        F.when(i % 2 == 0, "closeup").otherwise("wider_trunk").alias("view_type"),
        (F.col("k") + 1).alias("k"),
        F.col("b.class_index").alias("class_index"),
        F.col("b.p").alias("p"),
    )


def masks(spark, sf, *more) -> DataFrame:
    """Truth and predicted mask; ``more`` are further columns of the same pixel, ``z`` the raw value."""
    v = F.col("v")
    return px(spark, sf).withColumn("z", F.col("v")).withColumn("v", byte_value(F.col("v"))).select(
        "image_id",
        "y",
        "x",
        *more,
        F.when(F.col("image_id") % 50 == 0, 0).when(v >= 128, 1).otherwise(0).alias("t"),
        F.when(v >= 140, 1).otherwise(0).alias("p"),
    )


def boxes(spark, sf) -> DataFrame:
    """16 boxes per image: 4 truths, 12 detections (which also serve as anchors)."""
    c = rasters(spark, sf).select("image_id", "cells", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    at = lambda o: F.get("cells", F.col("k") * 4 + o)
    i, k = F.col("image_id"), F.col("k")
    geo = c.select("image_id", "k", (at(0) + 0.5).alias("cx"), (at(1) + 0.5).alias("cy"), (F.abs(at(2)) + 0.1).alias("w"), (F.abs(at(3)) + 0.1).alias("h"))
    return geo.select(
        "image_id",
        "k",
        F.when(k < 4, "truth").otherwise("det").alias("kind"),
        (k % 2).alias("class_index"),
        (((i * 37 + k * 101) % 1000) / F.lit(1000.0)).alias("score"),
        (F.col("cx") - F.col("w") / 2).alias("x1"),
        (F.col("cy") - F.col("h") / 2).alias("y1"),
        (F.col("cx") + F.col("w") / 2).alias("x2"),
        (F.col("cy") + F.col("h") / 2).alias("y2"),
    )


def label_lines(spark, sf) -> DataFrame:
    k, c = F.col("k"), F.col("class_index").cast("string")
    return boxes(spark, sf).select(
        "image_id",
        "k",
        F.when(k % 7 == 6, F.concat(c, F.lit(" 0.5 0.5")))
        .when(k % 5 == 4, F.concat(c, F.lit(" 1.5 0.5 0.1 0.1")))
        .otherwise(F.concat_ws(" ", c, (F.floor(F.col("score") * 1000) / 1e3).cast("string"), F.lit("0.5"), F.lit("0.25"), F.lit("0.125")))
        .alias("line"),
    )


def manifest(spark, sf) -> DataFrame:
    first = F.substring(F.md5(F.concat(F.lit("42:"), F.col("image_id").cast("string"))), 1, 1)
    return img_dims(spark, sf).select(
        "image_id",
        "class_index",
        F.concat(F.lit("IMG_"), F.col("image_id").cast("string")).alias("stem"),
        F.when(first < "b", "train").when(first < "d", "validation").otherwise("test").alias("split"),
        F.concat(F.lit("g"), (F.col("image_id") % 100).cast("string")).alias("group_id"),
    )


def house(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("id"),
        F.when(k % 5 == 0, "test").otherwise("train").alias("part"),
        F.when(k % 7 != 0, F.col("p_size").cast("double")).alias("size"),
        F.when(k % 11 != 0, F.col("p_brand")).alias("brand"),
        F.col("p_retailprice").alias("price"),
    )


def history(spark, sf) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(F.dayofmonth("ts").alias("epoch"))
        .agg(F.round(F.avg("value"), 6).alias("metric"), F.round(F.avg(F.col("value") * F.col("value")), 6).alias("loss"))
    )


def run_results(spark, sf) -> DataFrame:
    p = F.col("page_id")
    return table(spark, sf, "pages").select("page_id", (p % 13 != 0).alias("read_ok"), ((p % 13 != 0) & (p % 17 != 0)).alias("saved"))


DUCK = {
    "px": "select vec_id image_id, cast(floor((i-1)/8) as int) y, cast((i-1)%8 as int) x, cast(embedding[i] as double) v from embeddings, range(1,65) r(i)",
    "px8": "select image_id, y, x, cast(least(255,greatest(0,floor((v+5e-1)*255))) as int) v from px",
    "bgr": "select image_id, cast(floor((y*8+x)/16) as int) y, cast(floor((y*8+x)/4) as int) % 4 x, max(case when (y*8+x)%4=0 then v end) b, max(case when (y*8+x)%4=1 then v end) g, max(case when (y*8+x)%4=2 then v end) r from px8 group by 1,2,3",
    "img_dims": "select vec_id image_id, label class_index, cast(200+(vec_id*13)%300 as int) w, cast(180+(vec_id*29)%400 as int) h, 3 channels from embeddings",
    "mat": "select image_id i, y*8+x j, v from px",
    "centroid": "select e.label class_index, p.y*8+p.x i, avg(p.v) w from px p join embeddings e on p.image_id=e.vec_id group by 1,2",
    "mat_b": "select i, cast(class_index as bigint) j, round(w,6) v from centroid",
    "phash_base": "select t.image_id, cast(sum(case when t.b and t.i>0 then cast(1 as bigint)<<(63-t.i) else 0 end) as bigint) h from (select p.image_id, p.y*8+p.x i, p.v>q.m b from px p join (select image_id, quantile_cont(v,5e-1) m from px where y*8+x>0 group by image_id) q on p.image_id=q.image_id) t group by t.image_id",
    "hashes": "select image_id, label class_index, h phash, h dhash from phash_base b join embeddings e on b.image_id=e.vec_id union all select image_id+100000, label, xor(h,(cast(1 as bigint)<<cast(image_id%10 as int))-1), xor(h,(cast(1 as bigint)<<cast(image_id%8 as int))-1) from phash_base b join embeddings e on b.image_id=e.vec_id union all select image_id+200000, case when image_id%50=0 then (label+1)%10 else label end, xor(xor(h,(cast(1 as bigint)<<cast(image_id%10 as int))-1),15728640), xor(xor(h,(cast(1 as bigint)<<cast(image_id%8 as int))-1),15728640) from phash_base b join embeddings e on b.image_id=e.vec_id",
    "logits": "select p.image_id, c.class_index, round(sum(p.v*c.w)*20,6) z from px p join centroid c on p.y*8+p.x=c.i group by 1,2",
    "probs": "select image_id, class_index, round(exp(z-m)/sum(exp(z-m)) over (partition by image_id),9) p from (select *, max(z) over (partition by image_id) m from logits) q",
    "preds": "select r.image_id, e.label true_index, r.class_index predicted_index, r.p confidence, e.label=r.class_index correct from (select *, row_number() over (partition by image_id order by p desc, class_index) k from probs) r join embeddings e on e.vec_id=r.image_id where k=1",
    "preds_topk": "select r.image_id, e.label expected_index, case when r.image_id%4=0 then 'negative' else 'positive' end test_type, case when r.image_id%2=0 then 'closeup' else 'wider_trunk' end view_type, r.k, r.class_index, r.p from (select *, row_number() over (partition by image_id order by p desc, class_index) k from probs) r join embeddings e on e.vec_id=r.image_id where k<=3",
    "masks": "select image_id, y, x, case when image_id%50=0 then 0 when v>=128 then 1 else 0 end t, case when v>=140 then 1 else 0 end p from px8",
    "boxes": "select image_id, k, case when k<4 then 'truth' else 'det' end kind, k%2 class_index, ((image_id*37+k*101)%1000)/1e3 score, cx-w/2 x1, cy-h/2 y1, cx+w/2 x2, cy+h/2 y2 from (select image_id, cast(floor((y*8+x)/4) as int) k, 5e-1+max(case when (y*8+x)%4=0 then v end) cx, 5e-1+max(case when (y*8+x)%4=1 then v end) cy, 1e-1+max(case when (y*8+x)%4=2 then abs(v) end) w, 1e-1+max(case when (y*8+x)%4=3 then abs(v) end) h from px group by 1,2) q",
    "label_lines": "select image_id, k, case when k%7=6 then concat(cast(class_index as varchar),' 0.5 0.5') when k%5=4 then concat(cast(class_index as varchar),' 1.5 0.5 0.1 0.1') else concat_ws(' ',cast(class_index as varchar),cast(floor(score*1000)/1e3 as varchar),'0.5','0.25','0.125') end line from boxes",
    "manifest": "select image_id, class_index, concat('IMG_',cast(image_id as varchar)) stem, case when substring(md5(concat('42:',cast(image_id as varchar))),1,1) < 'b' then 'train' when substring(md5(concat('42:',cast(image_id as varchar))),1,1) < 'd' then 'validation' else 'test' end split, concat('g',cast(image_id%100 as varchar)) group_id from img_dims",
    "house": "select p_partkey id, case when p_partkey%5=0 then 'test' else 'train' end part, case when p_partkey%7=0 then null else cast(p_size as double) end size, case when p_partkey%11=0 then null else p_brand end brand, p_retailprice price from part",
    "history": "select cast(day(ts) as int) epoch, round(avg(value),6) metric, round(avg(value*value),6) loss from events group by 1",
    "run_results": "select page_id, page_id%13<>0 read_ok, page_id%13<>0 and page_id%17<>0 saved from pages",
}


def duck(body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Prefix ``body`` with the views it needs, in dependency order."""
    known = {**DUCK, **(extra or {})}
    order: list[str] = []
    open_: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name not in order and name not in open_ and re.search(rf"\b{name}\b", text):
                open_.add(name)
                visit(known[name])
                open_.discard(name)
                order.append(name)

    visit(body)
    if not order:
        return body
    word = "with recursive" if recursive else "with"
    # materialised, so that a view used several times is computed once
    return word + " " + ", ".join(f"{n} as materialized ({known[n]})" for n in order) + " " + body
