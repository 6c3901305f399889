"""Registered source, feature, model, set and streaming queries with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumentab.functions.hashing import to_hex16
from lumentab.functions.numeric import r6
from lumentab.operators import batch as Bt, factors as Fa, features as Fe, joins as J, models as Mo
from lumentab.operators.edges import edge_map
from lumentab.operators.phash import perceptual_hash
from lumentab.operators.stencils import tiles_from_rasters
from lumentab.plans import views as V
from lumentab.plans.sqltext import R, U
from lumentab.plans.views import duck
from lumentab.sources import datasets as Ds, images as I, labels as L, paths as Pa
from lumentab.sources.bitmaps import encode
from lumentab.session import ship_package
from lumentab.sources.folders import run_folder
from lumentab.streaming import frames as St

Q = {}


def query(name, sql=None, **kw):
    def add(fn):
        Q[name] = (fn, duck(sql, **kw) if sql else None)
        return fn

    return add


def clean_url(c):
    return F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"/$", "")


URLS = {"urls": r"select page_id, regexp_replace(regexp_replace(url,'[?#].*$',''),'/$','') path from pages", "files": "select page_id, case when page_id%3=0 then concat(path,'.JPG') when page_id%3=1 then concat(path,'.Tiff') else path end path from urls"}


def files(s, d):
    p = V.table(s, d, "pages").select("page_id", clean_url(F.col("url")).alias("path"))
    k = F.col("page_id") % 3
    return p.withColumn("path", F.when(k == 0, F.concat("path", F.lit(".JPG"))).when(k == 1, F.concat("path", F.lit(".Tiff"))).otherwise(F.col("path")))


@query("S01_image_path_filter", "select page_id, path, lower(regexp_extract(path,'\\.([^./]+)$',1)) ext from files where lower(regexp_extract(path,'\\.([^./]+)$',1)) in ('jpg','jpeg','png','bmp','tif','tiff')", extra=URLS)
def _(s, d):
    return files(s, d).filter(Pa.is_image(F.col("path"))).select("page_id", "path", Pa.extension(F.col("path")).alias("ext")).orderBy("path", "page_id")


@query("S03_path_parts", "select page_id, string_split(path,'/')[-2] class_name, regexp_replace(string_split(path,'/')[-1],'\\.[^.]*$','') stem, cast(nullif(regexp_extract(regexp_replace(string_split(path,'/')[-1],'\\.[^.]*$',''),'[0-9]+'),'') as bigint) number, concat(regexp_replace(string_split(path,'/')[-1],'\\.[^.]*$',''),'_gray.jpg') output_name from files", extra=URLS)
def _(s, d):
    p = F.col("path")
    return files(s, d).select("page_id", Pa.parent_name(p).alias("class_name"), Pa.stem(p).alias("stem"), Pa.image_number(Pa.stem(p)).alias("number"), Pa.output_name(p, "gray").alias("output_name"))


def bitmap(cells) -> bytes:
    """24-bit BMP of an 8 x 8 gray raster."""
    return encode(np.array(cells, float).reshape(8, 8).astype(np.uint8))


def image_folder(s, d) -> str:
    """Image files of the rasters, written by the tasks that hold them; every 13th is cut short.

    Files are opened by the folder's URI, so they land in the shared store it names.
    """
    root = run_folder(s, "images")
    ship_package(s)

    def write(batches):
        import pandas as pd
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(root)
        for b in batches:
            for label in set(b["label"]):
                store.create_dir(f"{place}/class_{label}", recursive=True)
            for i, label, cells in zip(b["image_id"], b["label"], b["cells"]):
                data = bitmap(cells)
                with store.open_output_stream(f"{place}/class_{label}/img_{i}.bmp") as f:
                    f.write(data[:30] if i % 13 == 0 else data)
            yield pd.DataFrame({"n": [len(b)]})

    rows = V.byte_rasters(s, d).join(V.table(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), "label"), "image_id")
    rows.select("image_id", "label", "cells").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return root


def file_number():
    return Pa.image_number(Pa.stem(F.col("path"))).alias("image_id")


@query("S02_image_scan", "select e.vec_id image_id, concat('class_',label) class_name, e.vec_id%13<>0 read_ok, case when e.vec_id%13<>0 then 8 else -1 end width, case when e.vec_id%13<>0 then 3 else -1 end channels from embeddings e")
def _(s, d):
    scan = I.read_images(s, image_folder(s, d))
    return scan.select(file_number(), Pa.parent_name(F.col("path")).alias("class_name"), "read_ok", "width", "channels")


@query("S02_decoded_pixels", "select image_id, y, x, cast(c as int) c, v from px8, range(0,3) r(c) where image_id%13<>0")
def _(s, d):
    return I.image_pixels(I.read_images(s, image_folder(s, d))).select(file_number(), "y", "x", "c", "v")


@query("S04_label_csv", "select cast(doc_id as varchar) id, cast(quality as varchar) label from labels")
def _(s, d):
    path = run_folder(s, "csv")
    V.table(s, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label")).write.csv(path, header=True)
    return L.read_label_csv(s, path)


@query("S05_label_lines", f"""select image_id, k, class_id, {R('cx')} cx, {R('cy')} cy, {R('bw')} bw, {R('bh')} bh, case when n<>5 then 'wrong_field_count' when class_id is null or cx is null or cy is null or bw is null or bh is null then 'not_a_number' when class_id not between 0 and 0 then 'illegal_class' when not (cx between 0 and 1 and cy between 0 and 1 and bw between 0 and 1 and bh between 0 and 1) then 'out_of_range' end reason
 from (select image_id, k, len(p) n, try_cast(p[1] as int) class_id, try_cast(p[2] as double) cx, try_cast(p[3] as double) cy, try_cast(p[4] as double) bw, try_cast(p[5] as double) bh from (select image_id, k, string_split(line,' ') p from label_lines) q) z""")
def _(s, d):
    t = L.parse_label_lines(V.label_lines(s, d), 1)
    return t.select("image_id", "k", "class_id", *[r6(c).alias(c) for c in ("cx", "cy", "bw", "bh")], "reason")


@query("S06_class_map", "select source as name, cast(row_number() over (order by source)-1 as int) idx from (select distinct source from documents) q")
def _(s, d):
    path = run_folder(s, "class-map")
    L.write_class_map(J.class_map(V.table(s, d, "documents"), "source").withColumnRenamed("source", "name"), path)
    return L.read_class_map(s, path)


@query("S06_class_map_check", "select unnest(['empty','starts_at_zero','contiguous','repeated_index','repeated_name']) \"check\", unnest([0,0,1,0,0])::bigint violations from (select count(*) c from documents)")
def _(s, d):
    m = J.class_map(V.table(s, d, "documents"), "source").withColumnRenamed("source", "name")
    # a gap before the last class is put in, which the check must find
    top = m.agg(F.max("idx"))
    return J.class_map_problems(m.withColumn("idx", F.when(F.col("idx") == top.scalar(), F.col("idx") + 5).otherwise(F.col("idx"))))


@query("S07_pixel_table", f"select image_id, y, x, 0 c, {R('v')} v from px")
def _(s, d):
    t = I.pixels_of_arrays(V.table(s, d, "embeddings").withColumnRenamed("vec_id", "image_id"), "image_id", "embedding", 8)
    return t.select("image_id", "y", "x", "c", r6("v").alias("v"))


@query("S08_csv_json_sinks", f"select fmt, o_orderkey, o_orderstatus, {R('o_totalprice')} o_totalprice from orders, (select unnest(['csv','json']) fmt) f")
def _(s, d):
    o = V.table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    root = run_folder(s, "sinks")
    o.write.csv(f"{root}/csv", header=True)
    o.write.json(f"{root}/json")
    schema = "o_orderkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE"
    back = s.read.csv(f"{root}/csv", header=True, schema=schema).withColumn("fmt", F.lit("csv"))
    back = back.unionByName(s.read.json(f"{root}/json", schema=schema).withColumn("fmt", F.lit("json")))
    return back.select("fmt", "o_orderkey", "o_orderstatus", r6("o_totalprice").alias("o_totalprice"))


@query("S08_partitioned_manifest", "select image_id, class_index, group_id, split from manifest where split='validation'")
def _(s, d):
    path = run_folder(s, "manifest")
    L.write_manifest(V.manifest(s, d).select("image_id", "class_index", "group_id", "split"), path)
    return s.read.parquet(path).filter("split = 'validation'").select("image_id", "class_index", "group_id", "split")


@query("S11_array_round_trip", f"select vec_id, cast(i-1 as int) i, {R('embedding[i]')} a, {R('embedding[i]*2')} b from embeddings, range(1,65) r(i)")
def _(s, d):
    path = run_folder(s, "arrays")
    e = V.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    e.select("vec_id", F.array("v").alias("as_list"), F.create_map(F.lit("a"), F.col("v"), F.lit("b"), F.transform("v", lambda x: x * 2)).alias("as_map")).write.parquet(path)
    back = s.read.parquet(path)
    return back.select("vec_id", F.posexplode(F.arrays_zip(F.col("as_list")[0].alias("l"), F.col("as_map")["b"].alias("m"))).alias("i", "z")).select("vec_id", "i", r6(F.col("z.l")).alias("a"), r6(F.col("z.m")).alias("b"))


@query("A28_run_summary", "select count(*) total, count(*) filter (where saved) saved, count(*) filter (where not read_ok) read_failed, count(*) filter (where read_ok and not saved) write_failed from run_results")
def _(s, d):
    return Bt.run_summary(V.run_results(s, d))


@query("A28_run_status", "select page_id, case when not read_ok then 'read_failed' when not saved then 'write_failed' else 'saved' end status from run_results")
def _(s, d):
    return Bt.run_status(V.run_results(s, d)).select("page_id", "status")


OPS = {"names": "select page_id, case page_id%5 when 0 then 'gray' when 1 then 'blur' when 2 then 'edge' when 3 then 'Gray' else 'sharpen' end op from pages"}


@query("X13_operation_name", "select page_id, op, case op when 'gray' then 0 when 'blur' then 1 when 'edge' then 2 end code from names", extra=OPS)
def _(s, d):
    k = F.col("page_id") % 5
    op = F.when(k == 0, "gray").when(k == 1, "blur").when(k == 2, "edge").when(k == 3, "Gray").otherwise("sharpen")
    return V.table(s, d, "pages").select("page_id", op.alias("op"), Bt.parse_operation(op).alias("code"))


@query("X11_url_decode", "select page_id, case when instr(link,'File:')>0 then url_decode(split_part(link,'File:',2)) end title from (select page_id, case when page_id%4=0 then url else concat('http://wiki/File:',replace(replace(replace(url,'%','%25'),'/','%2F'),':','%3A'),'+a%20b') end link from pages) q")
def _(s, d):
    enc = F.col("url")
    for a, b in (("%", "%25"), ("/", "%2F"), (":", "%3A")):
        enc = F.replace(enc, F.lit(a), F.lit(b))
    link = F.when(F.col("page_id") % 4 == 0, F.col("url")).otherwise(F.concat(F.lit("http://wiki/File:"), enc, F.lit("+a%20b")))
    return V.table(s, d, "pages").select("page_id", Pa.decoded_title(link).alias("title"))


@query("X12_json_record", "select event_id, cast(json_extract(props,'$.k') as int) k from events")
def _(s, d):
    return V.table(s, d, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


@query("X12_nested_history", "select epoch, metric, loss from history")
def _(s, d):
    # a history file holds parallel lists inside one JSON record; days bound its length
    h = V.history(s, d)
    lists = h.agg(F.sort_array(F.collect_list(F.struct("epoch", "metric", "loss"))).alias("r")).select(
        F.to_json(F.struct(F.col("r.epoch").alias("epoch"), F.struct(F.col("r.metric").alias("metric"), F.col("r.loss").alias("loss")).alias("validation"))).alias("js")
    )
    parsed = lists.select(F.from_json("js", "epoch ARRAY<INT>, validation STRUCT<metric ARRAY<DOUBLE>, loss ARRAY<DOUBLE>>").alias("j"))
    z = parsed.select(F.explode(F.arrays_zip(F.col("j.epoch").alias("epoch"), F.col("j.validation.metric").alias("metric"), F.col("j.validation.loss").alias("loss"))).alias("z"))
    return z.select("z.*")


@query("U01_row_concat", f"select 'first' src, i, j, {R('v')} v from mat union all select 'second', i+(select max(i)+1 from mat), j, {R('v*2')} from mat")
def _(s, d):
    m = V.mat(s, d)
    n = m.agg(F.max("i") + 1)
    two = m.select(F.lit("second").alias("src"), (F.col("i") + n.scalar()).alias("i"), "j", (F.col("v") * 2).alias("v"))
    return m.select(F.lit("first").alias("src"), "i", "j", "v").unionByName(two).withColumn("v", r6("v"))


@query("U02_column_concat", f"select i, j, {R('v')} v from mat union all select i, j+64, {R('v*2')} from mat")
def _(s, d):
    m = V.mat(s, d)
    return m.unionByName(m.select("i", (F.col("j") + 64).alias("j"), (F.col("v") * 2).alias("v"))).withColumn("v", r6("v"))


@query("U04_set_difference", "select 'no_label' side, doc_id from (select doc_id from documents except select doc_id from labels) a union all select 'no_document', doc_id from (select doc_id from labels except select doc_id from documents) b")
def _(s, d):
    docs, labels = V.table(s, d, "documents"), V.table(s, d, "labels").select("doc_id")
    a = docs.select("doc_id").subtract(labels).withColumn("side", F.lit("no_label"))
    b = labels.subtract(docs.select("doc_id")).withColumn("side", F.lit("no_document"))
    return a.unionByName(b)


@query("F01_mean_imputation", f"select id, {R('coalesce(size,(select avg(size) from house))')} size, {R('price')} price from house")
def _(s, d):
    return Fe.impute_means(V.house(s, d), ["size", "price"]).select("id", r6("size").alias("size"), r6("price").alias("price"))


BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query("F02_one_hot", "select id, " + ", ".join(f"case when brand='{b}' then 1 else 0 end \"brand_{b}\"" for b in BRANDS) + ", case when brand is null then 1 else 0 end brand_nan, case when part='test' then 1 else 0 end part_test, case when part='train' then 1 else 0 end part_train, 0 part_nan from house")
def _(s, d):
    h = V.house(s, d).select("id", "brand", "part")
    return Fe.one_hot(h, Fe.text_columns(h))


@query("F03_standardise", f"select id, {R('coalesce((size-ms)/ss,0)')} size, {R('coalesce((price-mp)/sp,0)')} price from house, (select avg(size) ms, stddev_samp(size) ss, avg(price) mp, stddev_samp(price) sp from house) q")
def _(s, d):
    return Fe.standardise(V.house(s, d), ["size", "price"]).select("id", r6("size").alias("size"), r6("price").alias("price"))


@query("F04_numeric_columns", "select unnest(['brand','id','part','price','size']) column_name, unnest(['text','numeric','text','numeric','numeric']) kind, unnest(range(0,5))*0+(select count(*) from part) n_rows")
def _(s, d):
    h = V.house(s, d)
    kinds = [(c, "numeric") for c in Fe.numeric_columns(h)] + [(c, "text") for c in Fe.text_columns(h)]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind")) for c, k in kinds])
    return h.agg(F.count("*").alias("n_rows")).select(F.explode(rows).alias("r"), "n_rows").select("r.*", "n_rows")


@query("F05_polynomial_features", f"select id, cast(i as int) i, {R('pow(x,i)/factorial(i::int)')} v from (select id, size/25-1 x from house) q, range(0,6) r(i)")
def _(s, d):
    h = V.house(s, d).withColumn("x", F.col("size") / 25 - 1)
    return h.select("id", F.posexplode(Fe.polynomial(F.col("x"), 5)).alias("i", "v")).select("id", "i", r6("v").alias("v"))


@query("F06_feature_label_split", f"select part, brand, size, {R('price')} label from house")
def _(s, d):
    return V.house(s, d).select("part", "brand", "size", r6("price").alias("label"))


def normal_sql(seed, key):
    return f"sqrt(-2*ln(greatest({U(seed + ':a', key)},1e-12)))*cos(2*pi()*{U(seed + ':b', key)})"


SYN = {"syn": f"select id, x0, x1, x0*2+x1*-34e-1+42e-1+{normal_sql('9:noise', 'id')}*1e-2 y from (select p_partkey id, {normal_sql('9:x0', 'p_partkey')} x0, {normal_sql('9:x1', 'p_partkey')} x1 from part) q"}


def synthetic(s, d):
    return Fe.synthetic_linear(V.table(s, d, "part").select(F.col("p_partkey").alias("id")), "id", [2.0, -3.4], 4.2, 0.01, 9)


@query("F08_synthetic_linear", f"select id, {R('x0')} x0, {R('x1')} x1, {R('y')} y from syn", extra=SYN)
def _(s, d):
    return synthetic(s, d).select("id", *[r6(c).alias(c) for c in ("x0", "x1", "y")])


@query("L01_one_feature_line", f"select {R('regr_slope(y,x1)')} slope, {R('regr_intercept(y,x1)')} \"intercept\" from syn", extra=SYN)
def _(s, d):
    t = Mo.linear_fit(Mo.assemble(synthetic(s, d), ["x1"]), "y")
    line = s.createDataFrame([(float(t.coefficients[0]), float(t.intercept))], "slope double, intercept double")
    return line.select(r6("slope").alias("slope"), r6("intercept").alias("intercept"))


RIDGE = {
    **SYN,
    "moments": "select var_pop(x0) v0, var_pop(x1) v1, covar_pop(x0,x1) c, covar_pop(x0,y) c0, covar_pop(x1,y) c1, avg(x0) m0, avg(x1) m1, avg(y) my from syn",
    "solved": "select *, (c0*(v1+l)-c1*c)/((v0+l)*(v1+l)-c*c) w0, (c1*(v0+l)-c0*c)/((v0+l)*(v1+l)-c*c) w1 from moments, (select unnest([0e0,3e0,5e0]) l) q",
    "lines": "select *, my-w0*m0-w1*m1 bias from solved",
}


@query("L01_linear_regression", f"select {R('w0')} w0, {R('w1')} w1, {R('bias')} bias from lines where l=0", extra=RIDGE)
def _(s, d):
    t = Mo.linear_fit(Mo.assemble(synthetic(s, d), ["x0", "x1"]), "y")
    line = s.createDataFrame([(float(t.coefficients[0]), float(t.coefficients[1]), float(t.intercept))], "w0 double, w1 double, bias double")
    return line.select(*[r6(c).alias(c) for c in ("w0", "w1", "bias")])


@query("L02_ridge_sweep", f"select l penalty, {R('sqrt(w0*w0+w1*w1)')} weight_norm, {R('bias')} \"intercept\", {R('avg((y-w0*x0-w1*x1-bias)*(y-w0*x0-w1*x1-bias))')} mse from syn, lines group by l, w0, w1, bias", extra=RIDGE)
def _(s, d):
    t = Fa.ridge_sweep(synthetic(s, d), "y", ["x0", "x1"], [0.0, 3.0, 5.0])
    return t.select("penalty", *[r6(c).alias(c) for c in ("weight_norm", "intercept", "mse")])


def vectors(s, d):
    return V.table(s, d, "embeddings").select(F.col("label").cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


@query("L03_softmax_regression")
def _(s, d):
    model, data = Mo.softmax_regression(vectors(s, d), 20)
    return Mo.accuracy(model, data)


@query("L04_perceptron")
def _(s, d):
    model, data = Mo.perceptron(vectors(s, d), 64, 32, 10, 20)
    return Mo.accuracy(model, data)


FOLDS = {
    "scaled": "select id, price, coalesce((size-(select avg(size) from house))/(select stddev_samp(size) from house),0) z from house",
    "blocks": "select *, (row_number() over (order by id)-1)//(count(*) over ()//5) block from scaled",
    "folds": "select *, cast(f as int) fold, case when block=f then 'valid' else 'train' end part from blocks, range(0,5) t(f) where block<5",
    "fits": "select fold, regr_slope(price,z) a, regr_intercept(price,z) b from folds where part='train' group by 1",
}


@query("L09_k_fold_log_rmse", f"select fold, part, {R('sqrt(avg(pow(ln(greatest(a*z+b,1))-ln(price),2)))')} log_rmse from folds join fits using (fold) group by 1,2", extra=FOLDS)
def _(s, d):
    h = Fe.standardise(V.house(s, d), ["size"])
    return Fa.k_fold_log_rmse(h, "id", "price", ["size"], 5).select("fold", "part", r6("log_rmse").alias("log_rmse"))


def cubic(s, d):
    """Noisy cubic of the first synthetic feature, even ids to train on, and 20 scaled powers."""
    syn = synthetic(s, d).withColumn("part", F.when(F.col("id") % 2 == 0, "train").otherwise("test"))
    p = syn.withColumn("poly", Fe.polynomial(F.col("x0"), 19))
    terms = [5.0, 1.2, -3.4, 5.6]
    return p.withColumn("t", sum((F.col("poly")[i] * w for i, w in enumerate(terms)), F.lit(0.0)) + Fe.gaussian("9:e", "id") * 0.1)


@query("L10_fit_complexity")
def _(s, d):
    return Fa.nested_fits(cubic(s, d), "t", [1, 3, 19])


def residual(column, onto):
    """``column`` less its projections on the earlier columns, over the training rows."""
    return f"{column}" + "".join(f"-{z}*(select sum(({column})*{z})/sum({z}*{z}) from {source} where tr)" for z, source in onto)


LOW = {
    **SYN,
    "base": f"select id%2=0 tr, 1e0 z0, x0 x, 5+12e-1*x0-34e-1*x0*x0/2+56e-1*x0*x0*x0/6+sqrt(-2*ln(greatest({U('9:e:a', 'id')},1e-12)))*cos(2*pi()*{U('9:e:b', 'id')})*1e-1 t from syn",
    "one": f"select *, {residual('x', [('z0', 'base')])} z1 from base",
    "two": f"select *, {residual('x*x', [('z0', 'one'), ('z1', 'one')])} z2 from one",
    "three": f"select *, {residual('x*x*x', [('z0', 'two'), ('z1', 'two'), ('z2', 'two')])} z3 from two",
    "off": f"select tr, {residual('t', [('z0', 'three'), ('z1', 'three')])} e1, {residual('t', [(f'z{k}', 'three') for k in range(4)])} e3 from three",
}


@query("L10_low_degrees", f"select 1 degree, {R('avg(e1*e1) filter (tr)')} train_mse, {R('avg(e1*e1) filter (not tr)')} test_mse from off union all select 3, {R('avg(e3*e3) filter (tr)')}, {R('avg(e3*e3) filter (not tr)')} from off", extra=LOW)
def _(s, d):
    return Fa.nested_fits(cubic(s, d), "t", [1, 3]).select("degree", r6("train_mse").alias("train_mse"), r6("test_mse").alias("test_mse"))


EDGES = {
    "sob": "select p.image_id, p.y, p.x, sum(s.v*kx)::double gx, sum(s.v*ky)::double gy from px8 p cross join (values (-1,-1,-1,-1),(-1,0,0,-2),(-1,1,1,-1),(0,-1,-2,0),(0,1,2,0),(1,-1,-1,1),(1,0,0,2),(1,1,1,1)) k(dy,dx,kx,ky) join px8 s on s.image_id=p.image_id and s.y=(case when abs(p.y+dy)>7 then 14-abs(p.y+dy) else abs(p.y+dy) end) and s.x=(case when abs(p.x+dx)>7 then 14-abs(p.x+dx) else abs(p.x+dx) end) group by 1,2,3",
    "mag": "select *, abs(gx)+abs(gy) m from sob",
    "dirs": "select *, case when abs(gy)<=abs(gx)*0.41421356237309503::double then 0 when abs(gx)<=abs(gy)*0.41421356237309503::double then 1 when gx*gy>0 then 2 else 3 end dr from mag",
    "ridge": "select d.image_id, d.y, d.x, d.m, d.m>160 strong from dirs d left join mag a on a.image_id=d.image_id and a.y=d.y-(case dr when 0 then 0 else 1 end) and a.x=d.x-(case dr when 0 then 1 when 1 then 0 when 2 then 1 else -1 end) left join mag b on b.image_id=d.image_id and b.y=d.y+(case dr when 0 then 0 else 1 end) and b.x=d.x+(case dr when 0 then 1 when 1 then 0 when 2 then 1 else -1 end) where d.m>80 and d.m>coalesce(a.m,0) and d.m>=coalesce(b.m,0)",
    "hyst": "select image_id, y, x from ridge where strong union select r.image_id, r.y, r.x from hyst h join ridge r on r.image_id=h.image_id and abs(r.y-h.y)<=1 and abs(r.x-h.x)<=1",
}


@query("W14_edge_map", "select image_id, y, x from hyst", recursive=True, extra=EDGES)
def _(s, d):
    return edge_map(tiles_from_rasters(V.byte_rasters(s, d)), 80.0, 160.0)


COS = {
    "cosines": "select u, n, sqrt((case when u=0 then 1 else 2 end)/32e0)*cos(pi()*(2*n+1)*u/64e0) c from range(0,8) a(u), range(0,32) b(n)",
    "half": "select image_id, u, n x, sum(c.c*p.v) v from (select image_id, y, x, v from px) p join (select u, n k, c from cosines) c on p.y=c.k//4 cross join (select 0) z join range(0,8) q(n) on n=p.x group by 1,2,3",
    "dct": "select image_id, u, w.u2 w, sum(h.v*w.c) v from half h join (select u u2, n k, c from cosines) w on h.x=w.k//4 group by 1,2,3",
    "meds": "select image_id, quantile_cont(v,5e-1) m from dct where u+w>0 group by 1",
}


@query("W16_dct_hash", "select image_id, lower(printf('%08x%08x', (h>>32)&4294967295, h&4294967295)) phash from (select d.image_id, cast(bit_or(case when v>m then (case when u+w=0 then (-9223372036854775808)::bigint else cast(1 as bigint)<<(63-(u*8+w)) end) else 0::bigint end) as bigint) h from dct d join meds using (image_id) group by 1) q", extra=COS)
def _(s, d):
    r = V.rasters(s, d)
    big = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda p: F.get("cells", (F.floor(F.floor(p / 32) / 4) * 8 + F.floor((p % 32) / 4)).cast("int")))
    return r.select("image_id", big.alias("big")).select("image_id", to_hex16(perceptual_hash(F.col("big"))).alias("phash"))


@query("dataset_split_reader", f"select m.image_id, m.class_index, {R('avg(p.v)')} mean_v from manifest m join px p on p.image_id=m.image_id where m.split='test' group by 1,2")
def _(s, d):
    path = run_folder(s, "dataset")
    m = V.manifest(s, d).withColumn("class_name", F.format_string("class_%02d", "class_index"))
    L.write_manifest(m.select("image_id", "class_name", "class_index", "split"), path)
    mapping = J.class_map(m, "class_name")
    rows = Ds.load_split(s, path, "test", V.rasters(s, d), mapping, "image_id", "class_name", "class_index")
    mean = F.aggregate("cells", F.lit(0.0), lambda acc, v: acc + v) / F.size("cells")
    return rows.select("image_id", "class_index", r6(mean).alias("mean_v"))


@query("scorer_hook", f"select vec_id, {R('s')} score from (select vec_id, sum(cast(embedding[i] as double)*i) s from embeddings, range(1,65) r(i) group by 1) q")
def _(s, d):
    def linear(batch):
        import numpy as np
        import pandas as pd

        m = np.stack(batch["v"].to_numpy()) if len(batch) else np.zeros((0, 64))
        return pd.DataFrame({"vec_id": batch["vec_id"], "score": m @ np.arange(1.0, 65.0)})

    e = V.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return I.score_in_batches(e, linear, "vec_id long, score double").select("vec_id", r6("score").alias("score"))


def stream(s, d):
    return St.frame_stream(s, d, V.table(s, d, "events").schema, "events.parquet")


@query("ST1_frame_transform", f"select event_id, user_id, {R('255-least(255,value)')} v from events")
def _(s, d):
    t = stream(s, d).select("event_id", "user_id", (F.lit(255.0) - F.least(F.lit(255.0), "value")).alias("v"))
    return St.drain(t, "st1").select("event_id", "user_id", r6("v").alias("v"))


@query("ST2_frame_rate", f"select time_bucket(interval '1 hour', ts) window_start, count(*) frames, {R('count(*)/3600e0')} fps from events group by 1")
def _(s, d):
    # four files arrive in turn, and one row in 97 with the file after its own
    e = V.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))  # the session's zone is UTC
    week = F.least(F.expr("(dayofmonth(ts) - 1) div 8"), F.lit(3))
    week = F.when(F.col("event_id") % 97 == 0, F.least(week + 1, F.lit(3))).otherwise(week)
    folder = St.arriving(e.select("ts", "event_id"), [week == k for k in range(4)], "st2-files")
    counted = St.frame_counts(St.frame_stream(s, folder, "ts timestamp, event_id bigint", "*.parquet"), "ts", 3600, 7200, "st2")
    t = St.frame_rate(counted, 3600)
    return t.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "frames", r6("fps").alias("fps"))


RUNS = {
    "runs": "select event_type as run, cast(day(ts) as int) epoch, round(avg(value),6) metric from events group by 1,2",
    "steps": "select *, row_number() over (partition by run order by epoch) step, max(metric) over (partition by run order by epoch rows between unbounded preceding and 1 preceding) prior from runs",
    "waits": "select *, step-max(case when prior is null or metric>prior then step end) over (partition by run order by epoch rows between unbounded preceding and current row) waited from steps",
    "seen": "select w.*, stop_step from waits w join (select run, min(step) filter (where waited>=4) stop_step from waits group by run) q on w.run=q.run where stop_step is null or step<=stop_step",
}


@query("A34_best_epoch_stream", "select run, arg_max(epoch, (metric, -epoch)) best_epoch, max(metric) best_metric, max(epoch) filter (where step=stop_step) stop_epoch, count(*) epochs_run from seen group by run", extra=RUNS)
def _(s, d):
    e = V.table(s, d, "events")
    runs = e.groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("metric"))
    folder = St.arriving(runs, [F.col("epoch") <= 10, F.col("epoch").between(11, 20), F.col("epoch") > 20], "a34-files")
    t = St.early_stops(St.frame_stream(s, folder, runs.schema, "*.parquet"), "run", 4)
    return St.drain_updates(t, ["run"], "a34")


@query("ST3_running_accumulators", f"select event_type, count(*) n, {R('sum(value)')} total, count(*) filter (where value>50) hits from events group by 1")
def _(s, d):
    t = St.accumulators(stream(s, d), ["event_type"], {"n": F.count("*"), "total": F.sum("value"), "hits": F.count(F.when(F.col("value") > 50, 1))})
    return St.drain_updates(t, ["event_type"], "st3").select("event_type", "n", r6("total").alias("total"), "hits")


@query("ST4_score_filter", f"select event_id, {R('value')} v from events where value>120")
def _(s, d):
    return St.drain(St.above_score(stream(s, d), "value", 120.0).select("event_id", "value"), "st4").select("event_id", r6("value").alias("v"))


@query("ST5_file_ingest", "select vec_id image_id, vec_id%13<>0 read_ok, case when vec_id%13<>0 then 8 else -1 end width from embeddings")
def _(s, d):
    t = St.image_stream(s, image_folder(s, d)).select("path", "read_ok", "width")
    return St.drain(t, "st5").select(file_number(), "read_ok", "width")
