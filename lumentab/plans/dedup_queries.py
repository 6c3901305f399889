"""Registered duplicate, grouping, split and join queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentab.functions.hashing import coefficient_bits, fold_bits, from_hex16, hamming, to_hex16
from lumentab.functions.numeric import r6
from lumentab.operators import dedup as D, joins as J, splits as S
from lumentab.plans import views as V
from lumentab.plans.sqltext import R
from lumentab.plans.views import duck

Q = {}


def query(name, sql=None, **kw):
    def add(fn):
        Q[name] = (fn, duck(sql, **kw) if sql else None)
        return fn

    return add


def docs(s, d):
    """doc_id, label (source) and digest of the whole text."""
    return V.table(s, d, "documents").select("doc_id", F.col("source").alias("label"), F.sha2("text", 256).alias("digest"))


DOCS = {
    "docs": "select doc_id, source as label, sha256(text) digest from documents",
    "dgroups": "select digest, count(*) items, list_sort(list(distinct label)) classes, count(distinct label)>1 cross_class from docs group by 1 having count(*)>=2",
    "numbered": "select *, row_number() over (order by digest) group_number from dgroups",
    "conflicts": "select d.doc_id, d.label, d.digest, n.group_number from docs d join numbered n on d.digest=n.digest where n.cross_class",
}


@query("A07_duplicate_groups", "select digest, items, array_to_string(classes,',') classes, cross_class from dgroups", extra=DOCS)
def _(s, d):
    return D.duplicate_groups(docs(s, d)).withColumn("classes", F.array_join("classes", ","))


@query("A07_duplicate_summary", """select (select count(*) from docs) total_items, (select count(distinct digest) from docs) unique_digests, count(*) duplicate_groups, sum(items)::bigint duplicate_items, sum(items-1)::bigint removable_copies, count(*) filter (where not cross_class) same_class_groups, count(*) filter (where cross_class) cross_class_groups from dgroups""", extra=DOCS)
def _(s, d):
    return D.duplicate_summary(docs(s, d))


@query("A08_conflict_report", "select group_number, digest, label, doc_id from conflicts", extra=DOCS)
def _(s, d):
    return D.conflict_members(docs(s, d), numbered=True).select("group_number", "digest", "label", "doc_id")


@query("A09_exclusion_manifest", f"select doc_id, label, digest, '{D.REASON}' reason, '{D.ACTION}' \"action\", true key_unique from conflicts", extra=DOCS)
def _(s, d):
    ex = D.exclusions(D.conflict_members(docs(s, d)), "doc_id")
    unique = ex.agg(F.count("*") == F.count_distinct("doc_id"))
    return ex.withColumn("key_unique", unique.scalar())


@query("J01_label_lookup", "select d.doc_id, source, quality, toxic from documents d join labels l on d.doc_id=l.doc_id")
def _(s, d):
    return V.table(s, d, "documents").select("doc_id", "source").join(V.table(s, d, "labels"), "doc_id")


@query("J02_exclusion_anti_join", "select doc_id, label from docs where doc_id not in (select doc_id from conflicts)", extra=DOCS)
def _(s, d):
    ex = D.exclusions(D.conflict_members(docs(s, d)), "doc_id")
    return J.without(docs(s, d), ex, "doc_id").select("doc_id", "label")


@query("J03_pairing_audit", "select split, count(*) filter (where i is not null) items, count(*) filter (where l is not null) labels, count(*) filter (where l is null) missing_labels, count(*) filter (where i is null) extra_labels from (select coalesce(a.lang,'none') split, a.doc_id i, b.doc_id l from documents a full join (select doc_id from labels where toxic=0 union all select doc_id+1000000 from labels where toxic=1) b on a.doc_id=b.doc_id) q group by 1")
def _(s, d):
    lab = V.table(s, d, "labels")
    # toxic labels are moved off their documents, so both directions occur
    lab = lab.select(F.when(F.col("toxic") == 1, F.col("doc_id") + 1000000).otherwise(F.col("doc_id")).alias("doc_id"))
    items = V.table(s, d, "documents").select("doc_id", F.col("lang").alias("split"))
    return J.pairing_audit(items, lab, "doc_id", "split")


@query("J04_membership", "select o_orderkey, o_custkey, 'known' status from orders where o_custkey in (select c_custkey from customer where c_acctbal>0) union all select o_orderkey, o_custkey, 'unknown' from orders where o_custkey not in (select c_custkey from customer where c_acctbal>0)")
def _(s, d):
    o = V.table(s, d, "orders").select("o_orderkey", "o_custkey")
    known = V.table(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return J.membership(o, known, "o_custkey")


PAIRS = {
    "img_pairs": "select a.image_id first_image, a.class_index first_class, b.image_id second_image, b.class_index second_class, bit_count(xor(a.phash,b.phash))::int phash_distance, bit_count(xor(a.dhash,b.dhash))::int dhash_distance, a.class_index=b.class_index same_class, a.phash p1, a.dhash d1, b.phash p2, b.dhash d2 from hashes a join hashes b on a.image_id<b.image_id where bit_count(xor(a.phash,b.phash))<=6 and bit_count(xor(a.dhash,b.dhash))<=6",
    "codes": "select phash, dhash, min(image_id) code_id, count(*) n from hashes group by 1,2",
    "code_rows": "select least(x.code_id,y.code_id) first_id, greatest(x.code_id,y.code_id) second_id, phash_distance, dhash_distance, case when x.code_id<=y.code_id then x.n else y.n end first_n, case when x.code_id<=y.code_id then y.n else x.n end second_n, count(*) pairs, count(*) filter (where same_class) same_class_pairs from img_pairs p join codes x on p.p1=x.phash and p.d1=x.dhash join codes y on p.p2=y.phash and p.d2=y.dhash group by 1,2,3,4,5,6",
    "reach": "select image_id id, image_id lab from hashes union select case when r.id=p.first_image then p.second_image else p.first_image end, r.lab from reach r join img_pairs p on r.id=p.first_image or r.id=p.second_image",
    "comps": "select image_id, class_index, component from hashes join (select id, min(lab) component from reach group by 1) q on image_id=id",
    "gsizes": "select component, count(*) group_size from comps group by 1",
    "gnames": "select *, printf('group_%04d', row_number() over (order by group_size desc, component)) group_id from gsizes",
    "groups": "select image_id, class_index, group_id, group_size, group_size>1 is_similarity_group from comps join gnames using (component)",
    "owners": "select group_id, arg_min(class_index, image_id) class_index, count(*) group_size from groups group by 1",
    "ranked": "select *, row_number() over (partition by class_index order by group_size desc, md5(concat_ws(':','42',cast(class_index as varchar),group_id)), group_id) r, sum(group_size) over (partition by class_index) total from owners",
    "walk": """select class_index, r, group_id, group_size, total, case r when 1 then 'train' end split, group_size::double a, 0::double b, 0::double c from ranked where r=1
      union all select k.class_index, k.r, k.group_id, k.group_size, k.total, s.split, w.a+case s.split when 'train' then k.group_size else 0 end, w.b+case s.split when 'validation' then k.group_size else 0 end, w.c+case s.split when 'test' then k.group_size else 0 end
      from walk w join ranked k on k.class_index=w.class_index and k.r=w.r+1, lateral (select case when k.r=2 then 'validation' when k.r=3 then 'test'
        when (k.total*7e-1-w.a > k.total*15e-2-w.b or (k.total*7e-1-w.a = k.total*15e-2-w.b and w.a<=w.b)) and (k.total*7e-1-w.a > k.total*15e-2-w.c or (k.total*7e-1-w.a = k.total*15e-2-w.c and w.a<=w.c)) then 'train'
        when k.total*15e-2-w.b > k.total*15e-2-w.c or (k.total*15e-2-w.b = k.total*15e-2-w.c and w.b<=w.c) then 'validation' else 'test' end split) s""",
}


def pair_query(name, sql):
    return query(name, sql, extra=PAIRS, recursive=True)


@pair_query("J05_near_duplicate_pairs", "select first_id, second_id, phash_distance, dhash_distance, first_n, second_n, pairs, same_class_pairs from code_rows")
def _(s, d):
    return D.near_duplicates(V.hashes(s, d))


@pair_query("A10_near_duplicate_summary", "select (select count(*) from hashes) eligible_images, (select count(*)*(count(*)-1)//2 from hashes) possible_pairs, count(*) candidate_pairs, count(*) filter (where same_class) same_class_pairs, count(*) filter (where not same_class) cross_class_pairs from img_pairs")
def _(s, d):
    h = V.hashes(s, d)
    return D.near_summary(D.near_duplicates(h), h)


@pair_query("K07_closest_pairs", "select first_image, first_class, second_image, second_class, phash_distance, dhash_distance, same_class from img_pairs order by same_class, phash_distance+dhash_distance, phash_distance, first_image, second_image limit 40")
def _(s, d):
    return D.closest_pairs(V.hashes(s, d), 40)


def groups(s, d):
    return D.similarity_groups(D.similarity_components(V.hashes(s, d)))


@pair_query("G01_components", "select image_id, class_index, component from comps")
def _(s, d):
    return D.similarity_components(V.hashes(s, d))


@pair_query("G02_similarity_groups", "select image_id, class_index, group_id, group_size, is_similarity_group from groups")
def _(s, d):
    return groups(s, d)


@pair_query("A11_group_sizes", "select group_size, count(*) groups, count(*) filter (where cross_class) cross_class_groups from (select group_id, group_size, count(distinct class_index)>1 cross_class from groups group by 1,2) q group by 1")
def _(s, d):
    return D.group_size_report(groups(s, d))


@pair_query("G03_grouped_split", "select g.image_id, g.class_index, g.group_id, g.group_size, w.split from groups g join walk w on g.group_id=w.group_id")
def _(s, d):
    return D.split_manifest(V.hashes(s, d), 42)


@pair_query("G04_split_violations", "select 'group_in_two_classes' violation, group_id \"key\", count(distinct class_index) n from groups group by 2 having count(distinct class_index)>1 union all select 'class_with_few_groups', cast(class_index as varchar), count(distinct group_id) from groups group by 2 having count(distinct group_id)<3")
def _(s, d):
    return S.split_violations(groups(s, d))


@query("A12_split_summary", f"select class_index, train, validation, test, total, {R('train/total')} train_ratio, {R('validation/total')} validation_ratio, {R('test/total')} test_ratio from (select class_index, count(*) filter (where split='train') train, count(*) filter (where split='validation') validation, count(*) filter (where split='test') test, count(*) total from manifest group by grouping sets ((class_index),())) q")
def _(s, d):
    t = S.split_summary(V.manifest(s, d))
    return t.select("class_index", *S.SPLITS, "total", *[r6(f"{c}_ratio").alias(f"{c}_ratio") for c in S.SPLITS])


@query("A12_groups_per_split", "select split, count(*) images, count(distinct group_id) groups from manifest group by 1")
def _(s, d):
    return S.groups_per_split(V.manifest(s, d))


@query("A13_leakage_audit", "select 'group_in_several_splits' finding, group_id \"key\", count(distinct split) n from manifest group by 2 having count(distinct split)>1 union all select 'class_misses_split', cast(class_index as varchar), count(distinct split) from manifest group by 2 having count(distinct split)<3 union all select 'repeated_key', cast(image_id as varchar), count(*) from manifest group by 2 having count(*)>1")
def _(s, d):
    return S.leakage_audit(V.manifest(s, d), "image_id")


@query("J07_label_index_check", "select doc_id, source, claimed, idx from (select doc_id, source, cast(doc_id%20 as int) claimed, cast(dense_rank() over (order by source)-1 as int) idx from documents) q where claimed<>idx")
def _(s, d):
    t = V.table(s, d, "documents").select("doc_id", "source", (F.col("doc_id") % 20).cast("int").alias("claimed"))
    return J.index_mismatches(t, J.class_map(t, "source"), "source", "claimed")


@query("J08_adjacent_cross_split", "select class_index, stem first_path, split first_split, s2 second_path, sp2 second_split, n2-number number_gap from (select *, lead(stem) over w s2, lead(split) over w sp2, lead(number) over w n2 from (select *, cast(nullif(regexp_extract(stem,'[0-9]+'),'') as bigint) number from manifest) a window w as (partition by class_index order by number, stem)) q where n2-number<=2 and sp2<>split")
def _(s, d):
    from lumentab.sources.paths import image_number

    m = V.manifest(s, d).withColumn("number", image_number(F.col("stem")))
    return S.adjacent_across_splits(m, 2, ["number", "stem"])


@query("J09_metric_cross_check", f"""select a.metric, {R('a.value')} value, {R('b.value')} recorded, abs(a.value-b.value)<1e-9 agrees from
 (select 'accuracy' metric, avg(case when correct then 1e0 else 0 end) value from preds union all select 'images', count(*) from preds union all select 'mean_confidence', avg(confidence) from preds) a join
 (select 'accuracy' metric, sum(k)/sum(n) value from (select count(*) n, count(*) filter (where correct) k from preds group by true_index) q union all select 'images', sum(n) from (select count(*) n from preds group by true_index) q union all select 'mean_confidence', sum(c)/sum(n)+1e-3 from (select count(*) n, sum(confidence) c from preds group by true_index) q) b using (metric)""")
def _(s, d):
    p = V.preds(s, d)
    hit = F.col("correct").cast("double")
    stack = "stack(3, 'accuracy', accuracy, 'images', images, 'mean_confidence', mean_confidence) as (metric, value)"
    now = p.agg(F.avg(hit).alias("accuracy"), F.count("*").cast("double").alias("images"), F.avg("confidence").alias("mean_confidence")).select(F.expr(stack))
    per = p.groupBy("true_index").agg(F.count("*").alias("n"), F.sum(hit).alias("k"), F.sum("confidence").alias("c"))
    n = F.sum("n")
    # the recorded confidence is off by 0.001, so one check fails on purpose
    kept = per.agg((F.sum("k") / n).alias("accuracy"), n.cast("double").alias("images"), (F.sum("c") / n + 1e-3).alias("mean_confidence")).select(F.expr(stack))
    return J.cross_check(now, kept, 1e-9).select("metric", r6("value").alias("value"), r6("recorded").alias("recorded"), "agrees")


@query("G05_stratified_validation", "select doc_id, label, case when r<=(select greatest(1,floor(min(n)*1e-1)) from (select count(*) n from docs group by label) q) then 'valid' else 'train' end part from (select *, row_number() over (partition by label order by doc_id) r from docs) z", extra=DOCS)
def _(s, d):
    return S.stratified_validation(docs(s, d).select("doc_id", "label"), "doc_id", "label", 0.1)


@query("G06_k_fold", "select id, cast(block as int) block, cast(f as int) fold, case when block=f then 'valid' else 'train' end part from (select id, (row_number() over (order by id)-1)//(count(*) over ()//7) block from house) q, range(0,7) t(f) where block<7")
def _(s, d):
    return S.contiguous_folds(V.house(s, d).select("id"), "id", 7)


SHUFFLED = {"shuffled": "select doc_id, row_number() over (order by md5(concat_ws(':','42',cast(doc_id as varchar))), doc_id) r, count(*) over () n from documents"}


@query("G07_permutation_split", "select doc_id, case when r<=floor(n*2e-1) then 'valid' else 'train' end part from shuffled", extra=SHUFFLED)
def _(s, d):
    return S.permutation_split(V.table(s, d, "documents").select("doc_id"), "doc_id", 0.2, 42)


@query("G08_mini_batches", "select 'keep' kind, doc_id, (r-1)//64 batch from shuffled union all select 'drop', doc_id, (r-1)//64 from shuffled where (r-1)//64<n//64", extra=SHUFFLED)
def _(s, d):
    t = V.table(s, d, "documents").select("doc_id")
    keep = S.mini_batches(t, "doc_id", 64, 42).withColumn("kind", F.lit("keep"))
    return keep.unionByName(S.mini_batches(t, "doc_id", 64, 42, drop_last=True).withColumn("kind", F.lit("drop")))


@query("G09_contract_checks", """select 'required_columns' "check", 1::bigint violations union all select 'expected_count', abs(count(*)-250) from pages union all select 'allowed_scheme', count(*) filter (where split_part(url,':',1) not in ('https')) from pages union all select 'unique_page_id', coalesce(sum(n-1),0)::bigint from (select count(*) n from pages group by page_id) q union all select 'unique_url', coalesce(sum(n-1),0)::bigint from (select count(*) n from pages group by url) q""")
def _(s, d):
    p = V.table(s, d, "pages").select("page_id", "url", F.split_part("url", F.lit(":"), F.lit(1)).alias("scheme"))
    return S.contract_checks(p, ["page_id", "url", "license"], 250, ["page_id", "url"], {"scheme": ["https"]})


@query("K08_balanced_sample", "select doc_id, label from (select *, row_number() over (partition by label order by doc_id) r from docs) q where r<=3 and label in (select label from docs group by label order by min(doc_id), label limit 5)", extra=DOCS)
def _(s, d):
    return S.balanced_sample(docs(s, d).select("doc_id", "label"), "doc_id", "label", 5, 3)


@query("K08_seeded_sample", "select doc_id, source from documents order by md5(concat_ws(':','7',cast(doc_id as varchar))), doc_id limit 50")
def _(s, d):
    return S.seeded_sample(V.table(s, d, "documents").select("doc_id", "source"), "doc_id", 50, 7)


@query("W16_perceptual_hash", "select p.image_id, lower(printf('%08x%08x', (h>>32)&4294967295, h&4294967295)) phash from (select t.image_id, cast(bit_or(case when t.b then (case when i=0 then (-9223372036854775808)::bigint else cast(1 as bigint)<<(63-t.i) end) else 0::bigint end) as bigint) h from (select p.image_id, p.y*8+p.x i, p.v>q.m b from px p join (select image_id, quantile_cont(v,5e-1) m from px where y*8+x>0 group by image_id) q on p.image_id=q.image_id) t group by t.image_id) p")
def _(s, d):
    return V.rasters(s, d).select("image_id", to_hex16(coefficient_bits(F.col("cells"))).alias("phash"))


@query("W17_difference_hash", "select image_id, cast(sum(case when v2>v then cast(1 as bigint)<<(55-(y*7+x)) else 0 end) as bigint) dhash from (select *, lead(v) over (partition by image_id, y order by x) v2 from px) q where x<7 group by 1")
def _(s, d):
    from lumentab.operators.phash import difference_bits

    return V.rasters(s, d).select("image_id", fold_bits(difference_bits(F.col("cells"), 8, 8)).alias("dhash"))


@query("X06_digest", "select doc_id, sha256(text) digest from documents")
def _(s, d):
    return docs(s, d).select("doc_id", "digest")


@query("X07_hex_round_trip", "select image_id, lower(printf('%08x%08x', (phash>>32)&4294967295, phash&4294967295)) hex, phash back from hashes")
def _(s, d):
    h = V.hashes(s, d).withColumn("hex", to_hex16(F.col("phash")))
    return h.select("image_id", "hex", from_hex16(F.col("hex")).alias("back"))


@query("X08_hamming", "select image_id, cast(bit_count(xor(phash,dhash)) as int) distance from hashes")
def _(s, d):
    return V.hashes(s, d).select("image_id", hamming(F.col("phash"), F.col("dhash")).alias("distance"))
