"""Registered queries of the training-text operators, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

Q = {}


def query(name, sql=None):
    def add(fn):
        Q[name] = (fn, sql)
        return fn

    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op1_url_filters", """
with rules(rh, rp, v) as (values ('net','/','block'),('example.net','/en/','allow'),('example.com','/de/','block'),('org','/fr/','allow')),
u as (select page_id, translate(regexp_extract(coalesce(url,''),'://([^/?#]*)',1),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') host,
 regexp_extract(coalesce(url,''),'://[^/?#]*([^?#]*)',1) path from pages),
h as (select distinct host, path from u),
m as (select host, path, rh||rp as rule, v, row_number() over (partition by host, path order by length(rh||rp) desc, length(rh) desc) k
 from h join rules on (host = rh or ends_with(host, '.'||rh)) and starts_with(path, rp))
select page_id, u.host, u.path, rule, coalesce(v,'allow') verdict from u left join (select * from m where k=1) b on u.host=b.host and u.path=b.path""")
def _(s, d):
    from lumentab.llm.urls import filter_urls

    return filter_urls(table(s, d, "pages"), s.createDataFrame(RULES, "host string, path string, verdict string"))


def _licence_sql():
    from lumentab.llm import licences as L

    def canon(x):
        low = f"translate({x},'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
        t = f"' '||regexp_replace({low},'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+','  ','g')||' '"
        for old, new in L.SPELLINGS:
            t = f"replace({t},' {old.replace(' ', '  ')} ',' {new} ')"
        return f"case when regexp_matches({low},'{L.COPYRIGHT}') then '' else trim(regexp_replace({t},' +',' ','g')) end"

    lines = lambda x: f"list_filter(list_transform(string_split(coalesce({x},''),chr(10)), lambda x: {canon('x')}), lambda y: y<>'')"
    notices = ",".join(f"('{k}','{t}')" for k, t in L.NOTICES)
    return f"""with notices(licence, txt) as (values {notices}),
known as (select c, min(licence) licence from (select array_to_string({lines('txt')},' ') c, licence from notices) where c<>'' group by c),
d as (select row_number() over () r, doc_id, {lines('text')} l from documents),
p as (select r, true w, array_to_string(l,' ') c from d union all select r, false w, unnest(l) c from d),
h as (select r, max(licence) filter (where w) whole_licence, list_sort(list(distinct licence) filter (where not w)) licences, count(*) filter (where not w) n_lines from p join known using (c) group by r)
select doc_id, whole_licence, coalesce(licences,[]::varchar[]) licences, coalesce(n_lines,0)::bigint n_lines from d left join h on d.r=h.r"""


@query("op7_license_scans", _licence_sql())
def _(s, d):
    from lumentab.llm.licences import default_notices, scan_licences

    return scan_licences(table(s, d, "documents"), default_notices(s))


@query("op10_mixing")
def _(s, d):
    from lumentab.llm.apportion import draw

    return draw(table(s, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_toxicity")
def _(s, d):
    from lumentab.llm.toxicity import toxicity

    return toxicity(table(s, d, "documents"), table(s, d, "labels"))


@query("op2_sentencepiece")
def _(s, d):
    from lumentab.llm.pieces import encode

    return encode(table(s, d, "documents"))


@query("op9_substring_dedup")
def _(s, d):
    from lumentab.llm.phrases import drop_repeats

    return drop_repeats(table(s, d, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op8_minhash_near_dedup")
def _(s, d):
    from lumentab.llm.tensor_minhash import near_duplicates

    return near_duplicates(table(s, d, "documents"))


@query("op3_nearest_neighbours")
def _(s, d):
    from lumentab.llm.graph_ann import nearest

    vectors = table(s, d, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))


@query("op6_embedding_near_dedup")
def _(s, d):
    from lumentab.llm.collisions import near_vectors

    return near_vectors(table(s, d, "embeddings"))


@query("op4_lm_scoring")
def _(s, d):
    from lumentab.llm.pseudo_lm import pseudo_likelihood

    return pseudo_likelihood(table(s, d, "documents"))


@query("op11_lexical_search", r"""
with i as (select row_number() over () r, item_id, unnest(list_distinct(regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) term from benchmark),
d as (select row_number() over () k, doc_id, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t from documents),
s as (select count(*) docs, sum(len(t))::bigint total from d where len(t)>0),
f as (select k, doc_id, len(t) n, unnest(t) term from d),
tf as (select k, any_value(doc_id) doc_id, any_value(n) n, term, count(*) tf from f where term in (select term from i) group by k, term),
w as (select term, floor(1000*ln((2*docs+2)/(2*count(*)+1)))::bigint w from tf, s group by term, docs),
p as (select r, any_value(item_id) item_id, k, any_value(doc_id) doc_id, sum(w*((1000000000*tf)//(1000*tf+20*(100-50+((50*n*docs)//total)))))::bigint score
 from i join tf using (term) join w using (term), s group by r, k)
select item_id, rank, doc_id, score from (select item_id, doc_id, score, (row_number() over (partition by r order by score desc, doc_id))::int rank from p where score>0) where rank<=50""")
def _(s, d):
    from lumentab.llm.max_sketch import search

    return search(table(s, d, "documents"), table(s, d, "benchmark"))


@query("op12_language_id")
def _(s, d):
    from lumentab.llm.hyperlang import identify

    return identify(table(s, d, "documents"))


@query("op13_embedding_whitening")
def _(s, d):
    from lumentab.llm.whitening import whiten

    return whiten(table(s, d, "embeddings"))
