"""The stages in order, against plain versions on the smallest tables."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F
from test_phrases import brute as plain_repeats
from test_tensor_minhash import brute as plain_groups

import corpus_pipeline
from lumentab.llm import apportion, toxicity

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "mixing", "sentencepiece"]
    docs, seen = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{n}")
        seen.append(docs)
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if n < 4:
            assert docs.columns == COLUMNS
    seen.append(docs)
    given, clean, single, cut, mixed, encoded = seen

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    stay = {r["doc_id"] for r in toxicity.toxicity(given, labels).filter(F.col("predicted") == 0).collect()}
    assert {r["doc_id"] for r in clean.collect()} == stay

    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, _, _, kept in plain_groups(rows) if kept)

    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    texts = {r["doc_id"]: r["text"] or "" for r in cut.collect()}
    for i, n, removed, digest in plain_repeats(rows):
        assert (i in texts) == (n == 0 or removed < n)
        if i in texts:
            assert hashlib.sha256(b" ".join(texts[i].encode().split())).hexdigest() == digest

    taken = {r["doc_id"]: r["taken"] for r in apportion.draw(cut).collect()}
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == {i: t for i, t in taken.items() if t}

    assert encoded.count() == mixed.count() and encoded.filter("not round_trip").count() == 0
    again = corpus_pipeline.run(spark, SMALL)
    key = lambda df: sorted((r["doc_id"], tuple(r["ids"])) for r in df.collect())
    assert key(again) == key(encoded)
