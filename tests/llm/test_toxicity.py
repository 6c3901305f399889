import random
from zlib import crc32

from pyspark.sql import functions as F

from rows import make_docs  # noqa: F401

from lumentab.llm import toxicity as T

LABELS = "doc_id bigint, quality int, toxic int, text string"


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choices(words, k=8)) + "." for _ in range(rng.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] = sentences[k][:-1] + " " + rng.choice(["zorgful", "Zorgness", "xq!"]) + "."
        rows.append((i, " ".join(sentences)))
        labels.append((i, 1, int(toxic), "x"))
    return rows, labels


def test_held_out_documents_and_sentences(spark, make_docs):
    rows, labels = corpus()
    got = {r["doc_id"]: r for r in T.toxicity(make_docs(rows), spark.createDataFrame(labels, LABELS)).collect()}
    held = [i for i in got if crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i]["held_out"] == (i in set(held)) for i in got)
    right = sum(got[i]["predicted"] == labels[i][2] for i in held)
    assert right >= 0.97 * len(held)
    for i in held:
        if labels[i][2] and got[i]["predicted"]:
            assert any(w in s["text"] for s in got[i]["offending"] for w in ("zorg", "Zorg", "xq"))
    assert all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.5) for g in got.values())


def test_held_out_labels_are_not_read(spark, make_docs):
    rows, labels = corpus(300)
    lies = [(i, q, 1 - t if crc32(str(i).encode()) % 5 == 0 else t, x) for i, q, t, x in labels]
    docs = make_docs(rows)
    a, b = (T.fit(docs, spark.createDataFrame(x, LABELS)) for x in (labels, lies))
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_odd_rows(spark, make_docs):
    rows, labels = corpus(200)
    odd = [(9001, None), (9002, ""), (9003, " \n. !"), (None, "xq xq."), (9004, "word. " * 20000), (5, rows[5][1])]
    got = T.toxicity(make_docs(rows + odd), spark.createDataFrame(labels + [(None, 1, 1, "x"), (7, 1, None, "x")], LABELS)).collect()
    assert len(got) == 206
    by = {r["doc_id"]: r for r in got}
    assert by[9001]["score"] == by[9002]["score"] and by[9001]["predicted"] == 0
    assert by[None]["held_out"] is False
    twice = [r["score"] for r in got if r["doc_id"] == 5]
    assert len(twice) == 2 and twice[0] == twice[1]
    none = spark.createDataFrame([], LABELS)
    assert {r["predicted"] for r in T.toxicity(make_docs(rows[:5]), none).collect()} == {0}
    assert T.toxicity(make_docs([]), none).count() == 0


def test_stage_keeps_clean_rows(spark, make_docs):
    rows, labels = corpus(300)
    docs = make_docs(rows)
    lab = spark.createDataFrame(labels, LABELS)
    kept = T.without_toxic(docs, lab)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    stay = {r["doc_id"] for r in T.toxicity(docs, lab).filter(F.col("score") < 0.5).collect()}
    assert {r["doc_id"] for r in kept.collect()} == stay
