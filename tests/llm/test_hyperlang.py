import random
from collections import Counter
from functools import cache
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from lumentab.llm import hyperlang as H

DOCS = "doc_id bigint, text string, lang string, source string, score double, held_out string"
SMALL = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0.5, "x") for i, t, lang in rows], DOCS)


def held(i):
    return i is not None and crc32(str(i).encode()) % 4 == 2


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isalpha():
            word += c.lower()[0]
        elif word:
            out.append(word)
            word = ""
    return out


@cache
def plain_word(word, dimensions):
    """Bind and add n-gram by n-gram."""
    total, letters = np.zeros(dimensions), [0, *map(ord, word), 0]
    for a in range(len(letters) - 2):
        bound = np.ones(dimensions)
        for j in range(3):
            bound *= np.roll(H.letter_vectors(np.array([letters[a + j]]), dimensions)[0].astype(float), 2 - j)
        total += bound
    return total


def plain_bundle(text, dimensions):
    return sum((plain_word(w, dimensions) for w in words_of(text)), np.zeros(dimensions))


def plain(rows, dimensions):
    learned = {}
    for i, t, lang in rows:
        if lang is not None and not held(i):
            learned[lang] = learned.get(lang, 0) + plain_bundle(t, dimensions)
    learned = {k: v for k, v in sorted(learned.items()) if np.any(v)}
    out = []
    for i, t, _ in rows:
        own = plain_bundle(t, dimensions)
        if not words_of(t) or not learned:
            out.append((i, held(i), "und", 0.0))
            continue
        cosines = {k: own @ v / np.linalg.norm(own) / np.linalg.norm(v) for k, v in learned.items()}
        best = max(cosines, key=lambda k: cosines[k])
        out.append((i, held(i), best, min(1.0, max(0.0, cosines[best]))))
    return out


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    parts = {"aa": "the and ing of tion er", "bb": "der die ung lich sch ö", "cc": "Él ción ñ que los mente"}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        word = lambda lang=lang: "".join(rng.choices(parts[lang].split(), k=rng.randint(1, 3)))
        rows.append((i, rng.choice([" ", ". ", "\n12 "]).join(word() for _ in range(rng.randint(3, 40))), lang))
    return rows


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-5)


def test_equals_plain_loops(spark, monkeypatch):
    rows = corpus()
    same(H.identify(docs_of(spark, rows), 256).collect(), plain(rows, 256))
    monkeypatch.setattr(H, "SLICE", 16)
    same(H.identify(docs_of(spark, rows), 256).collect(), plain(rows, 256))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = H.identify(docs).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    long = [r for r in got if r["held_out"] and r["n"] >= 40]
    assert long and sum(r["lang"] == r["lang_pred"] for r in long) >= 0.98 * len(long)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_languages_are_not_read(spark):
    rows = corpus(80)
    lies = [(i, t, "zz" if held(i) else lang) for i, t, lang in rows]
    a, b = (H.prototypes(docs_of(spark, x), 128) for x in (rows, lies))
    assert a.keys() == b.keys() and all((a[k] == b[k]).all() for k in a)


def test_odd_rows(spark):
    rows = corpus(30, 2)
    odd = [(100, None, "aa"), (101, "", "bb"), (102, "12 .. \x00", "only"), (None, "theing and", None), (103, "theing and", None), (104, "x", "cc"), (7, rows[7][1], rows[7][2]), (105, "the tion. " * 20000, "aa"), (106, "日本語 İstanbul ß", "dd")]
    got = H.identify(docs_of(spark, rows + odd), 128)
    same(got.collect(), plain(rows + odd, 128))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert "only" not in {r["lang_pred"] for r in got.collect()}
    assert H.identify(docs_of(spark, [])).count() == 0
    nothing = H.identify(docs_of(spark, [(1, "abc", None), (2, "def", None)])).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_pieces_lose_no_gram():
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(300))
    parts = list(H.pieces(text, 50))
    assert "".join(parts) == text and max(map(len, parts)) <= 50
    grams = lambda t: Counter(f" {w} "[a : a + 3] for w in words_of(t) for a in range(len(w)))
    assert sum((grams(p) for p in parts), Counter()) == grams(text)
    assert "".join(H.pieces("a" * 130, 50)) == "a" * 130
