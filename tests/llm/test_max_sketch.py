import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rows import make_docs  # noqa: F401

from lumentab.llm import max_sketch as M

ITEMS = "item_id bigint, text string, score double, doc_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, ranks=50):
    """Every document scored for every item, one after the other."""
    counted = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for d, c in counted:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:ranks], 1)]
    return sorted(out, key=repr)


def found(spark, make_docs, docs, items, ranks=50):
    table = spark.createDataFrame([(i, t, 0.5, "x") for i, t in items], ITEMS)
    return sorted(map(tuple, M.search(make_docs(docs), table, ranks).collect()), key=repr)


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(300)]
    text = lambda: rng.choice([" ", ", ", "\n"]).join(rng.choices(words, weights=range(300, 0, -1), k=rng.choice([1, 5, 30, 200])))
    return [(i, text()) for i in range(n)], [(k, text().upper() if k % 2 else text()) for k in range(30)]


@pytest.mark.parametrize("ranks", [1, 7, 50])
def test_equals_plain_loops(spark, make_docs, ranks):
    docs, items = corpus()
    assert found(spark, make_docs, docs, items, ranks) == plain(docs, items, ranks)


def test_many_blocks_and_tiny_sketches(spark, make_docs, monkeypatch):
    docs, items = corpus(150, 2)
    want = plain(docs, items, 5)
    monkeypatch.setattr(M, "ITEMS", 12)
    monkeypatch.setattr(M, "TERMS", 150)
    assert found(spark, make_docs, docs, items, 5) == want


def test_copies_and_frequent_terms(spark, make_docs):
    docs, items = corpus(200, 3)
    docs += [(1000 + i, "abc abc ade " * 3) for i in range(300)] + [(2000 + i, f"abc w{i}") for i in range(300)]
    docs += [(3000, "abc " * 400)]
    items += [(100, "ABC ade"), (101, "abc")]
    assert found(spark, make_docs, docs, items) == plain(docs, items)


def test_odd_rows(spark, make_docs):
    docs = [(None, "alpha beta"), (1, None), (2, ""), (3, " .,-\x00\x1c "), (4, "alpha"), (4, "alpha"), (4, "beta alpha"), (5, "Ä ä ÄB é"), (6, "alpha " * 30000), (7, "x\x1cy a_b a-b")]
    items = [(1, "Alpha beta"), (1, "Alpha beta"), (2, None), (3, ""), (4, "..."), (None, "äb éx Ä"), (6, "y x b"), (7, "unknown")]
    assert found(spark, make_docs, docs, items) == plain(docs, items)
    assert found(spark, make_docs, [], items) == []
    assert found(spark, make_docs, docs, []) == []
    assert found(spark, make_docs, [(1, None), (2, "")], items) == []


def test_bounds_hold_and_leave_work_out(spark, make_docs):
    docs, items = corpus(600, 4)
    docs = [(i, t) for i, t in docs] + [(5000, "abc " * 300)]
    index = M.sketches(make_docs(docs))
    table = spark.createDataFrame([(i, t, 0.5, "x") for i, t in items], ITEMS)
    (block,) = M._blocks(table)
    rows = index.toArrow().combine_chunks().to_batches()[0]
    block.weigh(M.frequencies(index, block), rows.num_rows, sum(rows.column("n").to_pylist()))
    block.prepare()
    exact = np.array([block.scores(t.encode()) for t in rows.column("text").to_pylist()])
    bound = np.zeros(exact.shape)
    for some, upper in block.bounds(rows):
        bound[some] = upper
    assert (bound >= exact).all()
    # thresholds come from real documents, and most bounds lie below them
    reached = M._thresholds(index, block, 5)
    assert (reached <= np.maximum(np.sort(exact, axis=0)[-5], 1)).all()
    assert (bound >= reached).sum() < 0.5 * (exact > 0).sum()
