import random
from collections import Counter, defaultdict

import pytest

from rows import make_docs  # noqa: F401

from lumentab.llm import apportion as A


def highest_quotients(votes, seats):
    got = Counter()
    for _ in range(seats if sum(votes.values()) else 0):
        best = max(sorted(votes), key=lambda p: votes[p] / (2 * got[p] + 1))
        got[best] += 1
    return {p: got[p] for p in votes}


def test_apportion_matches_seat_by_seat(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(25):
        seats = rng.choice([0, 1, 3, 10, 57, 400])
        votes = {p: rng.choice([0, 1, 5, 7, 100, 3000, rng.randrange(1, 50000)]) for p in range(rng.randint(1, 12))}
        rows += [(g, p, v, seats) for p, v in votes.items()]
        want |= {(g, p): q for p, q in highest_quotients(votes, seats).items()}
    df = spark.createDataFrame(rows, "g int, p int, v bigint, s bigint")
    got = {(r["g"], r["p"]): r["quota"] for r in A.apportion(df, ["g"], "v", "s", "p").collect()}
    assert got == want
    one = df.filter("g = 5").drop("g")
    assert {r["p"]: r["quota"] for r in A.apportion(one, [], "v", "s", "p").collect()} == {p: q for (g, p), q in want.items() if g == 5}


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        level = {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        over = {s for s in open_ if level[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else level[s] for s in order}
        capped |= over


def mixture(n=3000, seed=1):
    rng = random.Random(seed)
    sources = ["big"] * 5 + ["a", "é", "Z", None, "tiny", "b c"]
    return [(i, " ".join("w" for _ in range(rng.choice([0, 1, 20, 60, 300]))), s if s != "tiny" or rng.random() < 0.05 else "big") for i, s in enumerate(rng.choice(sources) for _ in range(n))]


def test_targets_and_draw(spark, make_docs):
    rows = mixture()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(t.split())
    want = targets(size)
    docs = make_docs(rows)
    got = A.draw(docs, shard_docs=300).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(p["to"] - p["from"] for p in r["pieces"])
        assert all(0 <= p["from"] < p["to"] <= r["size"] for p in r["pieces"])
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - want[s]) <= max(64, 0.01 * want[s])
    again = A.draw(docs.repartition(7), shard_docs=300).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_tiny_sources_come_near_their_targets(spark, make_docs):
    rows = [(i, " ".join("w" * 3 for _ in range(n)), f"t{n:02}") for i, n in enumerate(range(1, 41))]
    rows += [(100 + i, "x " * 50, "zz") for i in range(60)]
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    want, taken = targets(size), Counter()
    for r in A.draw(make_docs(rows)).collect():
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1.5 for s in size)
    assert abs(sum(taken.values()) - sum(want.values())) <= 5


def test_rows_of_one_id_fall_into_several_shards(spark, make_docs):
    docs = make_docs([(None if i % 2 else 7, f"w{i} " * 9, "a") for i in range(400)])
    got = A.draw(docs, shard_docs=50).collect()
    assert sorted(r["taken"] for r in got) == sorted(r["taken"] for r in A.draw(docs.repartition(5), shard_docs=50).collect())
    assert abs(sum(r["taken"] for r in got) - 1.5 * 3600) <= 64


def test_stage_texts_follow_the_draw(spark, make_docs):
    rows = mixture(600, 3)
    docs = make_docs(rows)
    taken = {r["doc_id"]: r["taken"] for r in A.draw(docs).collect()}
    mixed = A.mixed_documents(docs)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert words == {i: t for i, t in taken.items() if t}


def test_odd_rows(spark, make_docs):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "z", "b"), (4, "w " * 100000, "c")]
    got = A.draw(make_docs(rows)).collect()
    assert len(got) == 6
    assert all(r["taken"] == 0 for r in got if not r["size"])
    assert A.draw(make_docs([])).count() == 0
    empty = A.draw(make_docs([(1, None, "a"), (2, "", None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2
