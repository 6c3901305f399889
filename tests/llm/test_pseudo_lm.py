import random
from collections import Counter

import numpy as np

from rows import make_docs  # noqa: F401

from lumentab.llm import pseudo_lm as P


def test_words_and_windows_against_plain_loops():
    texts = [b"The cat sat. The cat, x9 sat", b"", b"one", b"a b"]
    codes, counts, key, form = P.tokens(texts)
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [7, 0, 1, 2]
    forms = {b"The": 1, b"cat": 0, b"sat.": 2, b"cat,": 2, b"x9": 3, b"sat": 0, b"one": 0, b"a": 0, b"b": 0}
    assert [int(form[c]) for c in codes] == [forms[w] for w in words]
    assert (P.shared_leaf(key) // P.LEAVES - P.FREQUENT == form).all() and (P.shared_leaf(key) < P.EDGE).all()
    leaves = np.arange(len(words)) * 7
    got, at = P.windows(leaves, counts), 0
    for n in counts.tolist():
        line = [P.EDGE, P.EDGE, *leaves[at : at + n].tolist(), P.EDGE, P.EDGE]
        for k in range(n):
            assert got[:, at + k].tolist() == [line[k], line[k + 1], line[k + 3], line[k + 4]]
        at += n


def test_scores_tell_order(spark, make_docs):
    rng = random.Random(3)
    names = ["Ana", "Bob", "Eve"]
    natural = lambda: " ".join(f"{rng.choice(names)} saw the {rng.choice(['dog', 'cat'])}." for _ in range(30))
    rows = [(i, natural()) for i in range(60)]
    mixed = [rng.sample(t.split(), len(t.split())) for _, t in rows[:20]]
    df = make_docs(rows)
    model = P.fit(df)
    plain = {r["doc_id"]: r["per_token"] for r in P.score(df, model).collect()}
    other = {r["doc_id"]: r["per_token"] for r in P.score(make_docs([(i, " ".join(w)) for i, w in enumerate(mixed)]), model).collect()}
    assert all(plain[i] > other[i] for i in other)


def test_words_are_counted_exactly(spark, make_docs):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(400000)}" if rng.random() < 0.5 else rng.choice(["aa", "bb"]) for _ in range(300)) for _ in range(900)]
    one = Counter(w for t in texts for w in t.split())
    assert len(one) > 100000
    assert Counter(r["n"] for r in P.word_counts(make_docs(list(enumerate(texts)))).collect()) == Counter(one.values())


def test_odd_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "x y z"), (4, "long " * 20000)]
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["log_likelihood"], r["per_token"]) for r in P.pseudo_likelihood(make_docs(rows)).collect())
    assert [g[:2] for g in got] == [(0, 3), (1, 0), (2, 0), (3, 1), (3, 1), (4, 20000)]
    assert got[1][2:] == (0.0, None) and got[3] == got[4] and got[5][2] < 0
    assert P.pseudo_likelihood(make_docs([])).count() == 0


def test_every_token_is_masked_once_in_all_rounds():
    counts = np.array([5, 0, 9000, 1])
    parts = [P.masked(np.array([7, 8, 9, 10]), counts, k) for k in range(P.MASK)]
    assert sorted(np.concatenate(parts).tolist()) == list(range(9006))


def test_gradients_against_differences():
    """A step moves every used row against the slope of the mean log-probability."""
    rng = np.random.default_rng(1)
    words = P.Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones(P.EDGE))
    w = P.started(words)
    w[P.UP :, : P.WIDTH] = rng.normal(0, 0.3, (P.ROWS - P.UP, P.WIDTH))
    near, target = rng.integers(0, 6, (4, 40)) * 640, rng.integers(0, 6, 40) * 650
    near[0, :5] = P.EDGE
    after, size, used = w.copy(), np.zeros(P.ROWS, np.float32), np.zeros(P.ROWS)
    P.step(after, size, used, near, target)
    value = lambda v: P.log_chances(v, near, target).mean()
    for row in (P.LEFT + near[1, 7], P.LEFT + P.EDGE, P.RIGHT + near[2, 3], P.SCALES, P.SCALES + 1, P.BIAS, P.UP + target[0] // P.LEAVES, P.DOWN + target[0]):
        grad = np.zeros(P.WIDTH)
        for c in range(P.WIDTH):
            up, down = w.astype(np.float64), w.astype(np.float64)
            up[row, c] += 1e-3
            down[row, c] -= 1e-3
            grad[c] = (value(up) - value(down)) / 2e-3
        move = (after - w)[row, : P.WIDTH].astype(float)
        cosine = move @ grad / np.linalg.norm(move) / np.linalg.norm(grad)
        assert cosine > 0.99, (row, cosine)
    # many.sum() of the words equals two sides of every place
    assert used[P.LEFT : P.RIGHT].sum() == used[P.RIGHT : P.SCALES].sum() == 80


def test_words_of_one_class_depend_on_their_neighbours(spark, make_docs):
    rows = [(i, "red fox eats. blue owl naps." if i % 2 else "blue owl naps. red fox eats.") for i in range(200)]
    model = P.fit(make_docs(rows))
    same = {1: "red fox eats.", 2: "blue fox eats.", 3: "red owl eats."}
    got = {r["doc_id"]: r["per_token"] for r in P.score(make_docs(list(same.items())), model).collect()}
    assert got[1] > got[2] + 0.1 and got[1] > got[3] + 0.1


def test_network_keeps_its_part_as_the_corpus_grows(spark, make_docs):
    """The gap between a likely and an unlikely word must not shrink with more of the same text."""
    gaps = []
    for size in (200, 3200):
        model = P.fit(make_docs([(i, "red fox eats. blue owl naps." if i % 2 else "blue owl naps. red fox eats.") for i in range(size)]))
        got = {r["doc_id"]: r["per_token"] for r in P.score(make_docs([(1, "red fox eats."), (2, "blue fox eats.")]), model).collect()}
        gaps.append(got[1] - got[2])
    assert gaps[0] > 0.1 and gaps[1] > 0.9 * gaps[0]


def test_scores_against_plain_loops_and_sum_to_one(spark, make_docs, monkeypatch):
    # few words have leaves of their own or are sent, so all three ways take part
    monkeypatch.setattr(P, "SENT", 4200)
    rng = random.Random(2)
    vocabulary = [f"{a}{b}{c}" for a in "abcdefghijklmnopqrst" for b in "uvwxyz" for c in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, range(1, len(vocabulary) + 1), k=150))) for i in range(120)]
    one = Counter(w for _, t in rows for w in t.split())
    docs = make_docs(rows)
    counts = P.word_counts(docs)
    words = P.vocabulary(counts)
    data = P.coded(docs, words, 1)
    weights = P.trained(data, words)
    _, _, key, _ = P.tokens([" ".join(one).encode()])
    key_of = dict(zip(one, key.tolist()))
    ranked = sorted(one, key=lambda w: (-one[w], key_of[w]))
    own_leaf = set(ranked[: P.FREQUENT * P.LEAVES])
    assert 4200 < len(ranked)
    leaf_of = dict(zip(ranked, words.leaves(np.array([key_of[w] for w in ranked]))[0].tolist()))
    assert len({leaf_of[w] for w in own_leaf}) == len(own_leaf)
    mass = Counter()
    for w in ranked:
        if w not in own_leaf:
            assert leaf_of[w] == int(P.shared_leaf(np.array([key_of[w]]))[0])
            mass[leaf_of[w]] += one[w] + 0.5
    v = weights.astype(float)

    def tree(line, k):
        near = [line[k], line[k + 1], line[k + 3], line[k + 4]]
        x = v[P.LEFT + near[1]] + v[P.RIGHT + near[2]] + v[P.BIAS] + v[P.LEFT + near[0]] * v[P.SCALES] + v[P.RIGHT + near[3]] * v[P.SCALES + 1]
        h = np.r_[np.tanh(x[: P.WIDTH]), 1]
        soft = lambda z: np.exp(z) / np.exp(z).sum()
        down = np.concatenate([soft(v[P.DOWN + c * P.LEAVES : P.DOWN + (c + 1) * P.LEAVES] @ h) for c in range(P.CLASSES)])
        return np.repeat(soft(v[P.UP : P.DOWN] @ h), P.LEAVES) * down

    def share(w, own):
        return 1 if w in own_leaf else (one[w] - own + 0.5) / (mass[leaf_of[w]] + 0.5 - own)

    def line_of(text):
        return [P.EDGE, P.EDGE, *(leaf_of[w] for w in text.split()), P.EDGE, P.EDGE]

    model = P.Model(counts, words, weights)
    got = {r["id"]: r["log_likelihood"] for r in P._score(data, model, 1).collect()}
    assert len(got) == len(rows)
    for i, t in rows[:25]:
        line = line_of(t)
        want = sum(np.log(tree(line, k)[leaf_of[w]] * share(w, 1)) for k, w in enumerate(t.split()))
        assert abs(got[i] - want) < 1e-3
    chance = tree(line_of(rows[0][1]), 4)
    seen = sum(chance[leaf_of[w]] * share(w, 0) for w in one)
    unseen = sum(chance[f] * 0.5 / (mass[f] + 0.5) for f in range(P.FREQUENT * P.LEAVES, P.EDGE))
    assert abs(seen + unseen - 1) < 1e-5
