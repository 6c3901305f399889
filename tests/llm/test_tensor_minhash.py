import random
import re

from rows import make_docs  # noqa: F401

from lumentab.llm import tensor_minhash as M

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    out = []
    for n, (i, *_) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            k = todo.pop()
            for m in range(len(rows)):
                if m not in seen and near(sets[k], sets[m]):
                    seen.add(m)
                    todo.append(m)
        head = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
        out.append((i, len(sets[n]), head, head is None or i == head))
    return sorted(out, key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def families(seed=1):
    rng = random.Random(seed)
    rows = [(1000 + i, " ".join(f"w{rng.randrange(5000)}" for _ in range(60))) for i in range(40)]
    for f in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(100)]
        rows += [(2000 + 100 * f + k, edited(rng, base, rng.randrange(0, 7))) for k in range(14)]
    rows += [(10 + k, rows[0][1].upper() if k % 2 else rows[0][1] + "\n") for k in range(20)]
    rng.shuffle(rows)
    return rows


def test_families_whole_and_in_blocks(spark, make_docs):
    rows = families()
    want = brute(rows)
    assert 40 < sum(w[3] for w in want) < len(rows) - 30
    for block in (M.BLOCK, 4):
        assert sorted((tuple(r) for r in M.near_duplicates(make_docs(rows), block=block).collect()), key=repr) == want


def test_odd_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A b"), (6, "a b c d e"), (6, "a b c d e"), (7, "a b c d f"), (None, "a b"), (None, "z z"), (None, None), (8, "q " * 30000), (9, "q " * 20000)]
    assert sorted((tuple(r) for r in M.near_duplicates(make_docs(rows)).collect()), key=repr) == brute(rows)
    assert M.near_duplicates(make_docs([])).count() == 0


def test_stage_keeps_one_of_each(spark, make_docs):
    rows = families(2)
    rows.append(rows[0])
    kept = M.without_near_duplicates(make_docs(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i, _, _, k in brute(rows) if k})


def test_threshold_is_exact():
    import numpy as np

    a = np.arange(1, 101, dtype=np.uint64)
    sets = [a, a[:75], a[:74], np.concatenate([a[:86], a[:14] + np.uint64(1000)])]
    assert M.confirmed_links([0, 1, 2, 3], sets, None) == [(0, 1), (0, 3), (1, 2)]
    left = np.array([True, False, False, False])
    assert M.confirmed_links([0, 1, 2, 3], sets, left) == [(0, 1), (0, 3)]


def test_rows_without_ids_join_their_own_texts_only(spark, make_docs):
    rng = random.Random(12)
    rows = [(None if i % 2 else 7, " ".join(f"v{rng.randrange(9000)}" for _ in range(30))) for i in range(600)]
    docs = make_docs(rows)
    signed = M.signatures(docs)
    members = signed.selectExpr("row_key as key", "set_key", "set_key as family", "1 as blocks")
    assert M.texts_of(docs, members).count() == 600
    near = [(None if i % 3 else 5, " ".join(f"n{rng.randrange(40)}" for _ in range(40))) for i in range(12)]
    near += [(i, t + " more") for i, t in near] + [(None, near[0][1].upper())]
    assert sorted((tuple(r) for r in M.near_duplicates(make_docs(near)).collect()), key=repr) == brute(near)


def test_stage_keeps_one_row_of_a_group_whatever_its_ids(spark, make_docs):
    base = [f"w{i}" for i in range(60)]
    copy, clean = " ".join(base), " ".join(f"c{i}" for i in range(30))
    rows = [(None, copy), (None, copy + " x"), (3, copy + " y"), (3, clean), (9, copy), (None, "lone words of no id at all"), (None, None), (4, "")]
    kept = M.without_near_duplicates(make_docs(rows))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(3, copy + " y"), (3, clean), (None, "lone words of no id at all"), (None, None), (4, "")], key=repr)
    none = M.without_near_duplicates(make_docs([(None, copy), (None, copy + " x")])).collect()
    assert len(none) == 1


def test_blocks_follow_the_size_of_the_sets(spark, make_docs, monkeypatch):
    rows = families(3)
    monkeypatch.setattr(M, "BLOCK_SHINGLES", 200)
    assert sorted((tuple(r) for r in M.near_duplicates(make_docs(rows)).collect()), key=repr) == brute(rows)
