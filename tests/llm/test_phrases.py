import hashlib
import random
import re

from rows import make_docs  # noqa: F401

from lumentab.llm import phrases as P

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def brute(rows, window=13):
    words = [WORD.findall((t or "").encode()) for _, t, *_ in rows]
    first = {}
    for (i, *_), w in zip(rows, words):
        if i is not None:
            for j in range(len(w) - window + 1):
                key = tuple(w[j : j + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for (i, *_), w in zip(rows, words):
        live = [True] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and first.get(tuple(w[j : j + window]), i) < i:
                live[j : j + window] = [False] * window
        kept = b" ".join(x for x, k in zip(w, live) if k)
        out.append((i, len(w), len(w) - live.count(True), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df, **kw):
    return sorted((tuple(r) for r in P.drop_repeats(df, **kw).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def passages(seed=1, n=150):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    common = [[word() for _ in range(rng.randint(13, 70))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [word() for _ in range(rng.randint(0, 40))]
            p = rng.choice(common)
            a = rng.randrange(0, len(p) - 5)
            w += p[a : rng.randint(a + 5, len(p))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(500 + i, rows[i][1]) for i in range(30)] + [(600, "ab " * 40), (601, "ab " * 25), (602, "ab " * 12)]
    rng.shuffle(rows)
    return rows


def test_against_plain_loops(spark, make_docs, monkeypatch):
    rows = passages()
    want = brute(rows)
    assert sum(w[2] for w in want) > 1000
    assert found(make_docs(rows)) == want
    assert found(make_docs(rows), window=7) == brute(rows, 7)


def test_automata_locate_phrases_in_whole_documents(monkeypatch):
    rows = passages(3, 60)
    phrases = {}
    for i, t in rows:
        words = t.encode().split()
        if len(words) >= 13:
            phrases[b" ".join(words)] = min(i, phrases.get(b" ".join(words), i))
    ids, words = [i for i, _ in rows], [t.encode().split() for _, t in rows]
    for size in (1, 300, 1 << 22):
        monkeypatch.setattr(P, "AUTOMATON_BYTES", size)
        got = P.covered(words, ids, phrases, 13)
        assert sorted((i, len(w), int(g.sum())) for i, w, g in zip(ids, words, got)) == sorted(r[:3] for r in brute(rows))


def test_removal_is_the_automata_s(spark, make_docs, monkeypatch):
    """Nothing goes where the automata find nothing, copies apart."""
    words = [[b"a"] * 20, [b"a"] * 20]
    assert P.covered(words, [1, 2], {b" ".join(words[0]): 1}, 13)[1].all()
    monkeypatch.setattr(P, "_automaton", lambda lines, block: type("None", (), {"iter": staticmethod(lambda line: ())}))
    assert not P.covered(words, [1, 2], {b" ".join(words[0]): 1}, 13)[1].any()


def test_odd_rows(spark, make_docs):
    long = " ".join(f"v{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, "few words"), (4, long), (4, long), (4, "x " + long + " y"), (5, "a " + long), (None, long), (None, None), (6, long), (7, " ".join(f"u{i % 900}" for i in range(30000))), (8, "U " * 13), (9, "u " * 13), (10, "U\n" * 20)]
    assert found(make_docs(rows)) == brute(rows)
    assert P.drop_repeats(make_docs([])).count() == 0


def test_stage(spark, make_docs):
    rows = passages(5, 80)
    out = P.without_repeats(make_docs(rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {r["doc_id"]: r for r in out.collect()}
    for i, n, removed, digest in brute(rows):
        assert (i in got) == (n == 0 or removed < n)
        if i in got:
            assert hashlib.sha256(b" ".join(got[i]["text"].encode().split())).hexdigest() == digest
            assert got[i]["n_chars"] == len(got[i]["text"])
    texts = dict(rows)
    assert all(got[i]["text"] == texts[i] for i, n, removed, _ in brute(rows) if i in got and not removed)


def test_a_common_line_among_differing_text_asks_for_no_phrase(spark, make_docs):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    text = lambda: " ".join(f"x{rng.randrange(10**6)}" for _ in range(30))
    line = "the nine words of a line that is common"
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{text()} {line} {text()}" + (f" {passage}" if i < 3 else "")) for i in range(200)]
    docs = make_docs(rows).withColumn("key", F.col("doc_id"))
    asked = P.requests(docs.join(P.recurring(docs), "key"))
    got = asked.collect()
    # of the three that share the passage two ask, each for the two or three phrases of one witness that hold it
    assert {r["key"] for r in got} == {1, 2} and all(r["witness"] < r["key"] for r in got) and 4 <= len(got) <= 6
    sent = P.phrases_of(docs, asked).collect()
    assert len(sent) == len({(r["witness"], r["spot"]) for r in got}) and all(len(r["words"].split()) <= P.PHRASE + 12 for r in sent)
    assert found(make_docs(rows)) == brute(rows)


def test_automata_may_end_anywhere(spark, make_docs, monkeypatch):
    rows = passages(9, 60)
    docs = make_docs(rows)
    for size in (1, 300):
        monkeypatch.setattr(P, "AUTOMATON_BYTES", size)
        assert found(docs) == brute(rows)
