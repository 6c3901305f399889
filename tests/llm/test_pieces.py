import random

import pytest

from rows import make_docs  # noqa: F401

from lumentab.llm import pieces as P

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary()


ODD = ["", "a", " a", "  a  b ", "<s> </s> <0x0A> <unk>", "\n\n\t x", "é世界😀 \x00 ok", "a" * 700, "ab" * 400 + " " * 40 + "z", "haha" * 90, "12345 $%^&*()", " ", "   ", "Ünïcödé ", "\x00", "\x00\x00 a", "\u2028x\u00a0y"]


def check(texts, library, vocabulary, encoder=None):
    encoder = encoder or P.Encoder(vocabulary)
    ids, counts = encoder.encode([t.encode() for t in texts])
    at = 0
    for t, n, back in zip(texts, counts, P.decode_ids(ids, counts, vocabulary)):
        assert ids[at : at + n].tolist() == library.encode(t), repr(t[:60])
        assert back.decode() == library.decode(library.encode(t))
        at += n


def test_odd_texts_match_the_library(library, vocabulary):
    check(ODD + ["▁x▁ y"], library, vocabulary)


def test_random_texts_in_small_chunks(library, vocabulary, monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 50)
    rng = random.Random(5)
    encoder = P.Encoder(vocabulary)
    for _ in range(12):
        texts = ["".join(rng.choice("abcdeth  .,\n1é世😀") for _ in range(rng.randint(0, 400))) for _ in range(20)]
        check(texts, library, vocabulary, encoder)


def test_suffix_order_finds_every_occurrence():
    import numpy as np

    rng = np.random.default_rng(2)
    for alphabet in (2, 40, 5000):
        line = rng.integers(0, alphabet + 1, 400)
        order = P.SuffixOrder(line, alphabet, 9)
        codes, lengths = np.zeros((60, 9), np.int64), np.zeros(60, np.int64)
        for r in range(60):
            n = int(rng.integers(1, 10))
            at = int(rng.integers(0, 400 - n))
            piece = np.maximum(line[at : at + n], 1)
            codes[r, :n], lengths[r] = piece, n
        low, high = order.ranges(codes, lengths)
        for r in range(60):
            n = lengths[r]
            want = [i for i in range(401 - n) if (line[i : i + n] == codes[r, :n]).all()]
            assert sorted(order.places[low[r] : high[r]].tolist()) == want


def test_tables(spark, make_docs, library):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "word " * 30000)]
    got = {(r["doc_id"], r["n_tokens"]): r for r in P.encode(make_docs(rows)).collect()}
    assert got[(1, 0)]["round_trip"] is None and got[(2, 0)]["round_trip"]
    assert got[(3, len(library.encode("a b")))]["ids"] == library.encode("a b")
    assert got[(4, len(library.encode("word " * 30000)))]["round_trip"]
    assert P.encode(make_docs([])).count() == 0
    texts = {r["doc_id"]: r["text"] for r in P.decode(P.encode(make_docs(rows[2:]))).collect()}
    assert texts == {3: "a b", None: "x", 4: "word " * 30000}
