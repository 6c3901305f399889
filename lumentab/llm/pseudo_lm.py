"""LM scoring by masked pseudo-likelihood.

A window network, trained in numpy, predicts every token from two tokens on either side. Its
output is a tree of two steps over 4,096 leaves: a class, then a leaf of that class. Each of the
3,840 most frequent words of the corpus is a leaf of its own; all other words share 256 leaves
by form and digest, and inside a shared leaf a word has its exact share of the leaf's tokens. So
the probabilities of all words sum to 1, each of them goes through the network, and its part does
not change with the size of the corpus. A document's score is the sum of its tokens'
conditional log-probabilities.

Training masks a seeded part of the tokens of every document; each task steps over its own masked
tokens and the weights are averaged between rounds, each row by how often it was used. All words
are counted by 62-bit digests in a Spark table that grows with the corpus. Tasks are sent the
counts of the most frequent words; all other words of a document ask the table. The driver holds
the weights, that bounded list and the totals of the shared leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lumentab.llm import batches as B
from lumentab.session import cut_lineage, ship_package

FORMS = 4
#: Leaves of a class, classes of frequent words, all classes: the last ``FORMS`` hold shared leaves.
LEAVES, FREQUENT = 64, 60
CLASSES = FREQUENT + FORMS
#: What stands beyond the ends of a text.
EDGE = CLASSES * LEAVES
#: Words whose counts are sent to every task; the counts of all others are joined.
SENT = 1 << 18
#: Width of the network, rounds of averaging, one in how many tokens a round masks.
WIDTH, ROUNDS, MASK = 24, 3, 16
#: Tokens of a step, and the least number of steps a task makes in a round, over its tokens again if they are few.
STEP_TOKENS, STEPS = 4096, 80
RATE = 0.1
#: Fixed-point scale of the shares inside leaves: whole numbers add up alike in any order.
FIXED = 1 << 24
ENDS = np.zeros(256, bool)
ENDS[list(b".,;:!?|")] = True
#: Bytes of plain words: letters of ASCII and all of other scripts.
PLAIN = np.zeros(256, bool)
PLAIN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

# Rows of the weight matrix: words on the left, words on the right, scales of the outer two, bias, classes, leaves.
LEFT, RIGHT = 0, EDGE + 1
SCALES = 2 * (EDGE + 1)
BIAS = SCALES + 2
UP = BIAS + 1
DOWN = UP + CLASSES
ROWS = DOWN + EDGE


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words on one line, words per text, and each code's word key and form; the key's low bits are the form."""
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = list(chain.from_iterable(words))
    codes, unique = pd.factorize(flat)
    if not len(unique):
        return codes, counts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, unique), np.int64, len(unique))
    data = np.frombuffer(b"".join(unique), np.uint8)
    last = np.cumsum(sizes) - 1
    first, end = data[last - sizes + 1], ENDS[data[last]]
    odd = np.add.reduceat(~PLAIN[data], last - sizes + 1) - end
    form = np.where(odd > 0, 3, np.where(end, 2, np.where((first >= 65) & (first <= 90), 1, 0)))
    key = pd.util.hash_array(unique, categorize=False).view(np.int64) & ~np.int64(FORMS - 1)
    return codes, counts, key | form, form.astype(np.int64)


def shared_leaf(key):
    """Leaf that a word without a leaf of its own shares; for arrays and for columns."""
    form = key % FORMS if isinstance(key, np.ndarray) else key.bitwiseAND(F.lit(FORMS - 1))
    part = (key >> 2) % LEAVES if isinstance(key, np.ndarray) else F.shiftright(key, 2).bitwiseAND(F.lit(LEAVES - 1))
    return (form + FREQUENT) * LEAVES + part


def windows(leaves: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Far left, left, right and far right neighbour of every token, as rows."""
    at = np.arange(len(leaves)) - np.repeat(B.starts_of(counts), counts)
    to = np.repeat(counts, counts) - 1 - at
    pad = np.concatenate([[EDGE, EDGE], leaves, [EDGE, EDGE]])
    n = len(leaves)
    return np.stack([np.where(side > k, pad[s : n + s], EDGE) for side, k, s in ((at, 1, 0), (at, 0, 1), (to, 0, 3), (to, 1, 4))])


def word_counts(docs: DataFrame) -> DataFrame:
    """``key, n`` of every word of the corpus, written once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.chunks(parts):
            codes, _, key, _ = tokens(B.raw_texts(part))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(codes, minlength=len(key)), pa.int64())], names=["key", "n"])

    ship_package(docs.sparkSession)
    return cut_lineage(docs.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")))


@dataclass
class Words:
    """The most frequent words by rising key: count and leaf; per leaf its smoothed tokens."""

    keys: np.ndarray
    n: np.ndarray
    leaf: np.ndarray
    mass: np.ndarray

    def leaves(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each word, and its count: -1 where only the table knows it."""
        if not len(self.keys):
            return shared_leaf(key), np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return np.where(known, self.leaf[at], shared_leaf(key)), np.where(known, self.n[at], -1)


def vocabulary(counts: DataFrame) -> Words:
    """Leaves of their own go to the most frequent words, classes hold words of like form and count."""
    got = counts.orderBy(F.desc("n"), "key").limit(SENT).toArrow()
    key, n = (got.column(c).to_numpy().astype(np.int64) for c in ("key", "n"))
    own = min(len(key), FREQUENT * LEAVES)
    leaf = shared_leaf(key)
    place = np.lexsort((np.arange(own), key[:own] % FORMS))
    leaf[place] = np.arange(own)
    mass = np.zeros(EDGE)
    mass[leaf[:own]] = n[:own]
    mass[FREQUENT * LEAVES :] = 0.5  # a word that was never seen
    if own < len(key):
        below = (F.col("n") < int(n[own - 1])) | ((F.col("n") == int(n[own - 1])) & (F.col("key") > int(key[own - 1])))
        rest = counts.filter(below).groupBy(shared_leaf(F.col("key")).alias("leaf")).agg(F.sum(F.col("n") + 0.5).alias("mass")).toArrow()
        mass[rest.column("leaf").to_numpy()] += rest.column("mass").to_numpy()
    order = np.argsort(key)
    return Words(key[order], n[order], leaf[order], mass)


def coded(docs: DataFrame, words: Words, own: int, id_col: str = "doc_id") -> DataFrame:
    """``row, id, n_tokens, leaves, known, rare`` of every document, written once, so that row numbers hold.

    ``known`` is the fixed-point sum of log shares inside leaves for words that tasks know, ``rare``
    the keys of all others; ``own`` is 1 where the corpus counted these documents.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for part in B.chunks(parts):
            codes, counts, key, _ = tokens(B.raw_texts(part))
            leaf, n = words.leaves(key)
            shared = leaf >= FREQUENT * LEAVES
            seen = np.maximum(n, own)
            share = np.where(shared & (n >= 0), np.rint(np.log((seen - own + 0.5) / np.where(shared, words.mass[leaf] - own, 1)) * FIXED), 0).astype(np.int64)
            ask = (n < 0)[codes]
            before = np.concatenate([[0], np.cumsum(ask)])
            ends = np.cumsum(counts)
            known = np.concatenate([[0], np.cumsum(share[codes])])
            line = leaf[codes].astype(np.int16).tobytes()
            blobs = [line[2 * a : 2 * b] for a, b in zip(ends - counts, ends)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(len(counts)), pa.int64()), part.column("id"), pa.array(counts), pa.array(blobs, pa.binary()),
                    pa.array(known[ends] - known[ends - counts]), B.ragged(key[codes][ask], before[ends] - before[ends - counts], pa.int64()),
                ],
                names=["row", "id", "n_tokens", "leaves", "known", "rare"],
            )
            row += len(counts)

    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    schema = f"row bigint, id {kind}, n_tokens bigint, leaves binary, known bigint, rare array<bigint>"
    return cut_lineage(docs.selectExpr(f"`{id_col}` as id", "text").mapInArrow(run, schema))


def _slices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in slices of half a million tokens; a longer single text is a slice of its own."""
    return B.chunks(parts, "leaves", 1 << 20)


def _leaves(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of all rows on one line, tokens per row."""
    line = np.frombuffer(b"".join(part.column("leaves").to_pylist()), np.int16).astype(np.int64)
    return line, part.column("n_tokens").to_numpy()


def started(words: Words, seed: int = 4) -> np.ndarray:
    """First weights: random words, and outputs that give every leaf its share of the corpus."""
    rng = np.random.default_rng(seed)
    w = np.zeros((ROWS, WIDTH + 1), np.float32)
    w[:SCALES, :WIDTH] = rng.normal(0, 0.3, (SCALES, WIDTH))
    w[SCALES:BIAS, :WIDTH] = 0.5
    by_class = words.mass.reshape(CLASSES, LEAVES)
    total = by_class.sum(axis=1)
    low = np.exp(-30.0)
    w[UP:DOWN, WIDTH] = np.log(np.maximum(total / max(1, total.sum()), low))
    w[DOWN:, WIDTH] = np.log(np.maximum(by_class / np.maximum(total, low)[:, None], low)).ravel()
    return w


def _hidden(w: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    far_left, far_right = w[LEFT + near[0], :WIDTH], w[RIGHT + near[3], :WIDTH]
    x = w[LEFT + near[1], :WIDTH] + w[RIGHT + near[2], :WIDTH] + w[BIAS, :WIDTH]
    x += far_left * w[SCALES, :WIDTH] + far_right * w[SCALES + 1, :WIDTH]
    h = np.ones((near.shape[1], WIDTH + 1), np.float32)
    np.tanh(x, out=h[:, :WIDTH])
    return h, far_left, far_right


def _logs(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def _by_class(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every class among the targets and the places of its tokens."""
    order = np.argsort(target // LEAVES, kind="stable")
    many = np.bincount(target // LEAVES, minlength=CLASSES)
    at = np.cumsum(many) - many
    for c in np.flatnonzero(many):
        yield int(c), order[at[c] : at[c] + many[c]]


def log_chances(w: np.ndarray, near: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of the leaf at each place, given its four neighbours."""
    out = np.empty(len(target), np.float64)
    for a in range(0, len(target), 4 * STEP_TOKENS):
        goal = target[a : a + 4 * STEP_TOKENS]
        h, _, _ = _hidden(w, near[:, a : a + len(goal)])
        got = _logs(h @ w[UP:DOWN].T)[np.arange(len(goal)), goal // LEAVES].astype(np.float64)
        for c, at in _by_class(goal):
            down = w[DOWN + c * LEAVES : DOWN + (c + 1) * LEAVES]
            got[at] += _logs(h[at] @ down.T)[np.arange(len(at)), goal[at] % LEAVES]
        out[a : a + len(goal)] = got
    return out


def _moved(w: np.ndarray, size: np.ndarray, used: np.ndarray, rows, grad: np.ndarray, times) -> None:
    """One scaled step of some rows; a row's steps shrink with the sum of its squared gradients."""
    size[rows] += np.square(grad).mean(axis=1)
    w[rows, : grad.shape[1]] -= RATE * grad / np.sqrt(size[rows] + 1e-12)[:, None]
    used[rows] += times


def _summed(places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct places, the sum of the values at each, and how many there were."""
    order = np.argsort(places, kind="stable")
    rows, first, many = np.unique(places[order], return_index=True, return_counts=True)
    return rows, np.add.reduceat(values[order], first, axis=0), many


def step(w: np.ndarray, size: np.ndarray, used: np.ndarray, near: np.ndarray, target: np.ndarray) -> None:
    """Move the weights towards the masked tokens of one step."""
    n = len(target)
    h, far_left, far_right = _hidden(w, near)
    p = np.exp(_logs(h @ w[UP:DOWN].T))
    p[np.arange(n), target // LEAVES] -= 1
    p /= n
    back = p @ w[UP:DOWN]
    up = p.T @ h
    for c, at in _by_class(target):
        rows = slice(DOWN + c * LEAVES, DOWN + (c + 1) * LEAVES)
        q = np.exp(_logs(h[at] @ w[rows].T))
        q[np.arange(len(at)), target[at] % LEAVES] -= 1
        q /= n
        back[at] += q @ w[rows]
        _moved(w, size, used, rows, q.T @ h[at], len(at))
    dx = back[:, :WIDTH] * (1 - np.square(h[:, :WIDTH]))
    outer = w[SCALES:BIAS, :WIDTH].copy()
    _moved(w, size, used, slice(UP, DOWN), up, n)
    _moved(w, size, used, slice(SCALES, BIAS + 1), np.stack([(dx * far_left).sum(axis=0), (dx * far_right).sum(axis=0), dx.sum(axis=0)]), n)
    for base, inner, far, scale in ((LEFT, near[1], near[0], outer[0]), (RIGHT, near[2], near[3], outer[1])):
        rows, grad, many = _summed(np.concatenate([inner, far]), np.concatenate([dx, dx * scale]))
        _moved(w, size, used, base + rows, grad, many)


def masked(rows: np.ndarray, counts: np.ndarray, part: int) -> np.ndarray:
    """Places of the tokens that are masked in one round, by a hash of row and place."""
    at = np.arange(int(counts.sum())) - np.repeat(B.starts_of(counts), counts)
    with np.errstate(over="ignore"):
        mix = B.mixed(np.repeat(rows, counts).astype(np.uint64) * B.STEP + at.astype(np.uint64))
    return np.flatnonzero(mix % np.uint64(MASK) == part)


def trained(data: DataFrame, words: Words) -> np.ndarray:
    """Weights after all rounds; a round's result is the mean over tasks of each row, weighed by use."""
    w, size = started(words), np.zeros(ROWS, np.float32)
    columns = [f"c{k}" for k in range(WIDTH + 2)]
    schema = "row int, used double, " + ", ".join(f"{c} float" for c in columns)
    for k in range(ROUNDS):

        def run(parts: Iterator[pa.RecordBatch], w=w, size=size, k=k) -> Iterator[pa.RecordBatch]:
            w, size, used = w.copy(), size.copy(), np.zeros(ROWS)
            held, waiting, steps = [], np.zeros((5, 0), np.int64), 0
            for part in _slices(parts):
                line, counts = _leaves(part)
                at = masked(part.column("row").to_numpy(), counts, k)
                waiting = np.concatenate([waiting, np.concatenate([windows(line, counts)[:, at], line[None, at]])], axis=1)
                full = waiting.shape[1] // STEP_TOKENS
                for a in range(0, full * STEP_TOKENS, STEP_TOKENS):
                    now = waiting[:, a : a + STEP_TOKENS]
                    step(w, size, used, now[:4], now[4])
                    steps += 1
                    if len(held) < STEPS:
                        held.append(now.copy())
                waiting = waiting[:, full * STEP_TOKENS :].copy()
            if waiting.shape[1]:
                held.append(waiting)
                step(w, size, used, waiting[:4], waiting[4])
                steps += 1
            if held:
                for again in range(max(0, STEPS - steps)):
                    now = held[again % len(held)]
                    step(w, size, used, now[:4], now[4])
            rows = np.flatnonzero(used)
            values = np.concatenate([w[rows], size[rows, None]], axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), pa.array(used[rows]), *(pa.array(values[:, c], pa.float32()) for c in range(WIDTH + 2))], names=["row", "used", *columns]
            )

        mean = [(F.sum(F.col(c) * F.col("used")) / F.sum("used")).cast("float").alias(c) for c in columns]
        got = data.select("row", "n_tokens", "leaves").mapInArrow(run, schema).groupBy("row").agg(*mean).toArrow()
        rows = got.column("row").to_numpy()
        w, size = w.copy(), size.copy()
        for c, name in enumerate(columns[:-1]):
            w[rows, c] = got.column(name).to_numpy()
        size[rows] = got.column(columns[-1]).to_numpy()
    return w


@dataclass
class Model:
    """Counts of all words, the words that tasks know, and the weights of the network."""

    counts: DataFrame
    words: Words
    weights: np.ndarray


def fit(docs: DataFrame) -> Model:
    counts = word_counts(docs)
    words = vocabulary(counts)
    return Model(counts, words, trained(coded(docs.selectExpr("cast(null as bigint) as doc_id", "text"), words, 1), words))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``id, n_tokens, log_likelihood, per_token`` of every whole text; the texts are not the model's own."""
    return _score(coded(docs, model.words, 0, id_col), model, 0).withColumnRenamed("id", id_col)


def _score(data: DataFrame, model: Model, own: int) -> DataFrame:
    """Scores of documents; ``own`` is 1 where the model counted them, and a token's own sighting is left out of its share."""
    w, kind = model.weights, dict(data.dtypes)["id"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            line, counts = _leaves(part)
            sums = B.run_sums(log_chances(w, windows(line, counts), line), counts)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "id", "n_tokens", "known")), pa.array(sums)], names=["row", "id", "n_tokens", "known", "net"])

    net = data.select("row", "id", "n_tokens", "known", "leaves").mapInArrow(run, f"row bigint, id {kind}, n_tokens bigint, known bigint, net double")
    mass = F.array(*(F.lit(float(m)) for m in model.words.mass[FREQUENT * LEAVES :]))
    of_leaf = F.get(mass, (shared_leaf(F.col("key")) - FREQUENT * LEAVES).cast("int"))
    share = F.log((F.greatest(F.coalesce("n", F.lit(own)), F.lit(own)) - own + 0.5) / (of_leaf - own))
    asked = data.select("row", F.explode("rare").alias("key")).join(model.counts, "key", "left")
    rare = asked.groupBy("row").agg(F.sum(F.rint(share * FIXED).cast("bigint")).alias("rare"))
    total = F.col("net") + (F.col("known") + F.coalesce("rare", F.lit(0))) / F.lit(float(FIXED))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return net.join(rare, "row", "left").select("id", "n_tokens", total.alias("log_likelihood")).withColumn("per_token", mean)


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, per_token`` under a model of all ``docs``.

    Inside a shared leaf a token is scored by the counts of all others. Defined cases: null and
    empty texts have no tokens, log-likelihood 0 and no mean; texts of one token are predicted
    from the edges; repeated rows count as often as they stand in the corpus and score alike, but
    for the last digits of single-precision arithmetic; an empty table gives no rows; other
    columns are not read. Weights are averaged over tasks, so another partitioning of the same
    rows gives slightly other scores.
    """
    counts = word_counts(docs)
    words = vocabulary(counts)
    data = coded(docs, words, 1)
    return _score(data, Model(counts, words, trained(data, words)), 1).withColumnRenamed("id", "doc_id")
