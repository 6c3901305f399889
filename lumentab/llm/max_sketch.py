"""Ranked lexical search with hashed max-sketches.

The sketch of a document is an array of some power of two of bytes. Every term has three
coordinates, cut from its hash, and a coordinate keeps the largest term frequency that falls on
it. A term's impact grows with its frequency, so the impact at the least of a term's coordinates
is an upper bound of its impact in the document, and sums over a query's terms bound the score:

1. One pass writes the sketches, one counts the documents that hold a query term.
2. Batched lookups bound every document for every query of a block; the rows of the highest
   bounds are scored exactly, which gives each query a threshold.
3. The other documents are scored exactly by falling bound, until the bounds pass below the
   threshold, which rises with every score found.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lumentab.llm import batches as B
from lumentab.session import ship_package
from lumentab.sources.folders import run_folder

#: Bytes of a term: A-Z lower-cased, digits, a-z, everything beyond ASCII; all others separate.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Coordinates per distinct term (rounded up to a power of two), and the smallest and largest sketch.
SPREAD, LEAST, MOST = 16, 64, 1 << 20
#: Bits of a term's hash before each of its coordinates.
SKIPS = (0, 20, 40)
#: Frequencies that a sketch tells apart; this one stands for itself and all above.
TOP = 255
#: Queries and their distinct terms that are looked up together; a query of more terms is a block of its own.
ITEMS, TERMS = 256, 1 << 14
#: Impacts looked up at once.
CELLS = 1 << 21
RANKS = 50
UNIT = 1_000_000_000


def _terms(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def _coded(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms per row, the chunk's distinct terms, then row, term and frequency of every term of a row."""
    words = [_terms(t) for t in B.raw_texts(part)]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = list(chain.from_iterable(words))
    codes, distinct = pd.factorize(flat)
    if not len(distinct):
        return counts, distinct, *(np.zeros(0, np.int64) for _ in range(3))
    pair, tf = np.unique(np.repeat(np.arange(len(words)), counts) * len(distinct) + codes, return_counts=True)
    return counts, distinct, pair // len(distinct), pair % len(distinct), tf


def _hashes(terms: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(terms, categorize=False) if len(terms) else np.zeros(0, np.uint64)


def _coordinates(hashes: np.ndarray, width: np.ndarray) -> Iterator[np.ndarray]:
    for skip in SKIPS:
        yield ((hashes >> np.uint64(skip)) & (width - 1).astype(np.uint64)).astype(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n, sketch, text`` of every document that has a term; ``n`` counts its terms."""
    ship_package(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.chunks(parts):
            counts, distinct, row, term, tf = _coded(part)
            some = np.flatnonzero(counts)
            if not len(some):
                continue
            own = np.bincount(row, minlength=len(counts))
            width = np.where(own > 0, np.clip(1 << np.ceil(np.log2(np.maximum(own * SPREAD, 1))).astype(np.int64), LEAST, MOST), 0)
            start = B.starts_of(width)
            flat = np.zeros(int(width.sum()), np.uint8)
            tops = np.minimum(tf, TOP).astype(np.uint8)
            for coordinate in _coordinates(_hashes(distinct)[term], width[row]):
                np.maximum.at(flat, start[row] + coordinate, tops)
            ends = np.r_[0, np.cumsum(width[some])].astype(np.int32)
            sketch = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            at = pa.array(some)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), pa.array(counts[some]), sketch, part.column("text").take(at)], names=["doc_id", "n", "sketch", "text"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, sketch binary, text string")


class Block:
    """Some queries: their terms, weights and, per query, the places of its terms."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]]):
        self.ids = [i for i, _ in items]
        self.vocabulary = {t: k for k, t in enumerate(dict.fromkeys(chain.from_iterable(t for _, t in items)))}
        self.places = [np.array([self.vocabulary[t] for t in terms], np.int64) for _, terms in items]
        self.weights = np.zeros(len(self.vocabulary), np.int64)
        self.documents = self.length = 0

    def weigh(self, frequencies: dict[int, int], documents: int, length: int) -> None:
        self.documents, self.length = documents, length
        for k in range(len(self.weights)):
            self.weights[k] = math.floor(1000 * math.log((2 * documents + 2) / (2 * frequencies.get(k, 0) + 1)))

    def damping(self, n: np.ndarray) -> np.ndarray:
        """The part of m that grows with a document's length, and its constant."""
        return 100 - 50 + (50 * n * self.documents) // self.length

    def prepare(self) -> None:
        """In a task: hashes and, as one matrix, the weights of every query's terms."""
        if not hasattr(self, "matrix"):
            words = np.empty(len(self.vocabulary), dtype=object)
            words[:] = list(self.vocabulary)
            self.hashes = _hashes(words)
            self.matrix = np.zeros((len(words), len(self.ids)), np.float32)
            for k, places in enumerate(self.places):
                self.matrix[places, k] = self.weights[places]
            self.firsts = B.starts_of(np.array([len(p) for p in self.places], np.int64))
            self.line = np.concatenate(self.places)
            # sums of single precision are off by no more than their number of terms in last places
            self.slack = 1.0 + (max(map(len, self.places)) + 8) * 2.0**-22

    def bounds(self, part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers of the batch and an upper bound of their scores, one column per query."""
        self.prepare()
        column = part.column("sketch")
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        width = np.diff(offsets)
        m = 20 * self.damping(part.column("n").to_numpy()).astype(np.float32)
        step = max(1, CELLS // max(1, len(self.hashes)))
        for w in np.unique(width):
            coordinates = list(_coordinates(self.hashes, np.int64(w)))
            rows = np.flatnonzero(width == w)
            for a in range(0, len(rows), step):
                some = rows[a : a + step]
                lines = data[offsets[some][:, None] + np.arange(w)] if len(some) * w < CELLS * 4 else np.stack([data[offsets[r] : offsets[r] + w] for r in some])
                tf = reduce(np.minimum, (lines[:, c] for c in coordinates)).astype(np.float32)
                impact = UNIT * tf / (1000 * tf + m[some][:, None])
                impact[tf == TOP] = UNIT / 1000
                yield some, (impact @ self.matrix) * self.slack

    def scores(self, text: bytes) -> np.ndarray:
        """Exact scores of a text for every query of the block."""
        words = _terms(text)
        held = [k for k in map(self.vocabulary.get, words) if k is not None]
        tf = np.bincount(np.array(held, np.int64), minlength=len(self.weights))
        m = int(self.damping(np.array([len(words)]))[0])
        worth = self.weights * ((UNIT * tf) // (1000 * tf + 20 * m))
        return np.add.reduceat(worth[self.line], self.firsts)


def _blocks(items: DataFrame) -> Iterator[Block]:
    """The queries, in blocks of a bounded number; those without a term can have no result."""
    held, size = [], 0
    for item, text in items.select(F.col("item_id").cast("bigint"), "text").orderBy("item_id").toLocalIterator():
        terms = list(dict.fromkeys(_terms((text or "").encode())))
        if not terms:
            continue
        if held and (len(held) >= ITEMS or size + len(terms) > TERMS):
            yield Block(held)
            held, size = [], 0
        held.append((item, terms))
        size += len(terms)
    if held:
        yield Block(held)


def frequencies(index: DataFrame, block: Block) -> dict[int, int]:
    """Documents that hold each term of the block, over all documents."""
    vocabulary = block.vocabulary

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for part in B.chunks(parts):
            _, distinct, _, term, _ = _coded(part)
            number = np.fromiter((vocabulary.get(t, len(vocabulary)) for t in distinct), np.int64, len(distinct))
            np.add.at(total, number, np.bincount(term, minlength=len(distinct)))
        some = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])

    return dict(index.select("text").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df")).collect())


def _best(rows: DataFrame, by: str, count: int) -> DataFrame:
    """Rows of the ``count`` highest values of each item; the rank is cut in each task before the exchange."""
    order = Window.partitionBy("item").orderBy(F.desc(by), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def _highest_bounds(index: DataFrame, block: Block, ranks: int) -> DataFrame:
    """``doc_id, items``: for each query the documents of its highest bounds, some per task, ``2 * ranks`` at most."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = len(block.ids)
        best, owner = np.zeros((0, columns), np.float32), np.zeros((0, columns), np.int64)
        for part in parts:
            if not part.num_rows:
                continue
            ids = part.column("doc_id").to_numpy()
            for rows, bound in block.bounds(part):
                best, owner = np.concatenate([best, bound]), np.concatenate([owner, np.broadcast_to(ids[rows][:, None], bound.shape)])
                if len(best) > ranks:
                    top = np.argpartition(-best, ranks - 1, axis=0)[:ranks]
                    best, owner = np.take_along_axis(best, top, 0), np.take_along_axis(owner, top, 0)
        row, item = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(owner[row, item]), pa.array(best[row, item].astype(np.float64))], names=["item", "doc_id", "bound"])

    found = index.filter("doc_id is not null").select("doc_id", "n", "sketch").mapInArrow(run, "item int, doc_id bigint, bound double")
    return _best(found, "bound", 2 * ranks).groupBy("doc_id").agg(F.collect_set("item").alias("items"))


SCORED = "item int, doc_id bigint, score bigint"


def _scored(rows: list[tuple[int, int | None, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])


def _thresholds(index: DataFrame, block: Block, ranks: int) -> np.ndarray:
    """A score that ``ranks`` documents reach, for every query; 1 where so many aren't known yet."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block.prepare()
        for part in B.chunks(parts):
            out = []
            for text, doc, items in zip(B.raw_texts(part), part.column("doc_id").to_pylist(), part.column("items").to_pylist()):
                scores = block.scores(text)
                out += [(k, doc, int(scores[k])) for k in items]
            yield _scored(out)

    # at most 2 * ranks documents for each of the block's queries
    seeds = F.broadcast(_highest_bounds(index, block, ranks))
    exact = index.select("doc_id", "text").join(seeds, "doc_id").mapInArrow(run, SCORED)
    reached = np.ones(len(block.ids), np.int64)
    for item, score in _best(exact, "score", ranks).filter(F.col("rank") == ranks).select("item", "score").collect():
        reached[item] = max(1, score)
    return reached


class Ranking:
    """The best rows so far of each query, and the score that a further one must reach."""

    def __init__(self, reached: np.ndarray, ranks: int):
        self.reached, self.ranks = reached.copy(), ranks
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in reached]

    def add(self, item: int, doc: int | None, score: int) -> None:
        heap = self.heaps[item]
        entry = (score, -doc if doc is not None else -(1 << 70))
        if len(heap) < self.ranks:
            heapq.heappush(heap, entry)
        else:
            heapq.heappushpop(heap, entry)
        if len(heap) == self.ranks:
            self.reached[item] = max(self.reached[item], heap[0][0])

    def rows(self) -> list[tuple[int, int | None, int]]:
        return [(k, None if d == -(1 << 70) else -d, s) for k, heap in enumerate(self.heaps) for s, d in heap]


def _rescored(index: DataFrame, block: Block, reached: np.ndarray, ranks: int) -> DataFrame:
    """Exact scores that can be among the ``ranks`` highest, by falling bound."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block.prepare()
        ranking = Ranking(reached, ranks)
        for part in B.chunks(parts):
            rows, bounds = [], []
            for some, bound in block.bounds(part):
                row, item = np.nonzero(bound >= ranking.reached)
                rows.append(np.stack([some[row], item], axis=1))
                bounds.append(bound[row, item])
            pairs, bound = np.concatenate(rows), np.concatenate(bounds)
            order = np.lexsort((-bound, pairs[:, 1]))
            pairs, bound = pairs[order], bound[order]
            # the highest bound of every query first, then the second of every query, and so on
            first = np.r_[True, pairs[1:, 1] != pairs[:-1, 1]] if len(pairs) else np.zeros(0, bool)
            turn = np.arange(len(pairs)) - np.maximum.accumulate(np.where(first, np.arange(len(pairs)), 0))
            order = np.argsort(turn, kind="stable")
            ids, texts, known = part.column("doc_id"), part.column("text"), {}
            of_row: dict[int, np.ndarray] = {}
            for (row, item), upper in zip(pairs[order].tolist(), bound[order].tolist()):
                if upper < ranking.reached[item]:
                    continue
                if row not in of_row:
                    text = texts[row].as_py().encode()
                    # equal texts of a chunk are scored once
                    of_row[row] = known[text] if text in known else known.setdefault(text, block.scores(text))
                score = int(of_row[row][item])
                if score >= ranking.reached[item]:
                    ranking.add(item, ids[row].as_py(), score)
        yield _scored(ranking.rows())

    return _best(index.mapInArrow(run, SCORED), "score", ranks)


def search(docs: DataFrame, items: DataFrame, ranks: int = RANKS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``ranks`` highest-scoring documents of each item.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``; other columns are not read.
    Only documents that score above 0 are ranked, equal scores by ascending ``doc_id``, rows
    without an id last. Defined cases: null, empty and termless documents count in no statistic
    and are never found; rows that share an id or a text are documents of their own; null, empty
    and termless items have no rows; repeated items get their rows each; empty tables give none.
    """
    spark = docs.sparkSession
    folder = run_folder(spark, "max-sketch")
    sketches(docs).write.option("compression", "zstd").parquet(folder)
    index = spark.read.parquet(folder)
    totals = index.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    found = []
    for block in _blocks(items):
        if not totals["documents"]:
            break
        block.weigh(frequencies(index, block), totals["documents"], totals["length"])
        best = _rescored(index, block, _thresholds(index, block, ranks), ranks)
        names = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id bigint")
        found.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
