"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point and a seed. A letter
n-gram binds the vectors of its letters, each permuted (turned) by its place, by multiplication;
a text bundles, that is adds up, its n-grams; a language bundles the texts it is learned from.
A text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumentab.llm import batches as B
from lumentab.session import ship_package

#: Entries of a vector, letters of an n-gram, seed of the letter vectors.
DIMENSIONS, GRAM, SEED = 1024, 3, 20
#: Characters looked at together; a run of letters longer than this is cut here.
PIECE = 1 << 20
#: n-gram vectors held at once.
SLICE = 1 << 13
#: Learned languages, at most; their prototypes go to every task.
LANGUAGES = 4096
UNKNOWN = "und"

_folded = np.full(0x110000, -1, np.int32)


def folded(points: np.ndarray) -> np.ndarray:
    """Lower-case code points of letters, 0 for everything else; filled as code points turn up."""
    got = _folded[points]
    if len(got) and got.min() < 0:
        for p in np.unique(points[got < 0]).tolist():
            c = chr(p)
            _folded[p] = ord(c.lower()[0]) if c.isalpha() else 0
        got = _folded[points]
    return got


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """+1 and -1 by a hash of seed, code point and place; 0, the gap beside a word, has one as well."""
    with np.errstate(over="ignore"):
        own = B.mixed((points.astype(np.uint64) + np.uint64(SEED << 32)) * B.STEP)
        words = B.mixed(own[:, None] + np.arange(1, dimensions // 64 + 1, dtype=np.uint64) * B.STEP)
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """The text in parts of at most ``limit`` characters, cut behind the last non-letter of a part."""
    at = 0
    while len(text) - at > limit:
        to = at + limit
        while to > at and text[to - 1].isalpha():
            to -= 1
        to = to if to > at else at + limit
        yield text[at:to]
        at = to
    yield text[at:]


class Grams:
    """n-grams inside the words of some pieces, gap included on both sides, and how often a row has each."""

    def __init__(self, rows: list[int], parts: list[str], dimensions: int):
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 2
        points = folded(np.frombuffer("".join(f"\n{p}\n" for p in parts).encode("utf-32-le"), np.uint32))
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        # of gaps side by side in one piece the first stays
        stay = (points != 0) | np.r_[True, (points[:-1] != 0) | (owner[1:] != owner[:-1])]
        points, owner = points[stay], owner[stay]
        codes, alphabet = pd.factorize(points)
        n = max(0, len(points) - GRAM + 1)
        whole = owner[:n] == owner[GRAM - 1 :] if n else np.zeros(0, bool)
        for j in range(1, GRAM - 1):
            whole &= points[j : j + n] != 0
        starts = np.flatnonzero(whole)
        base = max(1, len(alphabet))
        key = np.zeros(len(starts), np.int64)
        for j in range(GRAM):
            key = key * base + codes[starts + j]
        gram, found = pd.factorize(key)
        owners = np.asarray(rows, np.int64)[owner[starts]]
        pair, self.count = np.unique(owners * max(1, len(found)) + gram, return_counts=True)
        self.row, self.gram = pair // max(1, len(found)), pair % max(1, len(found))
        letters = letter_vectors(alphabet, dimensions)
        self._turned = [np.roll(letters, GRAM - 1 - j, axis=1) for j in range(GRAM)]
        self._letters = [(found // base ** (GRAM - 1 - j)) % base for j in range(GRAM)]
        self.size = len(found)

    def vectors(self, a: int, b: int) -> np.ndarray:
        """Bound vectors of the n-grams from a to b."""
        out = self._turned[0][self._letters[0][a:b]]
        for turned, letter in zip(self._turned[1:], self._letters[1:]):
            out = out * turned[letter[a:b]]
        return out

    def bundle(self, owner: np.ndarray, into: np.ndarray) -> None:
        """Add every n-gram to the line that ``owner`` gives its row; -1 leaves it out."""
        line = owner[self.row]
        for a in range(0, self.size, SLICE):
            b = min(a + SLICE, self.size)
            here = np.flatnonzero((self.gram >= a) & (self.gram < b) & (line >= 0))
            if not len(here):
                continue
            vectors = self.vectors(a, b)
            at = here[np.argsort(line[here], kind="stable")]
            lines, first = np.unique(line[at], return_index=True)
            for to, part in zip(lines.tolist(), np.split(at, first[1:])):
                gram, count = self.gram[part] - a, self.count[part].astype(np.float32)
                into[to] += count @ vectors[gram].astype(np.float32)


def gram_groups(part: pa.RecordBatch, dimensions: int) -> Iterator[Grams]:
    rows, parts, size = [], [], 0
    for row, text in enumerate(part.column("text").to_pylist()):
        for piece in pieces(text or ""):
            if parts and size + len(piece) > PIECE:
                yield Grams(rows, parts, dimensions)
                rows, parts, size = [], [], 0
            rows.append(row)
            parts.append(piece)
            size += len(piece)
    yield Grams(rows, parts, dimensions)


def learned_from() -> F.Column:
    """Rows that may be learned from: those that are not held out and have a language."""
    return ~held_out() & F.col("lang").isNotNull()


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Bundle of each language over all its rows that are not held out; sums are whole numbers, exact in any order."""
    ship_package(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def lines() -> pa.RecordBatch:
            names = list(held)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(names, object), dimensions), pa.string()), pa.array(np.tile(np.arange(dimensions, dtype=np.int32), len(names))), pa.array(np.concatenate([held[x] for x in names]))],
                names=["lang", "i", "v"],
            )

        for part in B.chunks(parts):
            code, names = pd.factorize(np.array(part.column("lang").to_pylist(), object))
            for grams in gram_groups(part, dimensions):
                here = np.zeros((len(names), dimensions), np.float32)
                # a group has at most PIECE n-grams, so single precision counts them exactly
                _by_language(grams, code[grams.row], here)
                for name, line in zip(names, here):
                    held[name] = held.get(name, 0) + line.astype(np.int64)
            if len(held) > 256:
                yield lines()
                held.clear()
        if held:
            yield lines()

    sums = docs.filter(learned_from()).select("text", "lang").mapInArrow(run, "lang string, i int, v bigint").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    each = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("line")).filter(F.exists("line", lambda e: e["v"] != 0))
    rows = each.limit(LANGUAGES + 1).collect()
    if len(rows) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    return {r["lang"]: np.array([v for _, v in r["line"]], np.float64) for r in sorted(rows, key=lambda r: r["lang"])}


def _by_language(grams: Grams, language: np.ndarray, into: np.ndarray) -> None:
    """Bundles per language; counts are summed up first, so an n-gram vector is added once a language."""
    for a in range(0, grams.size, SLICE):
        b = min(a + SLICE, grams.size)
        here = np.flatnonzero((grams.gram >= a) & (grams.gram < b))
        if len(here):
            width = b - a
            counts = np.bincount(language[here] * width + grams.gram[here] - a, weights=grams.count[here], minlength=len(into) * width)
            into += counts.reshape(len(into), width).astype(np.float32) @ grams.vectors(a, b).astype(np.float32)


def predict(docs: DataFrame, learned: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> DataFrame:
    """``doc_id, lang_pred, score``: language of the largest cosine, ties to the first by name, and that cosine (0 if negative).

    A text that is null or has no letter, and any text where nothing was learned, is ``und`` with score 0.
    """
    ship_package(docs.sparkSession)
    names = np.array([*learned, UNKNOWN], object)
    to = np.array([v / np.linalg.norm(v) for v in learned.values()]).reshape(len(learned), dimensions).T.astype(np.float32)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.chunks(parts):
            rows = part.num_rows
            bundled = np.zeros((rows, dimensions), np.float32)
            some = np.zeros(rows, bool)
            for grams in gram_groups(part, dimensions):
                grams.bundle(np.arange(rows), bundled)
                some[grams.row] = True
            best, score = np.full(rows, len(names) - 1), np.zeros(rows)
            if len(names) > 1:
                cosine = (bundled @ to) / np.maximum(np.linalg.norm(bundled, axis=1), 1e-30)[:, None]
                best = np.where(some, cosine.argmax(axis=1), best)
                score = np.where(some, np.clip(cosine.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score.astype(np.float64))], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every whole text.

    Learns from ``text`` and non-null ``lang`` of rows whose ``crc32(doc_id) % 4`` is not 2; a row
    without an id is learned from and not held out. ``lang``, ``source`` and ``doc_id`` are never
    inputs of a prediction. Letters are the Unicode letters, lower-cased, all else is a gap.
    Defined cases: null, empty and letterless texts are ``und`` with score 0; very long texts are
    worked through in pieces cut at gaps, without loss; repeated rows are predicted alike and
    learned each; with nothing to learn from every text is ``und``; other columns are not read.
    """
    got = predict(docs, prototypes(docs, dimensions), dimensions)
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
