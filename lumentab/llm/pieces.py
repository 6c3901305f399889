"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a chunk of texts are laid on one line and their suffixes are sorted.
Every piece of the vocabulary is found by binary search as a range of that order, which gives
all edges (place, length, piece) of all texts at once. The edges are dealt to their places and
relaxed: a BPE vocabulary merges, in each segment, the neighbouring symbols whose joint edge
has the best score until no edge joins two symbols.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from lumentab.llm import batches as B
from lumentab.session import ship_package

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Symbols of a segment up to which all segments are merged side by side; longer ones use a heap.
LONG = 192
NONE = np.int64(1) << 40


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Vocabulary:
    """Pieces of a model file. Only what a task needs, so it travels with the function."""

    def __init__(self, path: str = MODEL):
        with open(path, "rb") as f:
            model = f.read()
        pieces, bpe, self.dummy_prefix, squeeze, charsmap, self.byte_fallback = [], False, True, True, b"", False
        for n, v in _fields(model):
            if n == 1:
                piece = dict(_fields(v))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, 1)))
            elif n == 2:
                trainer = dict(_fields(v))
                bpe, self.byte_fallback = trainer.get(3, 1) == 2, bool(trainer.get(35, 0))
            elif n == 3:
                normal = dict(_fields(v))
                charsmap, self.dummy_prefix, squeeze = normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1))
        if not bpe or charsmap or squeeze or not self.byte_fallback:
            raise ValueError("only BPE models with byte fallback and without text normalisation are handled")
        self.text = [p for p, _, _ in pieces]
        self.kind = np.array([k for _, _, k in pieces], np.int8)  # 1 normal, 2 unknown, 3 control, 6 byte
        normal = [i for i, (p, _, k) in enumerate(pieces) if k == 1]
        self.ids = np.array(normal, np.int32)
        self.longest = max(len(self.text[i]) for i in normal)
        score = np.array([pieces[i][1] for i in normal])
        self.order = np.full(len(pieces) + 1, NONE, np.int64)  # place by score; the last is no piece
        self.order[self.ids[np.lexsort((self.ids, -score))]] = np.arange(len(normal))
        self.byte_ids = np.zeros(256, np.int32)
        for i, (p, _, k) in enumerate(pieces):
            if k == 6:
                self.byte_ids[int(p[3:-1], 16)] = i
        # no piece has a space sign after another sign, so no merge crosses such a place
        self.splits = not any(SPACE in self.text[i].lstrip(SPACE) for i in normal)
        width = self.longest
        self.codes = np.zeros((len(normal), width), np.uint32)
        self.lengths = np.array([len(self.text[i]) for i in normal], np.int64)
        for row, i in enumerate(normal):
            self.codes[row, : self.lengths[row]] = np.frombuffer(self.text[i].encode("utf-32-le"), np.uint32)
        out = [bytes([int(p[3:-1], 16)]) if k == 6 else b"" if k in (2, 3) else p.replace(SPACE, " ").encode() for p, _, k in pieces]
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.out_sizes = np.array([len(x) for x in out], np.int64)


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, each place's rank among them, and the places in order."""
    places = np.argsort(key)
    ordered = key[places]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(len(key), np.int64)
    rank[places] = np.cumsum(new) - 1
    return ordered[new], rank, places


class SuffixOrder:
    """Suffixes of a line of codes (0 ends a segment) ordered by their first ``longest`` codes."""

    def __init__(self, line: np.ndarray, alphabet: int, longest: int):
        self.bits = int(alphabet + 1).bit_length()
        self.width = 64 // self.bits
        n = len(line)
        key, wide = np.zeros(n, np.uint64), line.astype(np.uint64)
        for j in range(self.width):
            key <<= np.uint64(self.bits)
            key[: max(0, n - j)] |= wide[j:]
        distinct, rank, self.places = _ranked(key)
        self.levels = [distinct]
        self.size = np.int64(n + 2)
        reach = self.width
        while reach < longest:
            shifted = np.zeros(n, np.int64)
            if reach < n:
                shifted[: n - reach] = rank[reach:] + 1
            distinct, rank, self.places = _ranked(rank * self.size + shifted)
            self.levels.append(distinct)
            reach *= 2
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=len(distinct)))])

    def _span(self, level: int, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of a level, from and to, whose suffixes begin with each row of ``codes``."""
        values = self.levels[level]
        if level == 0:
            low = np.zeros(len(codes), np.uint64)
            for j in range(self.width):
                low = (low << np.uint64(self.bits)) | (codes[:, j] if j < codes.shape[1] else np.uint64(0))
            free = ((self.width - np.minimum(lengths, self.width)) * self.bits).astype(np.uint64)
            return np.searchsorted(values, low), np.searchsorted(values, low + (np.uint64(1) << free))
        half = self.width << (level - 1)
        a, b = self._span(level - 1, codes[:, :half], np.minimum(lengths, half))
        low, high = a * self.size, b * self.size
        far = lengths > half
        if far.any():
            rest = np.zeros((int(far.sum()), half), codes.dtype)
            tail = codes[far][:, half : 2 * half]
            rest[:, : tail.shape[1]] = tail
            c, d = self._span(level - 1, rest, lengths[far] - half)
            low[far] = a[far] * self.size + c + 1
            high[far] = np.where(b[far] > a[far], a[far] * self.size + d + 1, low[far])
        return np.searchsorted(values, low), np.searchsorted(values, high)

    def ranges(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From and to in ``places`` of each row's occurrences."""
        low, high = self._span(len(self.levels) - 1, codes.astype(np.uint64), lengths)
        return self.ends[low], self.ends[np.maximum(low, high)]


def edges(line: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """``[place, length]`` to piece id (or the number of pieces where there is none)."""
    n, none = len(line), len(vocabulary.text)
    found = np.full((n, vocabulary.longest + 1), none, np.int32)
    signs = np.unique(line)
    signs = signs[signs != END]
    where = np.searchsorted(signs, vocabulary.codes)
    known = (where < len(signs)) & (signs[np.minimum(where, max(0, len(signs) - 1))] == vocabulary.codes) if len(signs) else np.zeros(vocabulary.codes.shape, bool)
    inside = np.arange(vocabulary.longest) < vocabulary.lengths[:, None]
    rows = np.flatnonzero((known | ~inside).all(axis=1))
    if not len(rows) or not n:
        return found
    dense = np.where(line == END, 0, np.searchsorted(signs, line) + 1).astype(np.int64)
    codes = np.where(inside[rows], where[rows] + 1, 0)
    order = SuffixOrder(dense, len(signs), vocabulary.longest)
    low, high = order.ranges(codes, vocabulary.lengths[rows])
    hits = high - low
    at = np.repeat(low - B.starts_of(hits), hits) + np.arange(hits.sum())
    # dealing the edges to (place, length) sorts them by place
    found[order.places[at], np.repeat(vocabulary.lengths[rows], hits)] = np.repeat(vocabulary.ids[rows], hits)
    return found


END = np.uint32(0x110000)


def _merge_long(start: int, size: int, found: np.ndarray, order: np.ndarray) -> list[int]:
    """Lengths of the symbols of one long segment: best edge first, the left one of equals."""
    longest = found.shape[1] - 1
    length, after, before = [1] * size, list(range(1, size + 1)), list(range(-1, size - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else size
        if j < size:
            both = length[i] + length[j]
            if both <= longest and (rank := order[found[start + i, both]]) < NONE:
                heapq.heappush(heap, (int(rank), i, both))

    for i in range(size - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if not length[i] or j >= size or length[i] + length[j] != both:
            continue
        length[i], length[j], after[i] = both, 0, after[j]
        if after[j] < size:
            before[after[j]] = i
        offer(i)
        offer(before[i])
    return [x for x in length if x]


def relax(sizes: np.ndarray, found: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the symbols that are left, in order of place.

    ``sizes`` are the segments' lengths; each is followed by an end sign. In a round every
    segment merges its best pair (the left one of equals); segments without one are done.
    """
    longest = found.shape[1] - 1
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    done_start, done_length = [], []
    for k in np.flatnonzero(sizes > LONG):
        lengths = np.array(_merge_long(int(starts[k]), int(sizes[k]), found, order), np.int64)
        done_start.append(starts[k] + B.starts_of(lengths))
        done_length.append(lengths)
    short = np.flatnonzero((sizes <= LONG) & (sizes > 0))
    segment = np.repeat(short, sizes[short])
    start = np.arange(len(segment)) - np.repeat(B.starts_of(sizes[short]) - starts[short], sizes[short])
    length = np.ones(len(segment), np.int64)
    while len(segment):
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        both = np.full(len(segment), longest + 1, np.int64)
        both[:-1] = np.where(segment[1:] == segment[:-1], length[:-1] + length[1:], longest + 1)
        rank = np.where(both <= longest, order[found[start, np.minimum(both, longest)]], NONE)
        best = np.minimum.reduceat(rank * len(segment) + np.arange(len(segment)), first)
        merges = best < NONE * len(segment)
        at = best[merges] % len(segment)
        length[at] = both[at]
        lives = np.ones(len(segment), bool)
        lives[at + 1] = False
        active = np.repeat(merges, np.diff(np.r_[first, len(segment)]))
        done_start.append(start[~active])
        done_length.append(length[~active])
        keep = active & lives
        segment, start, length = segment[keep], start[keep], length[keep]
    if not done_start:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, length = np.concatenate(done_start), np.concatenate(done_length)
    by_place = np.argsort(start, kind="stable")
    return start[by_place], length[by_place]


SEGMENT = re.compile(rb" *[^ ]+| +")
SPACE_BYTES = SPACE.encode()
#: Distinct segments whose ids a task remembers from one chunk to the next.
REMEMBERED = 120_000


class Encoder:
    """Encodes chunk after chunk; segments seen in an earlier chunk keep their ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int64)

    def _learn(self, segments: list[bytes]) -> None:
        """Ids of new segments, found by one suffix order over all of them."""
        v = self.vocabulary
        data = np.frombuffer(b"".join(segments), np.uint8)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)))
        sizes = np.diff(np.concatenate([[0], heads[ends]]))
        signs = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        signs = np.where(signs == 32, np.uint32(ord(SPACE)), signs)
        line = np.full(len(signs) + len(segments), END, np.uint32)
        line[np.arange(len(signs)) + np.repeat(np.arange(len(segments)), sizes)] = signs
        found = edges(line, v)
        start, length = relax(sizes, found, v.order)
        ids = found[start, length]
        owner = np.searchsorted(np.cumsum(sizes + 1), start, side="right")
        width = np.ones(len(ids), np.int64)
        unknown = np.flatnonzero(ids == len(v.text))
        if len(unknown):  # a sign without a piece becomes its bytes
            as_bytes = [chr(c).encode() for c in line[start[unknown]]]
            width[unknown] = [len(b) for b in as_bytes]
            at = (np.cumsum(width) - width)[unknown]
            ids = np.repeat(ids, width)
            where = np.concatenate([np.arange(a, a + len(b)) for a, b in zip(at, as_bytes)])
            ids[where] = v.byte_ids[np.frombuffer(b"".join(as_bytes), np.uint8)]
        self.known.update(zip(segments, range(len(self.known), len(self.known) + len(segments))))
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.sizes = np.concatenate([self.sizes, np.bincount(owner, weights=width, minlength=len(segments)).astype(np.int64)])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of UTF-8 texts on one line, and the number of ids of each text."""
        v = self.vocabulary
        prefix = b" " if v.dummy_prefix else b""
        plain = [prefix + t.replace(SPACE_BYTES, b" ") if t else b"" for t in texts]
        cut = [SEGMENT.findall(t) if v.splits else [t] * bool(t) for t in plain]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.empty(int(counts.sum()), dtype=object)
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        flat[:] = list(chain.from_iterable(cut))
        codes, unique = pd.factorize(flat)
        if len(self.known) > REMEMBERED:
            self._forget()
        new = [s for s in unique if s not in self.known]
        if new:
            self._learn(new)
        codes = np.fromiter(map(self.known.__getitem__, unique), np.int64, len(unique))[codes]
        offset = B.starts_of(self.sizes)
        tokens = self.sizes[codes]
        take = np.repeat(offset[codes] - B.starts_of(tokens), tokens) + np.arange(tokens.sum())
        ends = np.concatenate([[0], np.cumsum(tokens)])
        last = np.cumsum(counts)
        return self.ids[take], ends[last] - ends[last - counts]


def decode_ids(ids: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> list[bytes]:
    """UTF-8 texts of runs of ids; the space that encoding puts first is taken off again."""
    sizes = vocabulary.out_sizes[ids]
    first = B.starts_of(vocabulary.out_sizes)[ids]
    take = np.repeat(first - B.starts_of(sizes), sizes) + np.arange(sizes.sum())
    data = vocabulary.out_bytes[take].tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    last = np.cumsum(counts)
    out = []
    for a, b in zip(ends[last - counts], ends[last]):
        text = data[a:b]
        out.append(text[1:] if vocabulary.dummy_prefix and text.startswith(b" ") else text)
    return out


def encode(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids, n_tokens, round_trip`` of every row.

    ``round_trip`` tells whether decoding the ids gives the text back. Null and empty texts have
    no ids (null gives no round trip but null); a literal space sign of the vocabulary decodes
    to a space; texts of any length are encoded whole; other columns are not read.
    """
    ship_package(docs.sparkSession)
    vocabulary = Vocabulary(path)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for part in B.chunks(parts):
            texts, given = B.raw_texts(part), part.column("text").is_valid().to_pylist()
            ids, counts = encoder.encode(texts)
            back = decode_ids(ids, counts, vocabulary)
            same = [b == t if g else None for g, t, b in zip(given, texts, back)]
            yield pa.RecordBatch.from_arrays([part.column("id"), B.ragged(ids, counts, pa.int32()), pa.array(counts), pa.array(same, pa.bool_())], names=["id", "ids", "n_tokens", "round_trip"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, f"id {kind}, ids array<int>, n_tokens bigint, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, text`` from arrays of ids; null ids give null. Ids outside the vocabulary are an error."""
    ship_package(encoded.sparkSession)
    vocabulary = Vocabulary(path)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            given = part.column("ids").to_pylist()
            counts = np.array([len(x or ()) for x in given], np.int64)
            flat = np.fromiter(chain.from_iterable(x or () for x in given), np.int64, int(counts.sum()))
            if len(flat) and (flat.min() < 0 or flat.max() >= len(vocabulary.text)):
                raise ValueError("an id is outside the vocabulary")
            texts = [None if g is None else t.decode("utf-8", "replace") for g, t in zip(given, decode_ids(flat, counts, vocabulary))]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    kind = dict(encoded.dtypes)[id_col]
    out = encoded.selectExpr(f"`{id_col}` as id", f"`{ids_col}` as ids").mapInArrow(run, f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)
