"""Substring dedup with repeated-phrase automata.

A window is so many consecutive words of one document. What recurs is found by hashes, sent as
text, and located by Aho-Corasick automata that stream every document that can hold it:

1. Each window has an anchor, the smallest hash among the word n-grams inside it, so equal
   windows have equal anchors. Anchors seen in one document only rule out their windows.
2. The other windows are hashed whole. Where a smaller id has an equal hash, that document is
   the window's witness, and the window's place there falls into one of the witness's phrases,
   fixed runs of its words that overlap by a window less one word.
3. Every phrase that was asked for is cut from its witness once and sent to those who asked.
4. Chunks of documents compile the phrases that came into automata, a bounded number of bytes at
   a time. Their keys are the blocks of half a window at every half window of a phrase: a window
   always holds one whole. The documents are streamed, hits are compared word by word with the
   phrase, and words covered by windows of a smaller id go. Hashes only propose; words decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumentab.llm import batches as B
from lumentab.session import ship_package

#: Words of a window, and of the n-grams whose smallest hash is its anchor.
WINDOW, GRAM = 13, 5
#: Bits of an anchor that a document's own list keeps; a chance hit adds a hash, no window.
LOW_BITS = (1 << 31) - 1
#: Windows that start in one phrase.
PHRASE = 32
#: Marks of a text; a spot is the number of a phrase in its text, times this, and the text's mark.
MARKS = 1 << 16
#: Bytes of phrases in one automaton; a chunk that got more streams through one after the other.
AUTOMATON_BYTES = 1 << 20
#: Hits compared with their phrases at once.
HITS = 1 << 13


def _anchors(words: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts on the line of all words, and each window's anchor."""
    gram = min(GRAM, window)
    h = B.window_hashes(words, gram)
    reach, need = 1, window - gram + 1
    while reach < need:  # smallest of ``reach`` neighbours, doubled up to ``need``
        step = min(reach, need - reach)
        h = np.minimum(h[:-step], h[step:]) if len(h) > step else h[:0]
        reach += step
    ends = np.cumsum(counts)
    valid = np.zeros(len(words) + 1, np.int32)
    long = counts >= window
    np.add.at(valid, (ends - counts)[long], 1)
    np.add.at(valid, (ends - window + 1)[long], -1)
    starts = np.flatnonzero(np.cumsum(valid)[: len(words)])
    return starts, h[starts].view(np.int64)


def _known_texts(part: pa.RecordBatch) -> list[bytes]:
    """Texts of rows with an id; the others are empty here."""
    return [t if known else b"" for t, known in zip(B.raw_texts(part), part.column("doc_id").is_valid().to_pylist())]


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(part.column("doc_id"), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _windows_listed(part: pa.RecordBatch, words: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of windows whose anchor is in the lists of the chunk's rows."""
    starts, anchors = _anchors(words, counts, window)
    hashes = B.window_hashes(words, window).view(np.int64)[starts]
    lists = [part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("listed", "known")]
    hit = np.isin(anchors & LOW_BITS, np.concatenate(lists).astype(np.int64))
    return starts[hit], hashes[hit]


def _spread(part: pa.RecordBatch, window: int) -> pa.RecordBatch | None:
    """Anchors of a chunk: one row per anchor and document.

    Anchors of several documents of the chunk take two rows and a list in each document's own
    row: a phrase that a third of all documents share costs two rows per chunk, not one per document.
    """
    words, counts = B.hashed_words([t.split() for t in _known_texts(part)])
    starts, anchors = _anchors(words, counts, window)
    if not len(starts):
        return None
    rows = np.searchsorted(np.cumsum(counts), starts, side="right")
    new = np.r_[True, (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])]
    anchors, rows = anchors[new], rows[new]
    ids = _ids(part)[rows]
    order = np.lexsort((ids, anchors))
    a, d, r = anchors[order], ids[order], rows[order]
    once = np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])]
    a, d, r = a[once], d[once], r[once]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    size = np.diff(np.r_[first, len(a)])
    several = np.repeat(size > 1, size)
    last = first + size - 1
    alone = ~several
    pair = np.concatenate([first[size > 1], last[size > 1]])
    # the documents' own rows, with the anchors known to recur
    known_rows, known = r[several], a[several]
    by_row = np.argsort(known_rows, kind="stable")
    owners, per_owner = np.unique(known_rows, return_counts=True)
    doc_of = _ids(part)[owners]
    place = np.concatenate([a[alone], a[pair], B.mixed(doc_of.view(np.uint64)).view(np.int64)])
    ids = np.concatenate([d[alone], d[pair], doc_of])
    plain = int(alone.sum()) + len(pair)
    sizes = np.concatenate([np.zeros(plain, np.int64), per_owner])
    lists = B.ragged((known[by_row] & LOW_BITS).astype(np.int32), sizes, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(place), pa.array(ids), lists], names=["place", "doc_id", "known"])


def recurring(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``key, listed, known``: of each document, low bits of its anchors that recur in another one."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.chunks(parts):
            if (out := _spread(part, window)) is not None:
                yield out

    rows = docs.select("doc_id", "text").mapInArrow(run, "place bigint, doc_id bigint, known array<int>")
    w = Window.partitionBy("place")
    owned = F.size("known") > 0
    found = rows.withColumn("low", F.min("doc_id").over(w)).withColumn("high", F.max("doc_id").over(w)).filter(owned | (F.col("low") < F.col("high")))
    # a list per document is bounded by the document's own words
    low_bits = F.when(~owned, F.col("place").bitwiseAND(F.lit(LOW_BITS)).cast("int"))
    return found.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(low_bits).alias("listed"), F.flatten(F.collect_list("known")).alias("known"))


def _mark(text: bytes) -> int:
    """Tells texts of one id apart; a chance agreement sends a phrase too many."""
    return crc32(text) & MARKS - 1


def _witnessed(part: pa.RecordBatch, window: int) -> pa.RecordBatch | None:
    """Windows of a chunk, each with its smallest id there; the chunk's other documents have that one for a witness.

    A phrase that a third of all documents share is a row per chunk among the windows, and the
    requests for it go to the chunk's own smallest id, not all to one.
    """
    texts = _known_texts(part)
    words, counts = B.hashed_words([t.split() for t in texts])
    starts, hashes = _windows_listed(part, words, counts, window)
    if not len(starts):
        return None
    ends = np.cumsum(counts)
    rows = np.searchsorted(ends, starts, side="right")
    ids, at = _ids(part)[rows], starts - (ends - counts)[rows]
    marks = np.fromiter(map(_mark, texts), np.int64, len(texts))[rows]
    order = np.lexsort((at, ids, hashes))
    h, d, spot = hashes[order], ids[order], (at // PHRASE * MARKS + marks)[order]
    once = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
    h, d, spot = h[once], d[once], spot[once]
    first = np.r_[True, h[1:] != h[:-1]]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))[~first]
    asked = np.stack([d[~first], d[lead], spot[lead]], axis=1)
    asked = asked[np.lexsort(asked.T)]
    asked = asked[np.r_[True, (asked[1:] != asked[:-1]).any(axis=1)]] if len(asked) else asked
    windows = int(first.sum())
    place = np.r_[h[first], B.mixed(asked[:, 0].astype(np.int64).view(np.uint64)).view(np.int64)]
    witness = pa.array(np.r_[np.zeros(windows, np.int64), asked[:, 1]], mask=np.arange(len(place)) < windows)
    return pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.r_[d[first], asked[:, 0]]), witness, pa.array(np.r_[spot[first], asked[:, 2]])], names=["place", "key", "witness", "spot"])


def requests(listed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``key, witness, spot``: the phrases, each of a smaller id, that hold the windows of a document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.chunks(parts):
            if (out := _witnessed(part, window)) is not None:
                yield out

    rows = listed.select("doc_id", "text", "listed", "known").mapInArrow(run, "place bigint, key bigint, witness bigint, spot bigint")
    # a place has a row per chunk at most; rows that have their witness pass through
    lowest = F.min(F.when(F.col("witness").isNull(), F.struct(F.col("key").alias("witness"), "spot"))).over(Window.partitionBy("place"))
    return rows.select("key", F.when(F.col("witness").isNull(), lowest).otherwise(F.struct("witness", "spot")).alias("w")).select("key", "w.*").filter("key > witness").distinct()


def phrases_of(docs: DataFrame, asked: DataFrame, window: int = WINDOW) -> DataFrame:
    """``witness, spot, words``: the text of every phrase that was asked for, once."""
    schema = "witness bigint, spot bigint, words string"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.chunks(parts):
            out = []
            for text, doc, wanted in zip(_known_texts(part), part.column("doc_id").to_pylist(), part.column("wanted").to_pylist()):
                words, mark = text.split(), _mark(text)
                starts = ((spot, spot // MARKS * PHRASE) for spot in wanted if spot % MARKS == mark)
                out += [(doc, spot, b" ".join(words[a : a + PHRASE + window - 1]).decode()) for spot, a in starts if a < len(words)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=["witness", "spot", "words"])

    # a list per document is bounded by the document's own phrases
    wanted = asked.select("witness", "spot").distinct().groupBy(F.col("witness").alias("key")).agg(F.collect_list("spot").alias("wanted"))
    return docs.join(wanted, "key").select("doc_id", "text", "wanted").mapInArrow(run, schema).dropDuplicates(["witness", "spot"])


def _automaton(lines: list[list[int]], block: int) -> ahocorasick.Automaton:
    """Blocks at every ``block`` words of the lines; keys are sequences of word numbers, a node for a word."""
    places: dict[tuple, list[tuple[int, int]]] = {}
    for k, line in enumerate(lines):
        for o in range(0, len(line) - block + 1, block):
            places.setdefault(tuple(line[o : o + block]), []).append((k, o))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, where in places.items():
        automaton.add_word(key, where)
    automaton.make_automaton()
    return automaton


def _cover(words: list[list[bytes]], ids: np.ndarray, phrases: list[tuple[bytes, int]], window: int, cover: np.ndarray) -> None:
    """Add 1 to ``cover`` where a window of a phrase of a smaller id begins in the line of all words, take 1 where it ends."""
    number: dict[bytes, int] = {}
    # 0 stands between documents, 1 for words of no phrase
    lines = [[number.setdefault(w, len(number) + 2) for w in text.split(b" ")] for text, _ in phrases]
    block = (window + 1) // 2
    automaton = _automaton(lines, block)
    get = number.get
    line = [0]
    for row in words:
        line += [get(w, 1) for w in row]
        line.append(0)
    hits = [(k, end - block + 1 - o) for end, where in automaton.iter(tuple(line)) for k, o in where]
    if not hits:
        return
    width = max(map(len, lines))
    table = np.full((len(lines), width), -1, np.int64)
    for k, codes in enumerate(lines):
        table[k, : len(codes)] = codes
    low = np.array([i for _, i in phrases], np.int64)
    padded = np.concatenate([np.zeros(width, np.int64), line, np.zeros(width, np.int64)])
    owner = np.repeat(ids, [len(row) + 1 for row in words])
    hits = np.unique(np.array(hits, np.int64), axis=0)
    for a in range(0, len(hits), HITS):
        k, start = hits[a : a + HITS].T
        equal = padded[start[:, None] + width + np.arange(width)] == table[k]
        run = np.concatenate([np.zeros((len(k), 1), np.int64), np.cumsum(equal, axis=1)], axis=1)
        hit, at = np.nonzero(run[:, window:] - run[:, :-window] == window)
        place = start[hit] + at - 1  # less the leading 0
        earlier = low[k[hit]] < owner[place]
        np.add.at(cover, place[earlier], 1)
        np.add.at(cover, place[earlier] + window, -1)


def covered(words: list[list[bytes]], ids: list[int], phrases: dict[bytes, int], window: int) -> list[np.ndarray]:
    """Of each row, which words lie in a window of a phrase whose id (the dict's value) is smaller than the row's."""
    sizes = [len(row) + 1 for row in words]
    cover = np.zeros(sum(sizes) + 1, np.int64)
    shard, size = [], 0
    for phrase in phrases.items():
        shard.append(phrase)
        size += len(phrase[0])
        if size >= AUTOMATON_BYTES:
            _cover(words, np.array(ids, np.int64), shard, window, cover)
            shard, size = [], 0
    if shard:
        _cover(words, np.array(ids, np.int64), shard, window, cover)
    inside = np.cumsum(cover) > 0
    ends = np.cumsum(sizes)
    return [inside[e - n : e - 1] for e, n in zip(ends, sizes)]


def _copies(docs: DataFrame, digest: Column) -> DataFrame:
    """``key, copied``: digests of the texts of an id that a smaller id has, too.

    All windows of such a text start under the smaller id, and it is no earlier document of a
    window that the other isn't. Only ids and digests are shuffled.
    """
    thin = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("key"), digest.alias("digest"))
    first = thin.groupBy("digest").agg(F.min("key").alias("first"))
    return thin.join(first, "digest").filter("key > first").groupBy("key").agg(F.collect_set("digest").alias("copied"))


def drop_repeats(docs: DataFrame, window: int = WINDOW, keep: list[str] = ()) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` and the columns in ``keep``.

    Each word covered by a window whose words also start under a smaller id is dropped; windows
    are judged on the input. ``kept_text`` joins the kept words by one space.

    Defined cases: null and empty texts have no words; a row without an id keeps all its words
    and is no earlier document; rows that share an id do not count as earlier than each other;
    texts shorter than a window are kept; an empty table gives no rows. A text is the copy of an
    earlier one where their MD5 digests agree; a window is missed only where 64-bit hashes of
    different windows agree and no other witness stands for it.
    """
    ship_package(docs.sparkSession)
    read = list(dict.fromkeys(["doc_id", "text", *keep]))
    # the key is never null, so every use below asks for the same exchange of the texts, which is made once
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text")).alias("key"), *read)
    digest = F.md5("text")
    base = keyed.join(_copies(docs, digest), "key", "left").withColumn("copy", F.coalesce(F.array_contains("copied", digest), F.lit(False)))
    firsts = base.filter(~F.col("copy"))
    asked = requests(firsts.join(recurring(firsts, window), "key"), window)
    phrases = asked.join(phrases_of(firsts, asked, window), ["witness", "spot"]).groupBy("key").agg(F.collect_list(F.struct("witness", "words")).alias("phrases"))
    extra = [c for c in keep if c not in ("doc_id", "text")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.chunks(parts):
            n_words, n_removed, digests, kept_texts = [], [], [], []
            split = [text.split() for text in B.raw_texts(part)]
            sent, known = part.column("phrases").to_pylist(), part.column("doc_id").to_pylist()
            copies = part.column("copy").to_pylist()
            rows = [r for r, got in enumerate(sent) if got and known[r] is not None and not copies[r]]
            lowest: dict[bytes, int] = {}
            for got in (sent[r] for r in rows):
                for p in got:
                    text = p["words"].encode()
                    lowest[text] = min(p["witness"], lowest.get(text, p["witness"]))
            gone = dict(zip(rows, covered([split[r] for r in rows], [known[r] for r in rows], lowest, window)))
            for r, words in enumerate(split):
                n = len(words)
                if copies[r]:
                    words = words if n < window else []
                elif r in gone:
                    words = [words[i] for i in np.flatnonzero(~gone[r])]
                kept = b" ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string()), *[part.column(c) for c in ["text", *extra]]],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "text", *extra],
            )

    types = dict(docs.dtypes)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string, text string" + "".join(f", {c} {types[c]}" for c in extra)
    out = base.join(phrases, "key", "left").select(*read, "copy", "phrases").mapInArrow(run, schema)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", *[c for c in keep if c != "doc_id"])


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without their repeated words; texts that lose nothing stay as they are.

    Documents that lose all their words go.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    got = drop_repeats(docs, window, keep=columns)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))
    return got.filter("n_words = 0 or n_removed < n_words").select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))
