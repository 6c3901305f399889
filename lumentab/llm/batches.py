"""Arrow batches of text cut into bounded chunks, and numpy hashes of their words.

Used inside tasks only. A chunk holds a few megabytes of text, so memory does not follow the
batch; a longer single text is a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a chunk.
CHUNK_BYTES = 3 << 19
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def give_back() -> None:
    """Return freed memory to the system: workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it likes
        pass


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in slices of at most ``limit`` bytes of text."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def raw_texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 bytes of the texts; null is empty. ``bytes.split()`` then cuts at ASCII white space."""
    column = batch.column(text)
    return pc.fill_null(column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()), b"").to_pylist()


def hashed_words(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words on one line, and the number of words of each text."""
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = list(chain.from_iterable(words))
    return (pd.util.hash_array(flat, categorize=True) if len(flat) else np.zeros(0, np.uint64)), counts


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * MIX
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h *= STEP
            h += words[j : j + n]
    return mixed(h)


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def run_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs of ``counts`` values; each is added up on its own, from its start."""
    out = np.zeros(len(counts), np.float64)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values.astype(np.float64), starts_of(counts)[some])
    return out


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of ``counts`` values a row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
