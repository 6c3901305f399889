"""MinHash near-dedup with tensored banding.

A table key joins three minhashes of a first and three of a second small collection. Making all
pairs of ``SIDE`` first and ``SIDE`` second halves gives ``SIDE ** 2`` table keys from
``6 * SIDE`` minhashes instead of ``6 * SIDE ** 2``. Documents that share a key are candidates;
links are confirmed on the full shingle sets.

With 16 halves a side, a pair at similarity 0.75 shares a key with probability
``(1 - (1 - 0.75**3)**16) ** 2`` = 0.9997.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumentab.llm import batches as B
from lumentab.operators.graph import components
from lumentab.session import cut_lineage, ship_package

SHINGLE, ROWS, SIDE = 5, 3, 16
#: Classes of a block, and shingles of all its sets; a family of more is confirmed block by block.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 22
#: Similarity in hundredths.
PERCENT = 75


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle are one shingle."""
    words, counts = B.hashed_words([t.lower().split() for t in texts])
    hashes = B.window_hashes(words, width)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(hashes[at : at + n - width + 1]))
        else:
            out.append(B.window_hashes(words[at : at + n], n) if n else hashes[:0])
        at += n
    return out


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key of each set, the same for equal sets; 0 for empty ones."""
    with np.errstate(over="ignore"):
        return np.array([B.mixed(np.array([s.sum(dtype=np.uint64) * B.STEP + np.bitwise_xor.reduce(B.mixed(s))]))[0] if len(s) else 0 for s in sets], np.uint64)


def half_keys(sets: list[np.ndarray], side: int = SIDE, rows: int = ROWS) -> np.ndarray:
    """``[set, 2 * side]`` halves, each a hash of ``rows`` minhashes, of non-empty sets."""
    rng = np.random.default_rng(8)
    masks = rng.integers(0, 1 << 63, 2 * side * rows, dtype=np.uint64)
    odds = rng.integers(0, 1 << 63, 2 * side * rows, dtype=np.uint64) | np.uint64(1)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, starts = np.concatenate(sets), B.starts_of(sizes)
    out = np.zeros((len(sets), 2 * side), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(2 * side):
            for j in range(k * rows, (k + 1) * rows):
                h = flat ^ masks[j]
                h *= odds[j]
                out[:, k] = out[:, k] * B.STEP + np.minimum.reduceat(h, starts)
    return B.mixed(out)


SIGNATURE = "doc_id bigint, row_key bigint, n_shingles bigint, set_key bigint, halves array<bigint>"


def row_key() -> Column:
    """Tells rows apart by id and text, null ids included."""
    return F.xxhash64("doc_id", "text")


def signatures(docs: DataFrame, side: int = SIDE) -> DataFrame:
    """``doc_id, row_key, n_shingles, set_key, halves`` of each whole text; empty sets have no halves."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.chunks(parts):
            sets = shingle_sets(B.raw_texts(part))
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            full = [s for s in sets if len(s)]
            halves = half_keys(full, side) if full else np.zeros((0, 2 * side), np.uint64)
            lists = B.ragged(halves.ravel().view(np.int64), np.where(sizes > 0, 2 * side, 0), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(sizes), pa.array(set_keys(sets).view(np.int64)), lists], names=["doc_id", "row_key", "n_shingles", "set_key", "halves"])

    return docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(run, SIGNATURE)


def candidate_edges(classes: DataFrame, side: int = SIDE) -> DataFrame:
    """``u, v``: each class that shares a table key, with the smallest class under that key.

    Halves that one class alone has are dropped before the pairs are formed, so a document
    without neighbours costs its halves only. Every table is linked as a star, whatever its
    size.
    """
    halves = classes.select("set_key", F.posexplode("halves").alias("side", "half")).withColumn("h", F.xxhash64("side", "half"))
    shared = halves.groupBy("h").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).filter("a < b").select("h")
    kept = halves.join(shared, "h", "left_semi").groupBy("set_key").agg(F.collect_list(F.when(F.col("side") < side, F.col("h"))).alias("first"), F.collect_list(F.when(F.col("side") >= side, F.col("h"))).alias("second"))
    pairs = F.flatten(F.transform("first", lambda a: F.transform("second", lambda b: F.xxhash64(a, b))))
    keys = kept.select("set_key", F.explode(pairs).alias("key"))
    heads = keys.groupBy("key").agg(F.min("set_key").alias("v"), F.max("set_key").alias("last")).filter("v < last").select("key", "v")
    return keys.join(heads, "key").filter("set_key <> v").select(F.col("set_key").alias("u"), "v").distinct()


class _Forest:
    """Union by smallest index."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def confirmed_links(keys: list[int], sets: list[np.ndarray], left: np.ndarray | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what is similar enough, as a spanning forest over full-set comparisons.

    Intersections of one set with all others are counted through the sets' shared shingles.
    A set most of whose shingles nobody else has can't reach the threshold and is passed over.
    ``left`` marks the sets of a first block; then only pairs across the blocks are compared.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    count = np.diff(np.r_[first, len(ordered)])
    number = np.empty(len(flat), np.int64)
    number[order] = np.repeat(np.arange(len(first)), count)
    members = owner[order]
    several = count[number] > 1
    shared = np.bincount(owner, weights=several, minlength=len(sets)).astype(np.int64)
    able = 100 * shared >= percent * sizes
    starts = B.starts_of(sizes)
    forest, links = _Forest(len(sets)), []
    for u in np.flatnonzero(able if left is None else able & left):
        mine = number[starts[u] : starts[u] + sizes[u]]
        mine = mine[count[mine] > 1]
        n = count[mine]
        take = np.repeat(first[mine] - B.starts_of(n), n) + np.arange(n.sum())
        both = np.bincount(members[take], minlength=len(sets))
        near = 100 * both >= percent * (sizes + sizes[u] - both)
        near[: u + 1 if left is None else 0] = False
        if left is not None:
            near &= ~left
        for v in np.flatnonzero(near):
            if forest.join(int(u), int(v)):
                links.append((keys[u], keys[v]))
    return links


def texts_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Texts of the rows that stand for a class; rows of one id, or of none, meet only with their own text."""
    return docs.select(row_key().alias("key"), "text").join(members, "key")


def family_links(docs: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``u, v``: confirmed links between classes of one candidate family.

    ``members`` has ``key, set_key, family, blocks``: the row that gives a class its text, and
    in how many blocks its family is confirmed. Every pair of blocks is a unit of its own,
    so no unit is larger than two blocks and only a spanning forest leaves it.
    """

    def texts_to_sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.chunks(parts):
            sets = shingle_sets(B.raw_texts(part))
            right = set_keys(sets).view(np.int64) == part.column("set_key").to_numpy()
            sets = [s if ok else s[:0] for s, ok in zip(sets, right)]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            lists = B.ragged(np.concatenate(sets).view(np.int64), sizes, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("family", "blocks", "set_key")] + [lists], names=["family", "blocks", "set_key", "shingles"])

    sets = texts_of(docs, members).mapInArrow(texts_to_sets, "family bigint, blocks int, set_key bigint, shingles array<bigint>").filter(F.size("shingles") > 0)
    block = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    units = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    dealt = sets.withColumn("block", block).withColumn("unit", F.explode(units)).select("family", "unit.i", "unit.j", "block", "set_key", "shingles")

    def confirm(unit: tuple, keys: list, blocks: list, sets: list) -> list[tuple[int, int]]:
        place = {}
        for n, k in enumerate(keys):
            place.setdefault(k, n)
        rows = sorted(place.values())
        left = None if unit[1] == unit[2] else np.array([blocks[n] == unit[1] for n in rows])
        return confirmed_links([keys[n] for n in rows], [sets[n] for n in rows], left, percent) if len(rows) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, keys, blocks, sets, out = None, [], [], [], []

        def result() -> pa.RecordBatch:
            u, v = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            heads = list(zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j"))))
            offsets = batch.column("shingles").offsets.to_numpy()
            values = batch.column("shingles").values.to_numpy().view(np.uint64)
            for n, (head, b, k) in enumerate(zip(heads, batch.column("block").to_pylist(), batch.column("set_key").to_pylist())):
                if head != unit:
                    if unit:
                        out += confirm(unit, keys, blocks, sets)
                    unit, keys, blocks, sets = head, [], [], []
                keys.append(k)
                blocks.append(b)
                sets.append(values[offsets[n] : offsets[n + 1]].copy())
        if unit:
            out += confirm(unit, keys, blocks, sets)
        yield result()

    parts = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return parts.mapInArrow(run, "u bigint, v bigint")


def _placed(docs: DataFrame, side: int = SIDE, block: int = BLOCK, percent: int = PERCENT) -> DataFrame:
    """``doc_id, row_key, n_shingles, component`` of every row; a component is a class key, null without shingles."""
    ship_package(docs.sparkSession)
    signed = cut_lineage(signatures(docs, side))
    classes = signed.filter("n_shingles > 0").groupBy("set_key").agg(F.any_value("halves").alias("halves"), F.any_value("n_shingles").alias("size"), F.min("row_key").alias("key"))
    edges = cut_lineage(candidate_edges(classes, side))
    nodes = edges.select(F.col("u").alias("id")).unionByName(edges.select(F.col("v").alias("id"))).distinct()
    families = components(nodes, edges)
    sized = families.join(classes.select(F.col("set_key").alias("id"), "key", "size"), "id")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    members = sized.join(sized.groupBy("component").agg(blocks.alias("blocks")), "component").select("key", F.col("id").alias("set_key"), F.col("component").alias("family"), "blocks")
    links = cut_lineage(family_links(docs, members, percent).distinct())
    linked = links.select(F.col("u").alias("id")).unionByName(links.select(F.col("v").alias("id"))).distinct()
    groups = components(linked, links).select(F.col("id").alias("set_key"), "component")
    return signed.select("doc_id", "row_key", "n_shingles", "set_key").join(groups, "set_key", "left").withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "set_key")))


def near_duplicates(docs: DataFrame, side: int = SIDE, block: int = BLOCK, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Texts with equal shingle sets are one class and cost one row from then on. Classes that
    share table keys, directly or through others, are a candidate family; inside a family all
    links are confirmed on full sets, in blocks. The component is the smallest id reachable.

    Defined cases: null and empty texts have no shingles and stand alone, kept; rows that share
    an id and a text are the same document twice and both kept; a row without an id takes its
    component's id and is kept only where no row of the component has an id; an empty table
    gives no rows; other columns are not read.
    """
    ship_package(docs.sparkSession)
    placed = _placed(docs, side, block, percent)
    heads = placed.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("head"))
    out = placed.join(heads, "component", "left")
    component_id = F.when(F.col("n_shingles") > 0, F.col("head")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component_id, component_id.isNull())
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), kept.alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of documents.

    It is the row of the smallest id, null ids last, and of equal ids the one of the smallest row
    key, so a rerun keeps the same. Rows without shingles are no copies and stay; rows that share
    an id and a text are one document.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    placed = _placed(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key"))["row_key"]
    heads = placed.filter("component is not null").groupBy("component").agg(first.alias("row_key")).select("row_key")
    kept = heads.unionByName(placed.filter("component is null").select("row_key")).distinct()
    stay = docs.select(*columns).withColumn("row_key", row_key()).join(kept, "row_key").dropDuplicates(["row_key"])
    return stay.select(*columns)
