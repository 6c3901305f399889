"""Embedding near-dedup by counting collisions of one-dimensional projections.

Two unit vectors at the threshold cosine differ by ``d = sqrt(2 - 2 cos)``, so a Gaussian
projection separates them by a normal number of deviation ``d``. A window of ``WIDTH`` such
deviations around a query's value holds its partner with a known probability. Over all
projections the collisions of a pair follow a binomial law, which gives the count that all but
``MISS`` of the pairs at the threshold reach; pairs that reach it are verified exactly.

A single projection tells far pairs from near ones only by a factor, so the number of
collisions grows with the square of the table; collisions are therefore counted in blocks of
sorted values with byte arithmetic and only counts of links leave a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumentab.llm.graph_ann import usable
from lumentab.operators.graph import components
from lumentab.session import cut_lineage, ship_package

PROJECTIONS, WIDTH, MISS = 32, 2.5, 1e-4
#: Vectors of a block, and rows of a tile inside it.
BLOCK, TILE = 4096, 256
#: Deviations beyond which two blocks of the first projection are not compared at all.
REACH = 5.0


def least_count(projections: int, width: float, miss: float) -> int:
    """Largest count that a pair at the threshold reaches with probability ``1 - miss``."""
    p = math.erf(width / math.sqrt(2))
    below, count = 0.0, 0
    while count < projections:
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            break
        count += 1
    return count


def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(6).standard_normal((dim, projections))


def _steps(values: np.ndarray, unit: float) -> np.ndarray:
    """Projections as whole steps in a byte; clipping brings values closer, never apart."""
    return np.clip(np.floor(values / unit), -60, 60).astype(np.int8)


def block_links(left: np.ndarray, right: np.ndarray | None, cosine: float, projections: int = PROJECTIONS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs, tile by tile, whose cosine is ``cosine`` or more; inside ``left`` if there is no ``right``.

    Vectors are unit vectors in double precision.
    """
    apart = math.sqrt(max(0.0, 2 - 2 * cosine))
    window = WIDTH * apart
    misses = projections - least_count(projections, WIDTH, MISS)
    axes = directions(left.shape[1], projections)
    a, b = left @ axes, (left if right is None else right) @ axes
    order_a, order_b = np.argsort(a[:, 0], kind="stable"), np.argsort(b[:, 0], kind="stable")
    a, b = a[order_a], b[order_b]
    unit = max(window, 1e-6) / 12
    half = 13  # a window of whole steps is never narrower than the window itself
    qa, qb = np.ascontiguousarray(_steps(a, unit).T), np.ascontiguousarray(_steps(b, unit).T)
    hard = REACH * apart + 1e-9
    dense = projections // 2
    x, y = left[order_a], (left if right is None else right)[order_b]
    for at in range(0, len(a), TILE):
        to = min(at + TILE, len(a))
        lo = np.searchsorted(b[:, 0], a[at, 0] - hard)
        hi = np.searchsorted(b[:, 0], a[to - 1, 0] + hard, side="right")
        if right is None:
            lo = max(lo, at)
        if hi <= lo:
            continue
        missed = np.zeros((to - at, hi - lo), np.uint8)
        for k in range(dense):
            missed += np.abs(qa[k, at:to, None] - qb[k, None, lo:hi]) > half
        i, j = np.nonzero(missed <= misses)
        count = missed[i, j]
        i, j = i + at, j + lo
        if right is None:
            up = i < j
            i, j, count = i[up], j[up], count[up]
        for k in range(dense, projections):
            if not len(i):
                break
            count = count + (np.abs(qa[k, i] - qb[k, j]) > half)
            keep = count <= misses
            i, j, count = i[keep], j[keep], count[keep]
        for s in range(0, len(i), 1 << 16):
            p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            near = np.einsum("nd,nd->n", x[p], y[q]) >= cosine
            yield order_a[p[near]], order_b[q[near]]


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row, whatever its other columns.

    ``n_links`` counts the other rows at ``cosine`` or more, copies included. Equal vectors are
    one class with a size; only classes are compared, in pairs of blocks whose first
    projections are within reach, and a block pair gives counts and a spanning forest.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
    with nothing; vectors of different length do not link; rows that repeat count as other
    rows; a row without an id links like any other, takes the smallest id of its component and
    is kept only where that has none; an empty table gives no rows.
    """
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("good", usable(F.col("v"))).withColumn("key", F.when(F.col("good"), F.xxhash64("v")))
    classes = rows.filter("good").groupBy("key").agg(F.any_value("v").alias("v"), F.count(F.lit(1)).alias("size"), F.min("id").alias("head"))
    classes = cut_lineage(classes.withColumn("dim", F.size("v")))

    def first_cell(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = REACH * math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
        for part in parts:
            cells, axes = [], {}
            for v in part.column("v").to_pylist():
                x = np.array(v)
                x = x / np.abs(x).max()
                axis = axes.setdefault(len(x), directions(len(x))[:, 0])
                cells.append(int(math.floor((x @ axis) / np.linalg.norm(x) / width)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.int32())], names=[*part.schema.names, "cell"])

    celled = cut_lineage(classes.select("dim", "key", "size", "v").mapInArrow(first_cell, "dim int, key bigint, size bigint, v array<double>, cell int"))
    # one row per length and cell of the first projection: a handful
    sizes = celled.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    numbered = celled.join(sizes, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int"))
    # blocks of one cell meet each other, and those of the next cell
    up = sizes.select("dim", (F.col("cell") - 1).alias("cell"), F.col("blocks").alias("next"))
    down = sizes.select("dim", (F.col("cell") + 1).alias("cell"), F.col("blocks").alias("before"))
    around = numbered.join(up, ["dim", "cell"], "left").join(down, ["dim", "cell"], "left")
    unit = lambda c, i, d, j: F.struct(c.alias("c"), i.alias("i"), d.alias("d"), j.alias("j"))
    cell, mine = F.col("cell"), F.col("block")
    many = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    inside = F.transform(many(F.col("blocks")), lambda k: unit(cell, F.least(mine, k), cell, F.greatest(mine, k)))
    above = F.transform(many(F.coalesce("next", F.lit(0))), lambda k: unit(cell, mine, cell + 1, k))
    below = F.transform(many(F.coalesce("before", F.lit(0))), lambda k: unit(cell - 1, k, cell, mine))
    dealt = around.withColumn("unit", F.explode(F.concat(inside, above, below))).select("dim", "unit.c", "unit.i", "unit.d", "unit.j", (F.struct("cell", "block") == F.struct("unit.c", "unit.i")).alias("left"), "key", "size", "v")
    heads = ["dim", "c", "i", "d", "j"]

    def links_of(unit: tuple, keys: list[int], sizes: list[int], sides: list[bool], data: list[np.ndarray]) -> tuple[list, list, list]:
        x = np.stack(data)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        side, weight = np.array(sides), np.array(sizes, np.int64)
        same = unit[1:3] == unit[3:5]
        a = np.arange(len(x)) if same else np.flatnonzero(side)
        b = a if same else np.flatnonzero(~side)
        if not len(a) or not len(b):
            return [], [], []
        total, parent = np.zeros(len(x), np.int64), list(range(len(x)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        tree = []
        for p, q in block_links(x[a], None if same else x[b], cosine):
            p, q = a[p], b[q]
            np.add.at(total, p, weight[q])
            np.add.at(total, q, weight[p])
            for u, v in zip(p.tolist(), q.tolist()):
                u_root, v_root = root(u), root(v)
                if u_root != v_root:
                    parent[max(u_root, v_root)] = min(u_root, v_root)
                    tree.append((keys[u], keys[v]))
        hit = np.flatnonzero(total)
        return [keys[n] for n in hit] + [u for u, _ in tree], total[hit].tolist() + [0] * len(tree), [None] * len(hit) + [v for _, v in tree]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, keys, sizes, sides, data = None, [], [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(keys) > 1:
                u, n, v = links_of(unit, keys, sizes, sides, data)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(n, pa.int64()), pa.array(v, pa.int64())], names=["u", "n", "v"])

        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in heads)))
            offsets, values = batch.column("v").offsets.to_numpy(), batch.column("v").values.to_numpy(zero_copy_only=False)
            columns = zip(places, batch.column("left").to_pylist(), batch.column("key").to_pylist(), batch.column("size").to_pylist())
            for r, (place, left, key, size) in enumerate(columns):
                if place != unit:
                    yield from done()
                    unit, keys, sizes, sides, data = place, [], [], [], []
                keys.append(key)
                sizes.append(size)
                sides.append(left)
                data.append(values[offsets[r] : offsets[r + 1]].copy())
        yield from done()

    got = cut_lineage(dealt.repartition(*heads).sortWithinPartitions(*heads).mapInArrow(run, "u bigint, n bigint, v bigint"))
    counts = got.groupBy("u").agg(F.sum("n").alias("n")).select(F.col("u").alias("key"), "n")
    edges = got.filter("v is not null").select("u", "v")
    linked = edges.select(F.col("u").alias("id")).unionByName(edges.select(F.col("v").alias("id"))).distinct()
    groups = components(linked, edges).select(F.col("id").alias("key"), "component")
    placed = classes.select("key", "size", "head").join(counts, "key", "left").join(groups, "key", "left").withColumn("component", F.coalesce("component", "key"))
    smallest = placed.groupBy("component").agg(F.min("head").alias("smallest"))
    answer = placed.join(smallest, "component").select("key", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), "smallest")
    out = rows.select("id", "key").join(answer, "key", "left")
    component = F.when(F.col("key").isNotNull(), F.col("smallest")).otherwise(F.col("id"))
    kept = F.coalesce(F.col("id") == component, component.isNull())
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
