"""Approximate nearest neighbours by a robust-pruned directed graph.

Vectors are dealt to shards of bounded size. A task builds one graph per shard: points enter in
doubling batches, a greedy search over the graph so far proposes neighbours, and relaxed
distance pruning keeps those that no kept neighbour is nearer to. A beam search then answers
every query in every shard, and the shards' answers are merged by exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumentab.session import ship_package

#: Vectors per shard, edges per point, width of the beams of building and searching.
SHARD, DEGREE, BUILD_BEAM, SEARCH_BEAM = 4096, 32, 48, 128
#: A candidate goes when a kept neighbour is this many times nearer to it than the point is.
RELAX = 1.2
BATCH = 256


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _distances(points: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of ``[query, k]`` points to their queries."""
    d = points[ids] - queries[:, None, :]
    return np.einsum("qkd,qkd->qk", d, d)


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """``[query, beam]`` ids and squared distances, nearest first; -1 where fewer were reached.

    All queries walk side by side; each step expands every query's nearest unexpanded point.
    """
    n_q = len(queries)
    ids = np.full((n_q, beam), -1, np.int64)
    dist = np.full((n_q, beam), np.inf, np.float32)
    open_ = np.zeros((n_q, beam), bool)
    ids[:, 0], open_[:, 0] = start, True
    dist[:, 0] = _distances(points, np.full((n_q, 1), start), queries)[:, 0]
    seen = np.zeros((n_q, len(points)), bool)
    seen[:, start] = True
    active = np.arange(n_q)
    while len(active):
        at = open_[active].argmax(axis=1)
        more = open_[active, at]
        active, at = active[more], at[more]
        if not len(active):
            break
        open_[active, at] = False
        near = graph[ids[active, at]]
        fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
        near = np.where(fresh, near, -1)
        rows, cols = np.nonzero(fresh)
        seen[active[rows], near[rows, cols]] = True
        d = np.full(near.shape, np.inf, np.float32)
        diff = points[near[rows, cols]] - queries[active[rows]]
        d[rows, cols] = np.einsum("kd,kd->k", diff, diff)
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_dist = np.concatenate([dist[active], d], axis=1)
        all_open = np.concatenate([open_[active], fresh], axis=1)
        best = np.argsort(all_dist, axis=1)[:, :beam]
        ids[active] = np.take_along_axis(all_ids, best, 1)
        dist[active] = np.take_along_axis(all_dist, best, 1)
        open_[active] = np.take_along_axis(all_open, best, 1)
    ids[~np.isfinite(dist)] = -1
    return ids, dist


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """``[node, degree]`` diverse neighbours of each node from its candidates (-1 for none)."""
    own = points[nodes]
    cand = np.where(candidates == nodes[:, None], -1, candidates)
    ordered = np.sort(cand, axis=1)
    twice = np.zeros_like(cand, bool)
    twice[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
    cand = np.where(twice, -1, ordered)
    vectors = points[np.maximum(cand, 0)]
    dist = np.einsum("nkd,nkd->nk", vectors - own[:, None], vectors - own[:, None])
    dist[cand < 0] = np.inf
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        pick = dist.argmin(axis=1)
        live = np.isfinite(dist[rows, pick])
        if not live.any():
            break
        out[live, k] = cand[rows, pick][live]
        gap = vectors - vectors[rows, pick][:, None]
        gone = relax * relax * np.einsum("nkd,nkd->nk", gap, gap) <= dist
        dist[gone & live[:, None]] = np.inf
        dist[rows[live], pick[live]] = np.inf
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> tuple[np.ndarray, int]:
    """Graph ``[point, neighbours]`` and the point that searches start from.

    Points that the pruned graph does not reach from the start are linked from the nearest
    reached point, beyond ``degree`` where it has to be, so a wide enough beam finds all.
    """
    n = len(points)
    centre = points.mean(axis=0)
    start = int(((points - centre) ** 2).sum(axis=1).argmin())
    graph = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(3).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at = 1
    while at < n:
        batch = order[at : at + min(BATCH, at)]
        at += len(batch)
        found, _ = beam_search(points, graph, start, points[batch], beam)
        graph[batch] = robust_prune(points, batch, found, degree, relax)
        # the new neighbours get an edge back
        source, target = np.repeat(batch, degree), graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(nodes), count.max() if len(count) else 0), -1, np.int64)
        back[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        both = np.concatenate([graph[nodes], back], axis=1)
        full = (both >= 0).sum(axis=1) > degree
        room = np.argsort(both < 0, axis=1, kind="stable")[:, :degree]
        graph[nodes[~full]] = np.take_along_axis(both[~full], room[~full], 1)
        for part in np.array_split(np.flatnonzero(full), max(1, int(full.sum()) // BATCH)):
            if len(part):
                graph[nodes[part]] = robust_prune(points, nodes[part], both[part], degree, relax)
    return _connected(points, graph, start), start


def _connected(points: np.ndarray, graph: np.ndarray, start: int) -> np.ndarray:
    n = len(points)
    reached = np.zeros(n, bool)
    front = np.array([start])
    extra: dict[int, list[int]] = {}
    while True:
        while len(front):
            reached[front] = True
            near = graph[front].ravel()
            linked = [t for f in front.tolist() for t in extra.get(f, ())]
            near = np.unique(np.concatenate([near[near >= 0], np.array(linked, np.int64)]))
            front = near[~reached[near]]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            break
        inside = np.flatnonzero(reached)
        host = int(inside[((points[inside] - points[lost[0]]) ** 2).sum(axis=1).argmin()])
        extra.setdefault(host, []).append(int(lost[0]))
        front = lost[:1]
    if extra:
        wide = max(map(len, extra.values()))
        graph = np.concatenate([graph, np.full((n, wide), -1, np.int64)], axis=1)
        for host, targets in extra.items():
            graph[host, -wide : graph.shape[1] - wide + len(targets)] = targets
    return graph


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for each query, by Euclidean distance.

    A query never finds its own id. Equal vectors are one point of the graph that stands for its
    k + 1 smallest ids, which is all that can be among the k nearest; distances are taken in
    double precision on the original vectors and ties go to the smaller id.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components take
    no part, nor do rows without an id; only vectors of one length are compared; an id that
    repeats with one vector is one row; fewer candidates than k are all returned; an empty
    table gives no rows.
    """
    ship_package(vectors.sparkSession)
    clean = lambda t: t.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v"))).distinct()
    rows = clean(vectors)
    # the limit by rank is applied before the shuffle too, so a vector with very many copies sends few rows
    first = Window.partitionBy("v").orderBy("id")
    points = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = points.withColumn("dim", F.size("v"))
    sizes = points.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = points.join(sizes, "dim").select("dim", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int").alias("shard"), F.lit(0).alias("query"), "ids", "v")
    asked = clean(queries).withColumn("dim", F.size("v")).join(sizes, "dim")
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("query"), F.array("id").alias("ids"), "v")
    both = dealt.unionByName(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "query")

    def answers(points: np.ndarray, ids: list[list[int]], graph: tuple[np.ndarray, int], queries: np.ndarray, own: list[int]) -> pa.RecordBatch:
        out = []
        found, _ = beam_search(points.astype(np.float32), graph[0], graph[1], queries.astype(np.float32), max(beam, 2 * k))
        for q, (near, mine) in enumerate(zip(found, own)):
            near = near[near >= 0][: 2 * k]
            d = np.sqrt(((points[near] - queries[q]) ** 2).sum(axis=1))
            rows = sorted((float(x), i) for x, p in zip(d, near) for i in ids[p] if i != mine)
            out += [(mine, i, x) for x, i in rows[:k]]
        columns = list(zip(*out)) if out else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, points, ids, graph, data = None, [], [], None, None
        waiting, own = [], []
        for batch in batches:
            heads = list(zip(batch.column("dim").to_pylist(), batch.column("shard").to_pylist()))
            kinds, lists = batch.column("query").to_pylist(), batch.column("ids").to_pylist()
            offsets, values = batch.column("v").offsets.to_numpy(), batch.column("v").values.to_numpy(zero_copy_only=False)
            for r, head in enumerate(heads):
                if head != place:
                    if waiting:
                        yield answers(data, ids, graph, np.stack(waiting), own)
                    place, points, ids, graph, waiting, own = head, [], [], None, [], []
                vector = values[offsets[r] : offsets[r + 1]]
                if not kinds[r]:
                    points.append(vector)
                    ids.append(lists[r])
                    continue
                if not points:
                    continue
                if graph is None:
                    data = np.stack(points)
                    graph = build(data.astype(np.float32))
                waiting.append(vector)
                own.append(lists[r][0])
                if len(waiting) == BATCH:
                    yield answers(data, ids, graph, np.stack(waiting), own)
                    waiting, own = [], []
        if waiting:
            yield answers(data, ids, graph, np.stack(waiting), own)

    found = both.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
