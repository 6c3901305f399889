"""Connected components of an undirected edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumentab.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is hung under the smallest neighbour of that node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are hung under the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = lowest.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).filter("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """True when every edge leads to the root of a star: no target has an edge of its own, no source two."""
    several = edges.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).filter("a <> b").select("u")
    onward = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u")
    return several.unionByName(onward).isEmpty()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component``; the component is the smallest id in it. Nodes without edges stay alone.

    ``nodes`` has ``id``, ``edges`` has ``u, v``. Alternates two star contractions on the
    edge list until only stars are left, which is checked edge by edge; each round shortens
    every chain, so the rounds follow the logarithm of the longest one. Group minima are
    combined map-side and joined back, so a node with very many neighbours is split like any
    skewed join. Each round is written to the reliable checkpoint folder; a session with
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` removes it after use.
    """
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = cut_lineage(down.filter("u <> v").distinct())
    while not _settled(current):
        current = cut_lineage(_small_star(_large_star(current)))
    stars = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.join(stars, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
