"""Connected components of an edge list by alternating large-star and small-star
steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Edges from which on a node is looked up in a broadcast table, and such nodes at most.
HEAVY, HEAVY_NODES = 256, 100_000


def _larger_first(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")


def _with_least(edges: DataFrame, heavy: int) -> DataFrame:
    """``edges`` with m, the least v of their u. A u with more than ``heavy`` edges is
    looked up in a broadcast table, whose rows number the edges over ``heavy`` at most,
    so a star's edges stay where they are; the rest is joined by u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    known = edges.join(F.broadcast(least.filter(F.col("c") > heavy).select("u", F.col("m").alias("hm"))), "u", "left")
    light = known.filter("hm is null").select("u", "v").join(least.filter(F.col("c") <= heavy).select("u", "m"), "u")
    return known.filter("hm is not null").select("u", "v", F.col("hm").alias("m")).unionByName(light)


def _large_star(edges: DataFrame, heavy: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, heavy).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, heavy: int) -> DataFrame:
    moved = _with_least(edges, heavy)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(moved.select("u", F.col("m").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether ``edges``, larger end first, are stars already: no node has two smaller ends,
    or one while being another's."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.count_if((F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") == 1))).head()[0]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges(u, v)`` of one orderable type -> ``(node, label)`` for every node that
    an edge between two different nodes touches; label: the component's least node.

    Every round is a few shuffles of the edge list, until it is a star per component; edges
    that are stars need no round. Nothing is collected. Rounds grow with the logarithm of the
    longest chain. Repeated edges and loops change nothing; no edges give no rows.
    """
    now = materialize(_larger_first(edges).distinct(), name)
    while not _settled(now):
        heavy = max(HEAVY, now.count() // HEAVY_NODES)
        mid = materialize(_larger_first(_large_star(now, heavy)), name)  # no more edges than before, some repeated
        after = materialize(_larger_first(_small_star(mid, heavy)).distinct(), name)
        discard(now, mid)
        now = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
