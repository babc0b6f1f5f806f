"""Exact top-k inner product search by columnar branch and bound.

Candidates stay where they are: every Arrow batch of them is a block in vertical layout
(dimensions by rows). Queries come to them in batches of a bounded size, one broadcast
after the other. For a block of queries and a block of candidates, scores accumulate a
few dimensions at a time; what the remaining dimensions can add is bounded by the product
of the remaining norms (Cauchy-Schwarz). Candidates whose bound falls below the query's
floor, the k-th best score that the task has found so far, are compacted away. The floors
go on from block to block, so later blocks are cut sooner. A task gives k rows a query at
most, and a window keeps the k best.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Dimensions accumulated at once; bytes of queries in a broadcast.
STEP, QUERY_BYTES = 16, 32 << 20


class Floors:
    """The k best of each query so far: scores, ids and keys, best first, ties by id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]


def rest_norms(rows: np.ndarray, cuts: list[int]) -> np.ndarray:
    """By cut and column: the norm of what lies behind the cut; rows: vertical."""
    rest = np.zeros((len(cuts), rows.shape[1]))
    for b in range(len(cuts) - 2, -1, -1):
        rest[b] = rest[b + 1] + (rows[cuts[b] : cuts[b + 1]] ** 2).sum(axis=0)
    return np.sqrt(rest)


def search_block(queries: np.ndarray, query_keys: np.ndarray, rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, best: Floors) -> None:
    """Add a block's rows to ``best``; queries: horizontal, rows: vertical, integers held
    as doubles; a row whose key is the query's is the query itself."""
    dims = rows.shape[0]
    cuts = [*range(0, dims, STEP), dims]
    rest, query_rest = rest_norms(rows, cuts), rest_norms(queries.T, cuts)
    for a in range(0, len(queries), 64):
        first = queries[a : a + 64, : cuts[1]] @ rows[: cuts[1]]
        for q, partial in enumerate(first, start=a):
            alive = np.flatnonzero(keys != query_keys[q])
            partial = partial[alive]
            for b in range(1, len(cuts) - 1):
                if best.scores[q, -1] == -np.inf and len(alive) > best.k:  # exact scores of the most promising give the first floor
                    some = alive[np.argpartition(-partial, best.k - 1)[: best.k]]
                    floor = (queries[q] @ rows[:, some]).min()
                else:
                    floor = best.scores[q, -1]
                bound = partial + query_rest[b, q] * rest[b][alive] * (1 + 1e-9) + 1e-6
                keep = bound >= floor
                if not keep.all():
                    alive, partial = alive[keep], partial[keep]
                part = rows[cuts[b] : cuts[b + 1]]
                partial = partial + queries[q, cuts[b] : cuts[b + 1]] @ (part if len(alive) == part.shape[1] else part[:, alive])
            keep = partial >= best.scores[q, -1]
            if keep.any():
                alive, partial = alive[keep], partial[keep]
                if len(alive) > best.k:
                    keep = partial >= -np.partition(-partial, best.k - 1)[best.k - 1]
                    alive, partial = alive[keep], partial[keep]
                best.add(q, partial, ids[alive])


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def _search(shared: Broadcast, k: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = {dims: (_matrix(some["v"]), some["key"].to_numpy(np.int64)) for dims, some in shared.value.groupby("dims")}
        names = {dims: some["vec_id"].to_numpy(np.int64) for dims, some in shared.value.groupby("dims")}
        best = {dims: Floors(len(keys), k) for dims, (_, keys) in queries.items()}
        for pdf in batches:
            for dims, some in pdf.groupby("dims"):
                if dims in queries:
                    vertical = np.ascontiguousarray(_matrix(some["v"]).T)
                    search_block(*queries[dims], vertical, some["vec_id"].to_numpy(np.int64), some["key"].to_numpy(np.int64), best[dims])
        for dims, found in best.items():
            q, place = np.nonzero(found.scores > -np.inf)
            yield pd.DataFrame({"query": queries[dims][1][q], "query_id": names[dims][q], "vec_id": found.ids[q, place], "score": found.scores[q, place].round().astype(np.int64)})

    return rows


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Each query's ``k`` best rows by the inner product of floor(scale * component).

    vectors: ``vec_id``, ``embedding`` (array of float or double); other columns are
    ignored. Queries are the rows whose id is divisible by ``every``; candidates all
    rows but the query's own. Returns ``query_id, rank, vec_id, score``; ties go to the
    smaller id. Rows that share an id, or are equal, are rows of their own: each is a
    candidate, and each a query with ranks of its own if its id is divisible.

    Vectors that are null, empty, hold null or non-finite components, or have a null id
    take no part. Vectors of different lengths aren't compared. Scores are exact while
    their terms' sum stays below 2^53, as for any embedding of ordinary scale; a component
    whose scaled value is 2^31 or more is an error. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    usable = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & whole)
    fits = F.forall("v", lambda c: F.abs(c) < 2**31)
    ints = usable.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))
    ints = ints.select("vec_id", F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit("component too large for an exact score"))).alias("v"))
    ints = materialize(ints.select(F.monotonically_increasing_id().alias("key"), "vec_id", "v", F.size("v").alias("dims")), "topk-vectors")
    queries = ints.filter(F.col("vec_id") % every == 0)
    size = queries.agg(F.coalesce(F.sum(8 * F.col("dims") + 24), F.lit(0))).head()[0]
    rounds = max(1, -(-size // query_bytes))
    dealt = queries.withColumn("round", F.pmod(F.xxhash64("key"), F.lit(rounds)))
    found = []
    for i in range(rounds):  # query_bytes, about, in the driver and in a broadcast
        shared = spark.sparkContext.broadcast(dealt.filter(F.col("round") == i).drop("round").toPandas())
        found.append(materialize(ints.mapInPandas(_search(shared, k), "query long, query_id long, vec_id long, score long"), "topk-found"))
        shared.destroy()
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
