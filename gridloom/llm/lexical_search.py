"""Ranked lexical search: variable-block-max WAND on shards.

A shard is a bounded number of documents of one task, indexed where they lie: for each
term the documents that hold it, in order, with their counts. Posting lists are cut into
blocks of variable length by dynamic programming: with the blocks' maxima as bounds of
their postings, the cut has the least sum of bound minus value, a block costing as much as
BLOCK_COST (Mallia et al., "Faster BlockMax WAND with variable-sized blocks", 2017).

A search takes the borders of all its terms' blocks together. Between two borders, the sum
of the terms' block maxima bounds every document's score. The walk goes from one place
where that sum reaches the floor, the k-th best score so far, to the next (the pivot) and
reads no posting in between. Floors start from the lists' own k-th best values and from the
most promising places, and go on from shard to shard of a task. A task gives k rows an
item at most; two windows keep the k best, the first over parts of an item's rows.

What a term weighs depends on all documents. Postings don't, so one pass over the texts
makes the shards, their sums give the statistics, and the second pass reads shards alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, tidy
from .textkit import ranges, terms_of

#: Documents and postings of a shard; postings of a block at most, and what a block costs.
SHARD_DOCS, SHARD_TERMS, LONGEST, BLOCK_COST = 16_384, 4_000_000, 64, 2_000_000.0
#: Bytes of items searched in one pass; places read at once; parts of an item's rows.
ITEM_BYTES, STRETCH, PARTS = 16 << 20, 16, 64
#: Fixed values of the score: occurrences saturate, lengths count by half.
SCALE, SATURATION, LENGTH_SHARE = 1_000_000_000, 20, 50

SHARD = "n_docs long, n_terms long, terms array<binary>, sizes array<long>, docs binary, counts binary, ids binary, unnamed binary, lengths binary"


def _shard(vocabulary: dict[bytes, int], hits: list[np.ndarray], lengths: list[int], ids: list[int | None]) -> pd.DataFrame:
    """One shard as a row: postings by term, then by document."""
    n = len(lengths)
    pairs = np.concatenate(hits) * n + np.repeat(np.arange(n), [len(h) for h in hits])
    pairs, counts = np.unique(pairs, return_counts=True)
    term, sizes = np.unique(pairs // n, return_counts=True)
    names = list(vocabulary)
    none = np.array([i is None for i in ids])
    return pd.DataFrame({
        "n_docs": [n], "n_terms": [sum(lengths)], "terms": [[names[t] for t in term]], "sizes": [sizes],
        "docs": [(pairs % n).astype(np.int32).tobytes()], "counts": [counts.astype(np.int32).tobytes()],
        "ids": [np.array([i or 0 for i in ids], np.int64).tobytes()], "unnamed": [none.tobytes()], "lengths": [np.array(lengths, np.int64).tobytes()],
    })


def build_shards(docs: DataFrame, terms: list[bytes] | None = None) -> DataFrame:
    """The index of ``docs(doc_id, text)``, a row a shard: of ``terms`` alone, or of all.
    All documents with a term of any kind are in it, and their lengths count all terms."""
    given = None if terms is None else docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary: dict[bytes, int] = {} if given is None else given.value
        hits, lengths, ids, held = [], [], [], 0
        for pdf in batches:
            for doc_id, unnamed, data in zip(pdf["doc_id"], pdf["unnamed"], pdf["text"], strict=True):
                words = terms_of(data or b"")
                if not words:
                    continue
                found = [vocabulary.setdefault(w, len(vocabulary)) for w in words] if given is None else [v for v in map(vocabulary.get, words) if v is not None]
                hits.append(np.array(found, np.int64))
                lengths.append(len(words))
                ids.append(None if unnamed else int(doc_id))
                held += len(found)
                if len(lengths) >= SHARD_DOCS or held >= SHARD_TERMS:
                    yield _shard(vocabulary, hits, lengths, ids)
                    hits, lengths, ids, held = [], [], [], 0
                    if given is None:
                        vocabulary = {}
        if lengths:
            yield _shard(vocabulary, hits, lengths, ids)

    id_ = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(id_, F.lit(0)).alias("doc_id"), id_.isNull().alias("unnamed"), F.col("text").cast("binary").alias("text")).mapInPandas(tidy(rows), SHARD)


def cut_blocks(values: np.ndarray, ends: np.ndarray, longest: int = LONGEST, cost: float = BLOCK_COST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut lists of values (list i ends before ``ends[i]``) into blocks of ``longest`` at
    most, so that the sum over all values of their block's maximum less the value, and of
    ``cost`` a block, is least. Returns the blocks' ends, maxima, and each list's number of
    blocks up to it.

    All lists go forward together, a value a step. A ring holds, for the last ``longest``
    places where a block can begin, the best cost before it and the maximum since.
    """
    sizes = np.diff(ends, prepend=0)
    order = np.argsort(-sizes, kind="stable")
    first, by_size = (ends - sizes)[order], sizes[order]
    lists = len(ends)
    most, before = np.zeros((lists, longest)), np.full((lists, longest), np.inf)
    best, total, length = np.zeros(lists), np.zeros(lists), np.zeros(len(values), np.int64)
    slots = np.arange(longest)
    active = lists - np.searchsorted(by_size[::-1], np.arange(int(by_size[0]) if lists else 0), "right")
    for j, t in enumerate(active):
        slot = j % longest
        x = values[first[:t] + j].astype(np.float64)
        np.maximum(most[:t], x[:, None], out=most[:t])
        most[:t, slot], before[:t, slot] = x, best[:t] + total[:t]
        lengths = (slot - slots) % longest + 1
        sums = before[:t] + most[:t] * lengths
        pick = sums.argmin(axis=1)
        total[:t] += x
        best[:t] = sums[np.arange(t), pick] - total[:t] + cost
        length[first[:t] + j] = lengths[pick]
    cut = np.zeros(len(values) + 1, bool)
    at = ends[sizes > 0]
    floor = (ends - sizes)[sizes > 0]
    while len(at):  # one block of every list that has some left
        cut[at] = True
        at = at - length[at - 1]
        left = at > floor
        at, floor = at[left], floor[left]
    block_ends = np.flatnonzero(cut)
    starts = np.concatenate(([0], block_ends[:-1]))
    maxima = np.maximum.reduceat(values, starts) if len(block_ends) else np.zeros(0, values.dtype)
    return block_ends, maxima, np.searchsorted(block_ends, ends, "right")


class Best:
    """The k best rows of every item so far; equal scores by id, rows without an id last."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.rows = [np.zeros((0, 3), np.int64) for _ in range(items)]  # -score, without id, id

    def floor(self, item: int) -> int:
        return int(-self.rows[item][-1, 0]) if len(self.rows[item]) == self.k else 1

    def add(self, item: int, scores: np.ndarray, unnamed: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.rows[item], np.column_stack([-scores, unnamed, ids])])
        self.rows[item] = rows[np.lexsort(rows.T[::-1])[: self.k]]


class Shard:
    """A shard that is ready for searches."""

    def __init__(self, row: pd.Series, n_docs: int, n_terms: int, k: int) -> None:
        self.places = {bytes(t): i for i, t in enumerate(row["terms"])}
        self.docs, counts = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["counts"], np.int32).astype(np.int64)
        self.ids, self.unnamed = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["unnamed"], bool)
        lengths = np.frombuffer(row["lengths"], np.int64)
        m = 100 - LENGTH_SHARE + LENGTH_SHARE * lengths * n_docs // n_terms
        self.values = SCALE * counts // (1000 * counts + SATURATION * m[self.docs])
        self.ends = np.cumsum(np.asarray(row["sizes"], np.int64))
        self.block_ends, self.maxima, self.blocks = cut_blocks(self.values, self.ends)
        self.last = self.docs[self.block_ends - 1]
        self.sums = np.zeros(len(lengths), np.int64)
        self.k = k

    def _list(self, t: int) -> slice:
        return slice(int(self.ends[t - 1]) if t else 0, int(self.ends[t]))

    def search(self, item: int, terms: dict[bytes, int], best: Best) -> None:
        """Add the shard's rows for an item, its terms given with their weights."""
        found = [(self.places[t], w) for t, w in terms.items() if t in self.places and w > 0]
        if not found:
            return
        floor = best.floor(item)
        lists = []
        for t, w in found:
            own, blocks = self._list(t), slice(int(self.blocks[t - 1]) if t else 0, int(self.blocks[t]))
            values = self.values[own]
            if len(values) >= self.k:  # k documents have this much from one term alone
                floor = max(floor, w * int(np.partition(values, len(values) - self.k)[len(values) - self.k]))
            lists.append((w, self.docs[own], values, self.last[blocks], np.append(self.maxima[blocks], 0)))
        borders = np.unique(np.concatenate([last for _, _, _, last, _ in lists]))
        bounds = np.zeros(len(borders), np.int64)
        for w, _, _, last, maxima in lists:
            bounds += w * maxima[np.searchsorted(last, borders)]
        promising = np.argsort(-bounds, kind="stable")[:STRETCH]
        floor = self._read(np.sort(promising), borders, lists, floor, item, best)
        read = np.zeros(len(borders), bool)
        read[promising] = True
        pivots = np.flatnonzero((bounds >= floor) & ~read)
        for a in range(0, len(pivots), STRETCH):
            some = pivots[a : a + STRETCH]
            some = some[bounds[some] >= floor]
            if len(some):
                floor = self._read(some, borders, lists, floor, item, best)

    def _read(self, places: np.ndarray, borders: np.ndarray, lists: list, floor: int, item: int, best: Best) -> int:
        """Score all documents of some places exactly; returns the new floor."""
        low = np.where(places > 0, borders[places - 1], -1)
        high = borders[places]
        for w, docs, values, _, _ in lists:
            a, b = np.searchsorted(docs, low, "right"), np.searchsorted(docs, high, "right")
            at = ranges(a, b - a)
            self.sums[docs[at]] += w * values[at]
        within = ranges(low + 1, high - low)
        scores = self.sums[within]
        self.sums[within] = 0
        good = np.flatnonzero(scores >= floor)
        if len(good) > self.k:
            good = good[scores[good] >= np.partition(scores[good], len(good) - self.k)[len(good) - self.k]]
        if len(good):
            best.add(item, scores[good], self.unnamed[within[good]], self.ids[within[good]])
        return max(floor, best.floor(item))


def _searching(shared: Broadcast, n_docs: int, n_terms: int, k: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, items = shared.value
        best = Best(len(items), k)
        for pdf in batches:
            for _, row in pdf.iterrows():
                shard = Shard(row, n_docs, n_terms, k)
                for item, terms in enumerate(items):
                    shard.search(item, terms, best)
        for key, found in zip(keys, best.rows, strict=True):
            if len(found):
                yield pd.DataFrame({"key": key, "unnamed": found[:, 1] > 0, "doc_id": found[:, 2], "score": -found[:, 0]})

    return rows


def weigh(df: int, n_docs: int) -> int:
    """A term's weight, from the number of documents that hold it."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above
    0. ``docs(doc_id, text)`` and ``items(item_id, text)``; terms are runs of letters, digits
    and characters beyond ASCII.

    Every row counts by itself: repeated documents are ranked each, a repeated item_id has
    ranks of its own. Equal scores go by doc_id, documents without one last; between rows of
    one id, to either. Null, empty and termless texts are no documents, and items without
    terms have no rows. Texts are taken whole; further columns are ignored whatever their
    names; with either table empty there are no rows.

    Items are searched in passes of ITEM_BYTES of text, what a broadcast and the driver can
    hold; each pass indexes the terms of its items.
    """
    spark = docs.sparkSession
    asked = materialize(items.select(F.monotonically_increasing_id().alias("key"), "item_id", F.col("text").cast("binary").alias("text")), "lexical-items")
    passes = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // ITEM_BYTES))
    found, written = [], []
    for n in range(passes):
        some = [(r["key"], dict.fromkeys(terms_of(r["text"] or b""), 0)) for r in asked.filter(F.pmod(F.xxhash64("key"), F.lit(passes)) == n).collect()]
        vocabulary = sorted({t for _, terms in some for t in terms})
        shards = materialize(build_shards(docs, vocabulary), "lexical-shards")
        n_docs, n_terms = (v or 0 for v in shards.agg(F.sum("n_docs"), F.sum("n_terms")).head())
        each = shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy(F.col("x.terms").alias("term"))
        weights = {bytes(r["term"]): weigh(r["df"], n_docs) for r in each.agg(F.sum("x.sizes").alias("df")).collect()}
        shared = spark.sparkContext.broadcast(([key for key, _ in some], [{t: weights[t] for t in terms if t in weights} for _, terms in some]))
        rows = shards.mapInPandas(tidy(_searching(shared, n_docs, n_terms, k)), "key long, unnamed boolean, doc_id long, score long")
        found.append(materialize(rows, "lexical-found"))
        written.append(shards)
    discard(*written)
    order = [F.desc("score"), "unnamed", "doc_id"]
    ranked = reduce(DataFrame.unionByName, found).withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    for by in (["key", "part"], ["key"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.join(asked.select("key", "item_id"), "key").select("item_id", "rank", F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), "score")
