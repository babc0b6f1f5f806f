"""Importance resampling to a target distribution, drawn without replacement.

A text is a bag of features (runs of words) hashed into buckets. What a bucket is worth is
the logarithm of its share in the target over its share in the corpus, kept in one array; a
document's weight is the sum over its features. With Gumbel noise added (from the id and a
seed), the highest scores are a sample without replacement in which documents come with
chances proportional to the exponential of their weights (Xie et al., "Data selection for
language models via importance resampling", 2023).

The draw is a merge of sorted runs: every task sorts its eligible rows and cuts the run at
bounds common to all; one table holds the slices. A range of scores is then one task's
work, of a bounded size: a tournament tree over its slices gives the rows in order. How many
rows lie in front of a range is known from the slices' sizes, so ranges beyond the draw are
never read, the last one stops at the exact count, and ranks follow without a global sort.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized, tidy
from .textkit import CHUNK, chunks, terms_of

#: Defaults: buckets, words of a feature at most, seed, percent drawn, fewest words.
BUCKETS, RUN_WORDS, SEED, PERCENT, FEWEST = 10_000, 1, 2024, 10, 20
#: Rows of a range of scores and of a run, sampled rows that a range's bounds come from,
#: runs that one tree merges, words whose worth a task remembers.
RANGE_ROWS, RUN_ROWS, SAMPLES, FAN_IN, WORDS = 1_000_000, 1_000_000, 16, 256, 500_000

def features(words: list[bytes], most: int) -> Iterator[bytes]:
    """All runs of 1 to ``most`` words in a row."""
    yield from words
    for n in range(2, most + 1):
        for i in range(len(words) - n + 1):
            yield b" ".join(words[i : i + n])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, most: int = RUN_WORDS, text: str = "text") -> DataFrame:
    """``(bucket int, n long)`` of all features of all texts; null texts have none. A task
    gives a row a bucket, which are summed where they meet."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for pdf in batches:
            for a, b in chunks(pdf["text"].tolist(), CHUNK):
                found: Counter[bytes] = Counter()
                for data in pdf["text"].iloc[a:b]:
                    found.update(features(terms_of(data), most))
                at = np.fromiter((zlib.crc32(f) for f in found), np.int64, len(found)) % buckets
                np.add.at(total, at, np.fromiter(found.values(), np.int64, len(found)))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some.astype(np.int32), "n": total[some]})

    given = texts.select(F.col(text).cast("binary").alias("text")).filter("text is not null")
    return given.mapInPandas(tidy(rows), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """What each bucket is worth, in thousandths: floor(1000 ln) of its share in the target
    over that in the corpus, one occurrence added to each. ``buckets`` rows at most."""
    s, t = (np.zeros(buckets, np.int64) for _ in range(2))
    for counts, into in ((corpus, s), (target, t)):
        for row in counts.collect():
            into[row["bucket"]] = row["n"]
    total_s, total_t = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((int(b) + 1) * total_s / ((int(a) + 1) * total_t))) for a, b in zip(s, t, strict=True)], np.int64)


def _weighing(worth: Broadcast, most: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array = worth.value

        class Worth(dict):
            def __missing__(self, feature: bytes) -> int:
                value = int(array[zlib.crc32(feature) % len(array)])
                if len(self) < WORDS:
                    self[feature] = value
                return value

        known = Worth()
        for pdf in batches:
            n_words, n_features, weights = [], [], []
            for data in pdf["text"]:
                words = terms_of(data or b"")
                n_words.append(len(words))
                n_features.append(sum(max(0, len(words) - k) for k in range(most)))
                weights.append(sum(map(known.__getitem__, features(words, most))))
            yield pd.DataFrame({"row": pdf["row"], "doc_id": pdf["doc_id"], "n_words": n_words, "n_features": n_features, "weight": weights}).astype({c: np.int64 for c in ("n_words", "n_features", "weight")})

    return rows


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256("seed:id"); a null id
    counts as the empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


# The order of the draw: scores descending, then ids, null ids last, then rows.
_KEY = ["drop", "none", "id", "row"]


def _sorted(pdf: pd.DataFrame) -> np.ndarray:
    """Rows of ``_KEY``, in order."""
    key = pdf[_KEY].to_numpy(np.int64)
    return key[np.lexsort(key.T[::-1])]


def _below(run: np.ndarray, bound: tuple[int, ...]) -> int:
    """How many rows of a sorted run are before the bound: narrowed down column by column."""
    lo, hi = 0, len(run)
    for c, value in enumerate(bound):
        left, right = (np.searchsorted(run[lo:hi, c], value, side) for side in ("left", "right"))
        if left == right:
            return lo + int(left)
        lo, hi = lo + int(left), lo + int(right)
    return lo


def _slicing(bounds: Broadcast):
    """Sort a task's rows into runs of RUN_ROWS at most and cut each at the bounds."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def cut() -> Iterator[pd.DataFrame]:
            run = _sorted(pd.concat(held))
            at = [0, *(_below(run, b) for b in bounds.value), len(run)]
            some = [k for k in range(len(at) - 1) if at[k + 1] > at[k]]
            yield pd.DataFrame({"slot": some, "size": [at[k + 1] - at[k] for k in some], "keys": [run[at[k] : at[k + 1]].tobytes() for k in some]})

        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= RUN_ROWS:
                yield from cut()
                held, n = [], 0
        if n:
            yield from cut()

    return rows


class Tournament:
    """A tree of losers over sorted runs: each inner node keeps the run that lost there, so
    the next row costs one comparison a level."""

    def __init__(self, runs: list[np.ndarray]) -> None:
        self.runs = [iter(map(tuple, run.tolist())) for run in runs]
        self.end = (math.inf,) * len(_KEY)
        self.heads = [next(run, self.end) for run in self.runs]
        self.leaves = len(runs)
        self.losers = [0] * self.leaves
        winners = [0] * self.leaves + list(range(self.leaves))
        for node in range(self.leaves - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if self.heads[b] < self.heads[a]:
                a, b = b, a
            winners[node], self.losers[node] = a, b
        self.best = winners[1] if self.leaves > 1 else 0

    def take(self, most: int) -> list[tuple[int, ...]]:
        """The next rows in order, ``most`` at most."""
        out, heads, losers, best = [], self.heads, self.losers, self.best
        while len(out) < most and heads[best] is not self.end:
            out.append(heads[best])
            heads[best] = next(self.runs[best], self.end)
            node = (best + self.leaves) // 2
            while node:
                if heads[losers[node]] < heads[best]:
                    losers[node], best = best, losers[node]
                node //= 2
        self.best = best
        return out


def merge(runs: list[np.ndarray], most: int) -> np.ndarray:
    """The first ``most`` rows of all runs in order. More than FAN_IN runs are merged in
    passes, each of which makes longer runs, none longer than what is still needed."""
    while len(runs) > FAN_IN:
        runs = [np.array(Tournament(runs[a : a + FAN_IN]).take(most), np.int64).reshape(-1, len(_KEY)) for a in range(0, len(runs), FAN_IN)]
    return np.array(Tournament(runs).take(most), np.int64).reshape(-1, len(_KEY)) if runs else np.zeros((0, len(_KEY)), np.int64)


def _merging(before: Broadcast, draws: int):
    def rows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = before.value[key[0]]
        drawn = merge([np.frombuffer(k, np.int64).reshape(-1, len(_KEY)) for k in pdf["keys"]], draws - first)
        return pd.DataFrame({"row": drawn[:, _KEY.index("row")], "rank": first + 1 + np.arange(len(drawn))})

    return rows


def draw_highest(scored: DataFrame, draws: int, rows: int) -> DataFrame:
    """``scored(row, doc_id, score)``, ``rows`` of them -> ``(row, rank)`` of the ``draws``
    highest scores, ties to the smaller id, null ids last, of equal ids the smaller row.

    Bounds are taken from rows picked by hash, SAMPLES a range, so a range holds RANGE_ROWS
    rows, about, or fewer where more tasks than ranges can run; rows of one score and one id
    are told apart by their key, so none is unsplit. The driver keeps a count and SAMPLES
    rows a range, RANGE_ROWS of which stand for each.
    """
    spark = scored.sparkSession
    keys = scored.select((-F.col("score")).alias("drop"), F.col("doc_id").isNull().cast("long").alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), "row")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    every = max(1, rows // (ranges * SAMPLES))
    some = sorted(tuple(r) for r in keys.filter(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).collect())
    places = sorted({len(some) * k // ranges for k in range(1, ranges)}) if some else []
    bounds = spark.sparkContext.broadcast([some[p] for p in places if p])
    slices = materialize(keys.mapInPandas(_slicing(bounds), "slot int, size long, keys binary"), "resampling-slices")
    before, first = 0, {}
    for slot, size in sorted(tuple(r) for r in slices.groupBy("slot").agg(F.sum("size")).collect()):
        if before < draws:
            first[slot] = before
        before += size
    wanted = slices.filter(F.col("slot") <= max(first, default=-1)).groupBy("slot")
    return wanted.applyInPandas(_merging(spark.sparkContext.broadcast(first), draws), "row long, rank long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, fewest: int = FEWEST, buckets: int = BUCKETS, most: int = RUN_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document: rank is 1, 2, 3... in
    the order in which documents are drawn, null for the others. floor(percent% of those
    with ``fewest`` words or more) are drawn, these only; a feature is a run of up to ``most``
    words. ``target`` needs a column ``text``.

    Every row counts by itself, repeated ones too; ties go to the smaller id, null ids last,
    and between rows of one id to either. Null, empty and wordless texts have no features,
    weight 0 and a score, and are never drawn while ``fewest`` is above 0. Texts are taken
    whole. Further columns are ignored whatever their names. An empty corpus gives no rows;
    with an empty target, the buckets that the corpus fills most weigh least.
    """
    spark = docs.sparkSession
    worth = spark.sparkContext.broadcast(gains(bucket_counts(docs, buckets, most), bucket_counts(target, buckets, most), buckets))
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    weighed = given.mapInPandas(tidy(_weighing(worth, most)), "row long, doc_id long, n_words long, n_features long, weight long")
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resampling-scored")
    eligible = scored.filter(F.col("n_words") >= fewest)
    rows = eligible.count()
    ranked = materialize(draw_highest(eligible.select("row", "doc_id", "score"), percent * rows // 100, rows), "resampling-ranks")
    return scored.join(sized(ranked), "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
