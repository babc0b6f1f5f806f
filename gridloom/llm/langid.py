"""Language identification by error-correcting output codes.

Each language gets a codeword; each bit of it is predicted by one binary classifier on
hashed byte n-grams, naive Bayes over the texts of the languages with a 1 against those
with a 0. A text's n-grams give each classifier a mean log-odds; decoding sums the
logistic loss of every codeword's bits, weighted by how well a bit's two sides are
apart in training, and takes the nearest codeword. A small gap to the second nearest
flags the text as ambiguous.

Training is one pass that sums n-gram counts by language, over all learnable texts. What
the classifiers need of that table (languages by buckets) is summed up in Spark, so the
driver gets buckets by bits, and the languages' names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_name, give_back, materialize, sized, small_batches, tidy
from .textkit import chunks

#: Hash buckets of n-grams, n-gram lengths in bytes, code bits beyond seven languages,
#: the scale of a mean log-odds before the loss, and languages that a task counts at a time.
BUCKETS, GRAMS, BITS, SCALE, HELD = 1 << 15, (1, 2, 3), 63, 4.0, 256
AMBIGUOUS = 0.15
_MAYBE_LETTER = re.compile(r"[^\W\d_]").finditer


def has_letter(text: str) -> bool:
    """Whether a text has a letter; signs such as \u00b2, \u00bd or \u2167 are none."""
    return any(m.group().isalpha() for m in _MAYBE_LETTER(text))


def gram_buckets(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For chunks of texts: the first text's number, the bucket of each n-gram, and the
    number of its text. Blanks and digits count as one space; A-Z are lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[[*range(0x00, 0x21), *range(0x30, 0x3A)]] = 0x20
    table[0x41:0x5B] += 32
    for a, b in chunks(texts, 1 << 19):
        buf = table[np.frombuffer(b" " + b" ".join(texts[a:b]) + b"    ", dtype=np.uint8)].astype(np.uint32)
        sizes = np.array([len(t) + 1 for t in texts[a:b]])  # a text with the space before it
        owner = np.repeat(np.arange(b - a), sizes)
        n = len(owner)
        left = np.repeat(np.cumsum(sizes), sizes) + 1 - np.arange(n)  # bytes up to the space behind the text
        hashed, owners = [], []
        for k in GRAMS:
            key = np.full(n, k << 24, dtype=np.uint32)
            for j in range(k):
                key += buf[j : j + n] << np.uint32(8 * j)
            inside = left >= k
            hashed.append(((key * np.uint32(0x9E3779B1)) >> np.uint32(33 - BUCKETS.bit_length()))[inside])
            owners.append(owner[inside])
        yield a, np.concatenate(hashed).astype(np.int64), np.concatenate(owners)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts by language and bucket; a task holds HELD languages' at a time."""
    sums: dict[str, np.ndarray] = {}

    def counted() -> Iterator[pd.DataFrame]:
        for lang, total in sums.items():
            some = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": some.astype(np.int32), "n": total[some]})
        sums.clear()

    for pdf in batches:
        for lang, group in pdf.groupby("lang", sort=False):
            if lang not in sums and len(sums) >= HELD:
                yield from counted()
            total = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            for _, bucket, _ in gram_buckets([t.encode("utf-8", "replace") for t in group["text"]]):
                total += np.bincount(bucket, minlength=BUCKETS)
    yield from counted()


def codewords(n: int) -> np.ndarray:
    """A 0/1 row for each of n languages: all splits up to seven, else balanced columns
    in a fixed pseudo-random order, of which no two split alike: BITS, or all there are."""
    if n <= 7:
        return np.array([[(c >> i) & 1 for c in range(1, 1 << max(n - 1, 0))] for i in range(n)], dtype=np.int8).reshape(n, (1 << max(n - 1, 0)) - 1)
    rng, seen = np.random.default_rng(20), []
    there_are = comb(n, n // 2) // (2 if n % 2 == 0 else 1)  # halves of an even n split as their complements do
    while len(seen) < min(BITS, there_are):
        column = rng.permutation(np.arange(n) % 2).astype(np.int8)
        if not any((column == s).all() or (column != s).all() for s in seen):
            seen.append(column)
    return np.stack(seen, axis=1)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages by bits
    odds: np.ndarray  # buckets by bits: log-odds of a bucket for a bit
    weight: np.ndarray  # of each bit's loss


def fit(docs: DataFrame) -> Model:
    """From ``(text, lang)``; null texts or languages take no part. There may be any number
    of languages: each adds its name and codeword to the model."""
    usable = small_batches(docs).filter("text is not null and lang is not null").select("text", "lang")
    sums = usable.mapInPandas(tidy(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "language-grams")
    totals = sums.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").toPandas()  # a row a language
    names, code = totals["lang"].tolist(), codewords(len(totals))
    bits = code.shape[1]
    if not bits:
        discard(sums)
        return Model(names, code, np.zeros((BUCKETS, 0), np.float32), np.ones(0))
    # Smoothed shares: every language weighs alike, and an n-gram not seen in it has its unit.
    units = 1 / (totals["total"].to_numpy(float) + 0.5 * BUCKETS)
    words = docs.sparkSession.createDataFrame([(n, float(u), c.tolist()) for n, u, c in zip(names, units, code, strict=True)], "lang string, unit double, code array<int>")
    shares = sums.join(sized(materialize(words, "language-codewords")), "lang").withColumn("share", F.col("n") * F.col("unit"))
    on_bits = lambda f: [f(b).alias(f"b{b}") for b in range(bits)]
    ones = shares.groupBy("bucket").agg(F.sum("share").alias("all"), *on_bits(lambda b: F.sum(F.col("code")[b] * F.col("share"))))
    table = ones.toPandas().set_index("bucket")  # BUCKETS rows at most
    unseen = 0.5 * units[:, None] * code
    one, every = np.tile(unseen.sum(axis=0), (BUCKETS, 1)), np.full(BUCKETS, 0.5 * units.sum())
    one[table.index] += table[[f"b{b}" for b in range(bits)]].to_numpy(float)
    every[table.index] += table["all"].to_numpy(float)
    size = code.sum(axis=0)
    odds = (np.log(one / size) - np.log((every[:, None] - one) / (len(names) - size))).astype(np.float32)
    learned = docs.sparkSession.createDataFrame([(b, row.tolist()) for b, row in enumerate(odds.astype(float))], "bucket int, odds array<double>")
    margin = lambda b: (2 * F.first("code")[b] - 1) * (F.sum(F.col("share") * F.col("odds")[b]) + 0.5 * F.first("unit") * float(odds[:, b].sum(dtype=float)))
    margins = shares.join(F.broadcast(learned), "bucket").groupBy("lang").agg(*on_bits(margin))
    weight = np.maximum(np.array(margins.agg(*[F.min(f"b{b}") for b in range(bits)]).head(), float), 1e-3)
    discard(sums)
    return Model(names, code, odds, weight / weight.sum())


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean log-odds by text and bit -> nearest language, score, ambiguity."""
    if len(model.languages) == 1 or not model.code.shape[1]:
        return np.zeros(len(margins), int), np.ones(len(margins)), np.zeros(len(margins), bool)
    on, off = (np.logaddexp(0.0, sign * SCALE * margins) * model.weight for sign in (-1, 1))
    loss = on @ model.code.T.astype(float) + off @ (1.0 - model.code.T)
    like = np.exp(-2.0 * SCALE * (loss - loss.min(axis=1, keepdims=True)))
    like /= like.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    top2 = -np.partition(-like, 1, axis=1)[:, :2]
    return best, like[np.arange(len(best)), best], top2[:, 0] - top2[:, 1] < AMBIGUOUS


def _judge(texts: list[str], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    judged = np.array([has_letter(t) for t in texts], dtype=bool) & bool(model.languages)
    names, scores, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    some = np.flatnonzero(judged)
    margins = np.zeros((len(some), model.odds.shape[1]))
    for a, bucket, owner in gram_buckets([texts[i].encode("utf-8", "replace") for i in some]):
        count = np.bincount(owner)  # each text has a gram at least: the space before it
        for b in range(model.odds.shape[1]):
            margins[a : a + len(count), b] = np.bincount(owner, weights=model.odds[:, b][bucket]) / count
    if len(some):
        best, score, close = decode(margins, model)
        scores[some], unsure[some] = score, close
        for i, k in zip(some, best, strict=True):
            names[i] = model.languages[k]
    return names, scores, unsure


def predicted(text: Column, model: Model) -> Column:
    """A struct ``lang_pred, score, ambiguous`` of each whole text; only the text goes
    to the Python workers, the row's other columns stay where they are."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            names, scores, unsure = _judge([t or "" for t in series], shared.value)
            yield pd.DataFrame({"lang_pred": names, "score": scores, "ambiguous": unsure})
        give_back()

    return judge(text)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Predict the language of every whole text: the ``keep`` columns, ``lang_pred``
    (``und`` for a null text, one without letters, or nothing learned), ``score`` (0 to
    1, 0 for und) and ``ambiguous``. A row for each input row."""
    judged = docs.select(*keep, predicted(F.col("text"), model).alias("_judged"))
    return judged.select(*keep, "_judged.lang_pred", "_judged.score", "_judged.ambiguous")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a clear language;
    null texts, texts without letters and ambiguous ones go. The column that is judged
    by has a name that ``docs`` doesn't use."""
    name = free_name("_judged", docs)
    judged = docs.withColumn(name, predicted(F.col("text"), model))
    return judged.filter((F.col(f"{name}.lang_pred") != "und") & ~F.col(f"{name}.ambiguous")).drop(name)


def identify_split(docs: DataFrame, learnable: Column, held_out: Column) -> DataFrame:
    """Fit on the rows where ``learnable`` holds and predict all rows: ``doc_id,
    held_out, lang_pred, score, ambiguous``.

    Null texts and texts without letters are ``und``; null languages aren't learned;
    of codewords equally near, the first in the languages' order is taken (and flagged);
    repeated rows are judged alike; texts of any length are read whole; other columns
    are ignored; an empty table gives no rows, and with nothing to learn all is ``und``.
    """
    model = fit(docs.filter(learnable))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, ("doc_id", "held_out"))
