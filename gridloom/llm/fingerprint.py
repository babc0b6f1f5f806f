"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A fingerprint is a wide vector, the sum over a text's paragraphs (lines) of a vector
hashed from each, lane by lane modulo a power of two. Sums don't depend on order, and
adding or subtracting a paragraph's vector inserts or deletes it. Two groups of lanes:

- equality: 16 lanes modulo 2^64, hashed from the whole paragraph. Texts with the same
  multiset of paragraphs agree; others don't, but for a hash collision.
- likeness: 128 lanes modulo 2^32. Each run of three words of the paragraph (fewer words
  count whole) adds +1 or -1 to one lane, so the squared norm of a difference estimates
  how many runs differ (Charikar et al.'s count sketch). Likeness of two fingerprints:
  1 - |A - B|^2 / (|A|^2 + |B|^2), not below 0.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import chunks, hashed_words, mix

EQUAL_LANES, LIKE_LANES, RUN = 16, 128, 3
#: Characters of text in a range of ids, about, and ranges at most: the driver holds a row of each.
RANGE_CHARS, MOST_RANGES = 64 << 20, 100_000
_WEIGHTS = mix(np.arange(11, 11 + RUN, dtype=np.uint64)) | np.uint64(1)


def _equality(text: bytes) -> np.ndarray:
    wide = b"".join([hashlib.shake_128(p).digest(8 * EQUAL_LANES) for p in text.split(b"\n")])
    return np.frombuffer(wide, "<u8").reshape(-1, EQUAL_LANES).sum(axis=0, dtype=np.uint64)


def _likeness_lanes(texts: list[bytes]) -> np.ndarray:
    """A row of lanes for each text; runs of words don't cross a line's end."""
    out = np.zeros((len(texts), LIKE_LANES), dtype=np.int64)
    for a, b in chunks(texts):
        buf, starts, _, hashes, first = hashed_words([t.lower() for t in texts[a:b]])
        if not len(hashes):
            continue
        doc = np.repeat(np.arange(b - a), np.diff(first))
        line = np.searchsorted(np.flatnonzero(buf == 0x0A), starts) + doc  # ascending; differs between lines and texts
        begins = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1]))))
        sizes = np.diff(np.append(begins, len(hashes)))
        place = np.arange(len(hashes)) - np.repeat(begins, sizes)
        room = np.repeat(sizes, sizes)
        runs = np.zeros(len(hashes), dtype=np.uint64)
        for k in range(RUN):
            runs[: len(hashes) - k] += np.where((place + k < room)[: len(hashes) - k], hashes[k:] * _WEIGHTS[k], np.uint64(0))
        runs = mix(runs)[(place + RUN <= room) | (place == 0)]
        owner = doc[(place + RUN <= room) | (place == 0)]
        lane = (runs % np.uint64(LIKE_LANES)).astype(np.int64)
        sign = np.where(runs >> np.uint64(63), 1, -1)
        out[a:b] = np.bincount(owner * LIKE_LANES + lane, weights=sign, minlength=(b - a) * LIKE_LANES).reshape(b - a, LIKE_LANES)
    return out


def fingerprints(texts: list[str]) -> list[bytes]:
    """The lanes of each text: equality lanes, then likeness lanes, little-endian."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    like = _likeness_lanes(raw).astype("<u4")
    return [_equality(t).astype("<u8").tobytes() + row.tobytes() for t, row in zip(raw, like, strict=True)]


def combine(a: bytes, b: bytes, sign: int = 1) -> bytes:
    """a plus (or minus) b: the fingerprint after inserting (or deleting) paragraphs."""
    cut = 8 * EQUAL_LANES
    wide = np.frombuffer(a[:cut], "<u8") + np.uint64(sign % (1 << 64)) * np.frombuffer(b[:cut], "<u8")
    like = np.frombuffer(a[cut:], "<u4") + np.uint32(sign % (1 << 32)) * np.frombuffer(b[cut:], "<u4")
    return wide.astype("<u8").tobytes() + like.astype("<u4").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    cut = 8 * EQUAL_LANES
    if a == b:
        return 1.0
    x, y = (np.frombuffer(v[cut:], "<i4").astype(np.float64) for v in (a, b))
    away = (np.frombuffer(a[cut:], "<u4") - np.frombuffer(b[cut:], "<u4")).view("<i4").astype(np.float64)
    norms = (x @ x) + (y @ y)
    return float(max(0.0, 1.0 - (away @ away) / norms)) if norms else 0.0


def text_of(fingerprint: bytes) -> str:
    return base64.b64encode(fingerprint).decode()


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)``, a row for each input row; a null text is empty."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prints = fingerprints([t or "" for t in pdf["text"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fingerprint": [text_of(p) for p in prints]})

    return docs.select("doc_id", "text").mapInPandas(rows, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the following one's beginning."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _emit(rows: list[tuple[int | None, str]], texts: list[str]) -> pd.DataFrame:
    """rows: (id, text) in order; texts[i + 1] follows texts[i]."""
    own = [t for _, t in rows]
    changed = [edited(t, n) for t, n in zip(own, texts[1 : len(own) + 1], strict=True)]
    prints = fingerprints(texts[: len(own) + 1] if len(texts) > len(own) else texts)
    other = fingerprints(changed)
    return pd.DataFrame({
        "doc_id": pd.array([None if i is None or i != i else int(i) for i, _ in rows], dtype="Int64"), "n_chars": [len(t) for t in own],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed],
        "fingerprint": [text_of(p) for p in prints[: len(own)]], "edited_fingerprint": [text_of(p) for p in other],
        "near_edited": [likeness(p, q) for p, q in zip(prints, other, strict=False)],
        "near_next": [likeness(prints[i], prints[i + 1]) for i in range(len(own))],
    })


def _with_next(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows (bucket, donor, doc_id, text) -> results; each document's successor
    is the next row of its bucket, the last one's the bucket's donor row."""
    held: tuple[int | None, str] | None = None
    bucket, closed = None, False
    for pdf in batches:
        rows, texts = ([held], [held[1]]) if held is not None else ([], [])
        for b, donor, i, t in zip(pdf["bucket"].tolist(), pdf["donor"].tolist(), pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
            text = t or ""
            if b != bucket:
                bucket, closed = b, False
            if closed:
                continue  # a bucket has a donor row for each row that shares the head's id
            if donor:
                closed = True
                if rows:
                    yield _emit(rows, [*texts, text])
                rows, texts = [], []
                continue
            if len(rows) >= 64 and sum(map(len, texts)) > 1 << 20:
                yield _emit(rows, [*texts, text])
                rows, texts = [], []
            rows.append((i, text))
            texts.append(text)
        if len(rows) > 1:
            yield _emit(rows[:-1], texts)
        held = rows[-1] if rows else None


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _cut_points(base: DataFrame, n: int) -> tuple[list[int], list[int], int]:
    """Ids that cut all rows into ``n`` parts, about, falling; how many parts each cut's own
    id fills (1, but for an id that a large share of the rows has); and those of null ids."""
    at, rows, none = base.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n), F.count("*"), F.count_if(F.col("doc_id").isNull())).head()
    cuts = sorted(set(at or []), reverse=True)
    fills = {c: 0 for c in cuts}
    for c in at or []:
        fills[c] += 1
    return cuts, [fills[c] for c in cuts], max(1, -(-none * n // max(1, rows)))


def _range_of(cuts: list[int], fills: list[int], none: int) -> Column:
    """The number of a row's range, in the order of ids (falling, null last) and, within one
    id, of the texts' hashes. A cut's own id comes first behind
    it: in as many ranges as it fills, and the ids up to the next cut in one more."""
    rising = np.array(cuts[::-1], dtype=np.int64)
    first = np.cumsum([1, *(f + 1 for f in fills)])  # of each cut's own id; ids above all cuts are in range 0

    @F.pandas_udf("int")
    def place(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        own = ids.to_numpy(np.int64)
        behind = len(rising) - np.searchsorted(rising, own, side="left")  # the cuts that aren't below an id
        at = np.maximum(behind, 1) - 1
        mine = (behind > 0) & (np.array(cuts, dtype=np.int64)[at] == own) if cuts else np.zeros(len(own), bool)
        many = np.array(fills or [1], dtype=np.int64)[at]
        part = (hashes.to_numpy(np.int64) % (1 << 32)) * many >> 32
        return pd.Series(np.where(behind == 0, 0, first[at] + np.where(mine, part, many)))

    known = place(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("hash"))
    last = F.floor(F.pmod("hash", F.lit(1 << 32)) * none / (1 << 32))
    return F.when(F.col("doc_id").isNull(), F.lit(int(first[-1])) + last).otherwise(known).cast("int")


def compare_with_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprint each text and its edited text, whose last floor(n/3) code points are
    replaced by the first as many of the next document by descending id (after the last
    the first): ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``, a row for each input row.

    Null texts are empty; null ids come last; rows that share an id follow each other by
    a hash of the text. A single document is its own successor. Texts of any length are read
    whole, and lines may repeat up to 2^31 times. Other columns are ignored; an empty table
    gives no rows.

    Ids are cut into ranges by quantiles of the ids alone (``buckets``, by default four a
    shuffle partition, and no fewer than one a RANGE_CHARS of text up to MOST_RANGES of them,
    so ranges grow only beyond 6.4 TB, where a task streams through more of them). An id that
    many rows share, or null, is as many ranges as it fills, by the texts' hashes. Texts are
    shuffled once, to their range, and neighbouring ranges to one partition, so that all
    partitions hold about as much. A range's last document needs the next range's first: those
    few rows are read twice.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", "text")
    partitions = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = buckets
    if not n:
        chars = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
        n = min(max(4 * partitions, chars // RANGE_CHARS), MOST_RANGES)
    bucket = _range_of(*_cut_points(base, n))
    keyed = base.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    # Order: ids fall (so their complements rise), null last, then the hash, which pmod makes rise with the range.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("fall"), F.pmod("hash", F.lit(1 << 32)).alias("low"), F.col("hash").alias("hash"))
    heads = keyed.select(bucket.alias("bucket"), order.alias("o")).groupBy("bucket").agg(F.min("o").alias("o"), F.count("*").alias("rows")).orderBy("bucket").collect()  # a row a range
    sum_of = max(1, sum(h["rows"] for h in heads))
    giver = spark.createDataFrame([(heads[i - 1]["bucket"], h["o"]["none"], ~h["o"]["fall"], h["o"]["hash"]) for i, h in enumerate(heads)], "bucket int, none boolean, head long, hash long")
    own = keyed.select(bucket.alias("bucket"), F.lit(False).alias("donor"), "doc_id", "text", "hash")
    same = (F.coalesce(keyed["doc_id"], F.lit(0)) == giver["head"]) & (keyed["doc_id"].isNull() == giver["none"]) & (keyed["hash"] == giver["hash"])
    donors = keyed.join(F.broadcast(giver), same).groupBy("bucket").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first(keyed["hash"]).alias("hash"))
    dealt = own.unionByName(donors.select("bucket", F.lit(True).alias("donor"), "doc_id", "text", "hash"))
    parts, before, places = max(partitions, n // 4), 0, []
    for h in heads:  # neighbouring ranges to a partition, by their rows
        places.append((h["bucket"], before * parts // sum_of))
        before += h["rows"]
    dealt = dealt.join(F.broadcast(spark.createDataFrame(places, "bucket int, task int")), "bucket").repartitionById(parts, "task")
    dealt = dealt.sortWithinPartitions("bucket", "donor", F.col("doc_id").desc_nulls_last(), F.pmod("hash", F.lit(1 << 32)), "hash")
    return dealt.select("bucket", "donor", "doc_id", "text").mapInPandas(_with_next, RESULT)
