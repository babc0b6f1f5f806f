"""Mixture-controlled packing by deficit round-robin over source queues.

A source's queue is its documents' token ids in table order. Each window (sequence)
takes from every queue, in source order, its quantum: the source's target share of the
window, rounded down, plus the deficit carried over from earlier windows. With
cumulative shares C the tokens served to source s in the first x tokens of all
sequences are floor(x * C[s]) - floor(x * C[s-1]): this is the round-robin with all
deficits carried, in closed form, so any executor can serve any document without the
state of earlier windows or partitions. Where explicit targets drain a queue, a new
phase begins with the queues that are left.

Sequences hold ``length`` tokens; what is left at the end fills sequences whose lengths
are powers of two, so nothing is padded.

One pass tokenizes and writes ids, a small aggregate places each (part, source), and a
second pass cuts the ids. Nothing is sorted; ids are shuffled only if the table of
(part, source) is too large to broadcast.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sized, small_batches, tidy
from .textkit import chunks, hashed_words, ranges

LENGTH, END_ID = 4096, 2
#: Bytes of ids that a worker keeps of the words it has met (about three times as many with
#: their index), and pieces that a task keeps, at most.
CACHE_BYTES, CACHE_PIECES = 12 << 20, 200_000
#: Bytes of text whose words are looked up together.
CHUNK_BYTES = 1 << 20

# Pieces that the tokenizer treats apart from each other whatever surrounds them:
# letters of these ranges, single digits, and other visible characters.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9.,!?;:()\"*#%&$@|/=+_-]+\Z").match
_PIECES = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9]+").findall
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z").match
#: Pieces of letters that the tokenizer gets in one text, parted by blanks.
TOGETHER = 32


# What a worker's earlier tasks have learned, by tokenizer: a few arrays.
_kept: dict[tuple[str, bool], tuple[np.ndarray, ...]] = {}


class WordTokenizer:
    """Token ids of texts, each distinct word of a chunk tokenized once.

    Only for tokenizers that drop the blanks 0x20 and 0x09-0x0D and never join across
    them: the ids of a text are those of its words in turn. Any other white space stays
    inside its word, which the tokenizer then sees whole. Texts that hold a special
    token's string go to the tokenizer whole, and so do words outside the plain
    characters. Plain words are lower-cased before they are looked up only if the
    tokenizer lower-cases itself.
    """

    def __init__(self, path: str, ordinary: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
        from tokenizers import Tokenizer

        self.name = (path, ordinary)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        self.special = [] if ordinary else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fold = str.lower if self._ids(["AZÀ"]) == self._ids(["azà"]) else str
        self.pieces: dict[str, list[int]] = {}
        self._forget()
        if self.name in _kept:
            self.hashes, self.at, self.size, self.ids = _kept[self.name]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letter_ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces of letters, which the tokenizer takes for one word each: its calls
        cost more than such short texts, so it gets some at once."""
        out: list[list[int]] = []
        groups = [pieces[a : a + TOGETHER] for a in range(0, len(pieces), TOGETHER)]
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            words = e.word_ids
            if None in words or sorted(set(words)) != list(range(len(group))):
                out += self._ids(group)  # another tokenizer's words aren't these
                continue
            cut: list[list[int]] = [[] for _ in group]
            for i, w in zip(e.ids, words, strict=True):
                cut[w].append(i)
            out += cut
        return out

    def _forget(self) -> None:
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Ids of words not met before; hashes: theirs, each once."""
        if self.ids.nbytes > CACHE_BYTES:
            self._forget()
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = {}
        parts = [(self.fold(w),) if _LETTERS(w) else _PIECES(self.fold(w)) if _PLAIN(w) else (w,) for w in words]
        known = self.pieces
        need = {p for ps in parts for p in ps if p not in known}
        letters = [p for p in need if _LETTERS(p)]
        known.update(zip(letters, self._letter_ids(letters), strict=True))
        others = [p for p in need if p not in known]
        known.update(zip(others, self._ids(others), strict=True))
        found = [known[ps[0]] if len(ps) == 1 else [i for p in ps for i in known[p]] for ps in parts]
        size = np.fromiter(map(len, found), np.int64, len(found))
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))])
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes, kind="stable")  # two sorted runs
        self.hashes, self.at, self.size = hashes[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [any(s in t for s in self.special) for t in texts]
        out: list[np.ndarray] = []
        raw = [b"" if w else t.encode("utf-8", "replace") for t, w in zip(texts, whole, strict=True)]
        for a, b in chunks(raw, CHUNK_BYTES):
            out += self._encode_chunk(raw[a:b])
        for i in np.flatnonzero(whole):
            out[i] = np.array(self._ids([texts[i]])[0], dtype=np.uint32)
        return out

    def _encode_chunk(self, texts: list[bytes]) -> list[np.ndarray]:
        buf, starts, ends, hashes, first = hashed_words(texts)
        if not len(hashes):
            return [np.zeros(0, np.uint32)] * len(texts)
        distinct, some, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        if new.any():
            data = buf.tobytes()
            if self.ids.nbytes > CACHE_BYTES:
                self._forget()
                new[:] = True
            self._learn(distinct[new], [data[starts[i] : ends[i]].decode("utf-8", "replace") for i in some[new]])
            at = np.searchsorted(self.hashes, distinct)
        sizes = self.size[at][inverse]
        flat = self.ids[ranges(self.at[at][inverse], sizes)]
        cuts = np.concatenate(([0], np.cumsum(sizes)))[first]
        return [flat[cuts[i] : cuts[i + 1]] for i in range(len(texts))]

    def keep(self) -> None:
        """Leave what was learned to the worker's next task."""
        _kept[self.name] = (self.hashes, self.at, self.size, self.ids)


def _tokenize(path: str, end_id: int, ordinary: bool):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, part, served = WordTokenizer(path, ordinary), TaskContext.get().partitionId(), {}
        end = np.array([end_id], dtype=np.uint32)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in chunks(texts, CHUNK_BYTES):
                ids = [np.concatenate([x, end]) for x in coder.encode(texts[a:b])]
                sources, before = pdf["key"].iloc[a:b].tolist(), []
                for key, x in zip(sources, ids, strict=True):
                    before.append(served.get(key, 0))
                    served[key] = before[-1] + len(x)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b].to_numpy(), "key": sources, "part": part, "before": before, "doc_tokens": [len(x) for x in ids], "ids": [_narrow(x) for x in ids]})
        coder.keep()

    return rows


def _narrow(ids: np.ndarray) -> bytes:
    """32-bit ids as 16-bit ones where they fit, with a mark of the width in front."""
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def _wide(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u2" if stored[:1] == b"\2" else "<u4", offset=1).astype("<u4")


class Plan:
    """Who is served where, from the sources' totals and targets.

    phases: (first token of the phase in all sequences, its tokens, for each source the
    tokens served before the phase and the cumulative tokens of the phase).
    """

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None, length: int) -> None:
        self.keys = sorted(totals)
        self.place = {k: i for i, k in enumerate(self.keys)}
        self.total = sum(totals.values())
        self.length, self.full = length, self.total // length
        self.ends, at = [], self.full * length
        for bit in reversed(range((self.total - at).bit_length())):
            if (self.total - at) >> bit & 1:
                at += 1 << bit
                self.ends.append(at)
        left, base, start = [totals[k] for k in self.keys], [0] * len(self.keys), 0
        self.phases: list[tuple[int, int, list[int], list[int]]] = []
        while any(left):
            share = left
            if targets and (live := [i for i, n in enumerate(left) if n and targets.get(self.keys[i], 0) > 0]):
                weight = [int(round(max(0.0, targets.get(k, 0)) * 1_000_000)) for k in self.keys]
                first = min(live, key=lambda i: left[i] / max(weight[i], 1))
                share = [min(n, left[first] * w // max(weight[first], 1)) if n else 0 for n, w in zip(left, weight, strict=True)]
                share[first] = left[first]
            cumulative = [0, *np.cumsum(np.array(share, dtype=object)).tolist()]
            self.phases.append((start, cumulative[-1], base, cumulative))
            start += cumulative[-1]
            base = [b + s for b, s in zip(base, share, strict=True)]
            left = [n - s for n, s in zip(left, share, strict=True)]
        self.starts = [p[0] for p in self.phases]

    def bounds(self, sequence: int) -> tuple[int, int]:
        """Where a sequence begins and ends in all sequences' tokens."""
        if sequence < self.full:
            return sequence * self.length, (sequence + 1) * self.length
        k = sequence - self.full
        return (self.ends[k - 1] if k else self.full * self.length), self.ends[k]

    def sequence_at(self, x: int) -> int:
        return x // self.length if x < self.full * self.length else self.full + bisect_right(self.ends, x)

    def served(self, s: int, x: int) -> int:
        """Tokens of source s within the first x tokens of all sequences."""
        start, tokens, base, c = self.phases[max(0, bisect_right(self.starts, x) - 1)]
        y = x - start
        return base[s] + y * c[s + 1] // tokens - y * c[s] // tokens

    def ahead(self, s: int, x0: int, x1: int) -> int:
        """Tokens of the sources before s between two places."""
        out = 0
        for x, sign in ((x1, 1), (x0, -1)):
            start, tokens, base, c = self.phases[max(0, bisect_right(self.starts, x) - 1)]
            out += sign * (sum(base[:s]) + (x - start) * c[s] // tokens)
        return out

    def place_of(self, s: int, token: int) -> int:
        """The sequence that serves the token-th token of source s, by bisection."""
        lo, hi = 0, self.full + len(self.ends) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if self.served(s, self.bounds(mid)[1]) > token:
                hi = mid
            else:
                lo = mid + 1
        return lo


def _cut(plan: Plan):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for doc_id, key, first, stored in zip(pdf["doc_id"], pdf["key"], pdf["first"], pdf["ids"], strict=True):
                ids, s = _wide(stored), plan.place[key]
                at, sequence = 0, plan.place_of(s, int(first))
                while at < len(ids):
                    x0, x1 = plan.bounds(sequence)
                    begun, ended = plan.served(s, x0), plan.served(s, x1)
                    n = min(len(ids) - at, ended - int(first) - at)
                    if n > 0:
                        out.append((doc_id, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), sequence, plan.ahead(s, x0, x1) + int(first) + at - begun))
                        at += n
                        sequence += 1
                    else:
                        sequence = plan.place_of(s, int(first) + at)
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return rows


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, length: int = LENGTH, targets: dict[str, float] | None = None, ordinary: bool = False) -> DataFrame:
    """Pack all documents into sequences of ``length`` tokens; a row for each piece:
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    targets: weights of the sources (by name; null is ``None``); by default each
    source's share of all tokens, so that every window holds the same mixture and all
    queues end together. ordinary: special tokens' strings count as ordinary text.

    A null text is empty and gives its end token only. A null source is a queue of its
    own. Rows with one id or text are packed each by itself; a null id stays null. Long
    texts are cut over as many sequences as they need. Other columns are ignored; an
    empty table gives no rows.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("~null"))
    schema = "doc_id long, key string, part int, before long, doc_tokens long, ids binary"
    coded = small_batches(docs).select("doc_id", "text", key.alias("key")).mapInPandas(tidy(_tokenize(tokenizer_path, end_id, ordinary)), schema)
    coded = materialize(coded, "pack-ids")
    parts = coded.groupBy("part", "key").agg(F.sum("doc_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = materialize(parts.withColumn("base", F.coalesce(before, F.lit(0))), "pack-parts")
    totals = dict(parts.groupBy("key").agg(F.sum("tokens").cast("long")).collect())  # a row a source
    named = {("~null" if k is None else f"s{k}"): w for k, w in targets.items()} if targets else None
    plan = Plan(totals, named, length)
    placed = coded.join(sized(parts.drop("tokens")), ["part", "key"])
    placed = placed.select("doc_id", "key", (F.col("base") + F.col("before")).alias("first"), "ids")
    return placed.mapInPandas(tidy(_cut(plan)), PIECES)
