"""Language-model scoring by online logistic context mixing.

A text is its words (lower-cased) and an end. A token is coded as bits. First come source
bits, one for each order: does the token follow the two words before it as it did in
training (order 3), if not the one before it (order 2), if not, is it a word of training
at all (order 1)? A yes at an order chooses the token by its share of what followed that
context, c(context, token) / c(context); an unknown word is spelled as bits.

Every source bit has several predictors, each of which looks up what training saw in a
context: counts of the hashed word contexts in classes, the length of the run that was
predicted so far, the sources of the two tokens before, and the text's own history. Their
log-odds are combined by weights that a gate (the run) selects; to these a text adds its
own, which move by the gradient of the coding cost after every BLOCK tokens, from a text's
begin to its end, however long it is. A bit's probability weighs its order against all
lower ones together, so a token's probability is the sum over its sources and those of
all known tokens and of spelling add up to 1.

Spelling: each byte of a word and a terminator are the bits of a Huffman code, predicted
by the log-odds that hashed contexts (two, three or five bytes, the word so far) gave at
that node of the code, combined by gated weights. It is trained on the words that training
saw once: these are what unknown words look like. What words of a unit begin alike with is
looked up once and counts as often as words begin so.

All counts of words, pairs and triples grow with the corpus; those of words are exact, pairs
and triples are told apart by hashes (HASH_BYTES). They are held nowhere whole: texts are bundled into units of a few MB; a unit sends the hashes of its
distinct words, pairs and triples, each once with its count, to the hash range (bucket) they
belong to; a bucket adds up and answers every unit that asked, in the order asked. Units
and buckets both number in proportion to the input, each of a fixed size. Only sums of a
fixed size reach the driver: counts by class of the source bits' contexts, the tables of
the byte contexts, sums for the weights.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, tidy
from .textkit import CHUNK, _powers, chunks, hashed_words, lowered, mix, ranges, span_hashes

ORDERS = (2, 3, 5, 0)  # preceding bytes; 0: the whole word so far
SLOT_BITS = 19  # of each byte predictor's table
SLOT_BLOCK = 1 << 14  # slots in a row of a partial table
#: Bytes of text in a unit and, about, behind a bucket; bytes of a hash within its bucket,
#: of words (whose counts have to be exact) and of pairs and triples. A bucket holds two
#: million of these at most, so about one unseen pair in 2,000 is taken for a seen one.
UNIT_BYTES, BUCKET_BYTES, HASH_BYTES = 4 << 20, 8 << 20, (5, 4)
#: Tokens between two moves of a text's weights, the moves' rate, the weights' bound.
BLOCK, RATE, BOUND = 32, 0.004, 2.0
#: Tokens of a unit that are taken up at once; bits that are summed up at once.
SLICE, BITS = 1 << 17, 1 << 15
#: What is added to the counts of zeros and ones; from how many sights on a byte context's
#: evidence is of the next class; Newton steps of the spelling weights.
PRIOR, EVIDENCE, NEWTON = 0.4, (1, 2, 3, 5, 10, 30, 100, 1000), 3
END = b"\n"  # can't be a word
SPACE = 0x20

_N, _SLOTS, _CLASSES = len(ORDERS), 1 << SLOT_BITS, len(EVIDENCE) + 1
_GATES = 2 * _CLASSES * _CLASSES
_START = np.uint64(0x5851F42D4C957F2D)
_END_HASH = span_hashes(np.frombuffer(END, np.uint8), np.array([0]), np.array([1]))[0]
#: Orders, small contexts of each, inputs (those, the text's history, a constant), run classes.
_BITS, _SMALL, _INPUTS, _RUNS = 3, 256, 5, 8


# Units: texts bundled, as hashes of words.


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _planes(a: np.ndarray) -> bytes:
    """Non-negative integers by byte, the lowest first, as many as the largest needs."""
    width = max(1, -(-int(a.max(initial=0)).bit_length() // 8))
    flat = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + _packed(np.ascontiguousarray(flat.T).tobytes())


def _whole(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpacked(data[1:]), np.uint8).reshape(data[0], -1)
    out = planes[-1].astype(np.int64)
    for plane in planes[-2::-1]:
        out <<= 8
        out |= plane
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unsigned 64-bit keys: the distinct ones, ascending, where each is first, and for each
    key its place among them. Sorts numbers that hold a key's upper bits and where it was;
    only if keys differ in the bits that don't fit are they sorted again."""
    n = len(keys)
    shift = np.uint64(n.bit_length())
    spare = np.uint64(max(0, int(keys.max(initial=0)).bit_length() + int(shift) - 64))
    both = ((keys >> spare) << shift) | np.arange(n, dtype=np.uint64)
    both.sort()
    order = (both & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    ascending = keys[order]
    if spare and (ascending[1:] < ascending[:-1]).any():
        again = np.argsort(ascending, kind="stable")
        order, ascending = order[again], ascending[again]
    head = np.ones(n, dtype=bool)
    np.not_equal(ascending[1:], ascending[:-1], out=head[1:])
    place = np.empty(n, dtype=np.int64)
    place[order] = np.cumsum(head) - 1
    return ascending[head], order[head], place


UNIT = "unit long, doc_ids array<long>, learn array<boolean>, held array<boolean>, sizes array<int>, bytes array<int>, tokens binary, words binary"


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts -> a row for each unit: its documents, its distinct words, the tokens as
    numbers of words. Word 0 is the end."""
    number = TaskContext.get().partitionId() << 32

    def unit(rows: list[tuple], texts: list[bytes]) -> pd.DataFrame:
        nonlocal number
        hashes, sizes, spans = [np.array([_END_HASH])], [], [END]
        pieces: list[tuple[bytes, np.ndarray, np.ndarray]] = []
        for a, b in chunks(texts):
            buf, starts, ends, h, first = hashed_words(texts[a:b])
            hashes.append(h)
            sizes += np.diff(first).tolist()
            pieces.append((buf.tobytes(), starts, ends))
        every = np.concatenate(hashes)
        _, some, inverse = distinct(every)
        new = np.zeros(len(every), dtype=bool)
        new[some] = True
        at = (np.cumsum(new) - 1)[some]  # numbers go by where words are first, the end before all
        offset = 1
        for data, starts, ends in pieces:
            own = new[offset : offset + len(starts)]
            spans += [data[i:j] for i, j in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
            offset += len(starts)
        tokens = np.zeros(len(every) - 1 + len(texts), dtype=np.int64)
        n = np.array(sizes, dtype=np.int64)
        tokens[ranges(np.cumsum(n + 1) - n - 1, n)] = at[inverse[1:]]
        ids = [None if r[0] is None or r[0] != r[0] else int(r[0]) for r in rows]
        frame = pd.DataFrame({
            "unit": [number], "doc_ids": [ids], "learn": [[bool(r[1]) for r in rows]], "held": [[bool(r[2]) for r in rows]], "sizes": [(n + 1).tolist()],
            "bytes": [[len(t) for t in texts]], "tokens": [_planes(tokens)], "words": [_packed(b" ".join(spans[1:]))],
        })
        number += 1
        return frame

    rows: list[tuple] = []
    texts: list[bytes] = []
    size = 0
    for pdf in batches:
        for row in zip(pdf["doc_id"].tolist(), pdf["learn"].tolist(), pdf["held_out"].tolist(), pdf["text"].tolist(), strict=True):
            text = lowered(row[3])
            if rows and size + len(text) > UNIT_BYTES:
                yield unit(rows, texts)
                rows, texts, size = [], [], 0
            rows.append(row[:3])
            texts.append(text)
            size += len(text) + 1
    if rows:
        yield unit(rows, texts)


@dataclass
class Unit:
    """A unit taken apart: words, tokens, each document's first token, and for every
    token the keys of its word, its pair and its triple (none for a first token)."""

    words: bytes  # all but the end, a blank between two
    starts: np.ndarray
    ends: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    learn: np.ndarray  # by token

    @classmethod
    def of(cls, tokens: bytes, words: bytes, sizes: list[int], learn: list[bool]) -> Unit:
        n, words = np.asarray(sizes, dtype=np.int64), _unpacked(words)
        blanks = np.flatnonzero(np.frombuffer(words + b" " if words else b"", np.uint8) == SPACE)
        starts = np.concatenate(([0], blanks[:-1] + 1))[: len(blanks)]
        return cls(words, starts, blanks, _whole(tokens), n, np.cumsum(n) - n, np.repeat(np.asarray(learn, dtype=bool), n))

    def spans(self, numbers: np.ndarray) -> list[bytes]:
        """The words of these numbers."""
        own = np.maximum(numbers - 1, 0)
        some = zip(numbers.tolist(), self.starts[own].tolist(), self.ends[own].tolist(), strict=True) if len(self.starts) else ((i, 0, 0) for i in numbers.tolist())
        return [self.words[i:j] if k else END for k, i, j in some]

    def keys(self) -> np.ndarray:
        """Three rows by token: hashes of the word, the pair, the triple."""
        h = np.concatenate(([_END_HASH], word_hashes(self.words, self.starts, self.ends)))[self.tokens]
        before = np.concatenate(([_START], h[:-1]))
        before[self.first] = _START
        second = np.concatenate(([_START], before[:-1]))
        second[self.first] = _START
        pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + h)
        triple = mix(second * np.uint64(0xD6E8FEB86659FD93) + pair)
        return np.stack([mix(h), pair, triple])

    def asked(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words, then pairs and triples, as (bucket, hash within it) in one
        number each, ascending; where the words end; and for each key its place."""
        keys = self.keys()
        words, _, at = distinct(keys[0] >> np.uint64(64 - bits - 8 * HASH_BYTES[0]))
        rest, _, place = distinct(keys[1:].reshape(-1) >> np.uint64(64 - bits - 8 * HASH_BYTES[1]))
        return words, rest, np.concatenate([at, place + len(words)])


def word_hashes(words: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans one after the other, about CHUNK bytes of them at once."""
    buf, out = np.frombuffer(words, dtype=np.uint8), [np.zeros(0, np.uint64)]
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(buf), CHUNK)), len(starts)))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        begin, end = starts[a], ends[b - 1]
        out.append(span_hashes(buf[begin:end], starts[a:b] - begin, ends[a:b] - begin))
    return np.concatenate(out)


def _narrow(a: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs: 1, 2, 4 or 8."""
    most = int(a.max(initial=0))
    return a.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


ASKED = "bucket int, kind int, unit long, n int, keys binary, counts binary"


def _ask(bits: int):
    """Units -> for each bucket that they need: the keys, ascending, and their counts in
    the unit's learnable documents."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number, tokens, words, sizes, learn in zip(pdf["unit"], pdf["tokens"], pdf["words"], pdf["sizes"], pdf["learn"], strict=True):
                unit = Unit.of(tokens, words, sizes, learn)
                own, rest, place = unit.asked(bits)
                counts = np.bincount(place[np.tile(unit.learn, 3)], minlength=len(own) + len(rest))
                for kind, keys, c in ((0, own, counts[: len(own)]), (1, rest, counts[len(own) :])):
                    bucket = (keys >> np.uint64(8 * HASH_BYTES[kind])).astype(np.int64)
                    low = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : HASH_BYTES[kind]])
                    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
                    ends = np.append(heads[1:], len(keys))
                    for k in range(0, len(heads), 512):
                        some = range(k, min(k + 512, len(heads)))
                        yield pd.DataFrame({
                            "bucket": bucket[heads[some]], "kind": kind, "unit": number, "n": ends[some] - heads[some],
                            "keys": [low[heads[i] : ends[i]].tobytes() for i in some], "counts": [_narrow(c[heads[i] : ends[i]]) for i in some],
                        })

    return rows


def _answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket and kind -> each unit's totals, in the order it asked; and a
    row of unit -1 with a bucket's distinct learned words and their tokens."""

    def answers(held: list[tuple]) -> pd.DataFrame:
        sizes = np.array([r[3] for r in held], dtype=np.int64)
        low = np.zeros((int(sizes.sum()), 8), dtype=np.uint8)
        width = HASH_BYTES[held[0][1]]
        low[:, :width] = np.frombuffer(b"".join([r[4] for r in held]), np.uint8).reshape(-1, width)
        _, _, place = distinct(low.view("<u8").reshape(-1).astype(np.uint64, copy=False))
        counts = np.concatenate([_wide(r[5], r[3]) for r in held])
        totals = np.bincount(place, weights=counts).astype(np.int64)
        back = totals[place]
        cuts = np.cumsum(sizes)[:-1]
        out = [(r[2], r[0], r[1], r[3], _narrow(x), 0, 0) for r, x in zip(held, np.split(back, cuts), strict=True)]
        if held[0][1] == 0:
            out.append((-1, held[0][0], 0, 0, b"", int((totals > 0).sum()), int(totals.sum())))
        return pd.DataFrame(out, columns=["unit", "bucket", "kind", "n", "totals", "distinct", "tokens"])

    held: list[tuple] = []
    for pdf in batches:
        for row in pdf[["bucket", "kind", "unit", "n", "keys", "counts"]].itertuples(index=False, name=None):
            if held and held[0][:2] != row[:2]:
                yield answers(held)
                held = []
            held.append(row)
    if held:
        yield answers(held)


# What is known of a unit's tokens.


COUNTED = "unit long, doc_ids array<long>, learn array<boolean>, held array<boolean>, sizes array<int>, bytes array<int>, c1 binary, c2 binary, c3 binary, new_at binary, new_words binary, once binary, small binary"


def _count_tokens(bits: int, tokens: int, texts: int):
    """A unit's row and its answers -> counts by token of the word, pair and triple; the
    unknown words with the tokens that are they; the words that training saw once; and
    how often the source bits' small contexts saw a 0 and a 1."""

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["tokens"].notna()].iloc[0]
        unit = Unit.of(own["tokens"], own["words"], own["sizes"], own["learn"])
        _, _, place = unit.asked(bits)
        told = pdf[pdf["tokens"].isna()].sort_values(["kind", "bucket"])
        totals = np.concatenate([_wide(t, int(n)) for t, n in zip(told["totals"], told["n"], strict=True)])
        c1, c2, c3 = totals[place].reshape(3, -1)
        new = np.flatnonzero(c1 == 0)
        kinds, which = np.unique(unit.tokens[new], return_inverse=True)
        once = sorted(w for w in unit.spans(unit.tokens[(c1 == 1) & unit.learn]) if w != END)
        small = np.zeros((_BITS, 3, _SMALL, 2))
        for a, b, sources in sliced(c1, c2, c3, unit.sizes, tokens, texts, True):
            small += sources.counts(unit.learn[a:b])
        return pd.DataFrame({
            "unit": [own["unit"]], "doc_ids": [own["doc_ids"]], "learn": [own["learn"]], "held": [own["held"]], "sizes": [own["sizes"]], "bytes": [own["bytes"]],
            "c1": [_planes(c1)], "c2": [_planes(c2)], "c3": [_planes(c3)], "new_at": [_planes(np.concatenate([new, which]))],
            "new_words": [b" ".join(unit.spans(kinds))], "once": [b" ".join(once)],
            "small": [_planes(small.reshape(-1))],
        })

    return rows


def _level(n: np.ndarray) -> np.ndarray:
    """0, then a class for each binary digit, 15 at most."""
    return np.minimum(np.frexp(np.maximum(n, 0).astype(np.float64))[1], 15).astype(np.intp)


class Sources:
    """The source bits of tokens: for orders 3, 2 and 1, whether there is a bit, its value,
    the share of the token, the inputs' small contexts, and the gate.

    less: leave each token itself out of the counts, as for learning from what was counted.
    Counts are by token: of its word, its pair, its triple.
    """

    def __init__(self, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, sizes: np.ndarray, tokens: int, texts: int, less: bool) -> None:
        n, first = len(c1), np.cumsum(sizes) - sizes
        begin = np.repeat(first, sizes)
        index = np.arange(n)
        head = index == begin
        t2 = np.where(head, texts, np.concatenate(([0], c1[:-1])))
        t3 = np.where(head, 0, np.concatenate(([0], c2[:-1])))
        one = int(less)
        seen = [np.maximum(c - one, 0) for c in (np.where(head, 0, c3), c2, c1)]
        total = [np.maximum(t - one, 0) for t in (t3, t2, np.full(n, tokens))]
        hit = [(s > 0) & (t > 0) for s, t in zip(seen, total, strict=True)]
        self.first, self.sizes, self.begin = first, sizes, begin
        self.seen, self.total = seen, total
        self.value = np.stack(hit)
        open_ = [total[0] > 0, (total[1] > 0) & ~hit[0], (total[2] > 0) & ~hit[0] & ~hit[1]]
        self.coded = np.stack(open_)  # bits that a text's learning goes by
        self.there = np.stack([t > 0 for t in total])
        status = np.where(hit[0], 3, np.where(hit[1], 2, np.where(hit[2], 1, 0)))
        s1 = np.where(head, 0, np.concatenate(([0], status[:-1])))
        s2 = np.where(index - begin < 2, 0, np.concatenate(([0, 0], status[:-2]))[:n])
        broken = np.maximum.accumulate(np.where(status != 3, index, -1))
        run = index - 1 - np.maximum(np.concatenate(([-1], broken[:-1])), begin - 1)
        self.gate = np.minimum(_level(run), _RUNS - 1)
        l3, l2 = _level(total[0]), _level(total[1])
        self.small = np.stack([l3 * _RUNS + self.gate, l3 * 16 + l2, (s1 * 4 + s2) * 16 + l2])

    @cached_property
    def share(self) -> np.ndarray:
        return np.stack([s / np.maximum(t, 1) for s, t in zip(self.seen, self.total, strict=True)])

    @cached_property
    def history(self) -> np.ndarray:
        out = []
        for bit in range(_BITS):
            past = []
            for x in (self.coded[bit] & self.value[bit], self.coded[bit] & ~self.value[bit]):
                up = np.concatenate(([0], np.cumsum(x)))
                past.append(up[:-1] - up[self.begin])
            out.append(np.log((past[0] + 0.5) / (past[1] + 0.5)))
        return np.stack(out).astype(np.float32)

    def counts(self, where: np.ndarray) -> np.ndarray:
        """How often each small context's bit was 0 and 1, over the tokens ``where``."""
        out = np.zeros((_BITS, 3, _SMALL, 2))
        for bit in range(_BITS):
            some = np.flatnonzero(self.coded[bit] & where)
            value = self.value[bit].take(some)
            for i in range(3):
                out[bit, i] = np.bincount(2 * self.small[i].take(some) + value, minlength=2 * _SMALL).reshape(-1, 2)
        return out

    def inputs(self, tables: np.ndarray, bit: int, some: np.ndarray | None = None) -> np.ndarray:
        """Tokens by inputs, of all tokens or of some. tables: log-odds by bit and small context."""
        if some is None:
            some = np.arange(len(self.gate))
        x = np.ones((_INPUTS, len(some)), dtype=np.float32)
        for i in range(3):
            x[i] = tables[bit, i].take(self.small[i].take(some))
        x[3] = self.history[bit].take(some)
        return x.T


def sliced(c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, sizes: np.ndarray, tokens: int, texts: int, less: bool) -> Iterator[tuple[int, int, Sources]]:
    """Some documents of a unit after the other, about SLICE tokens at once: their first
    token, the token behind their last, and their source bits."""
    ends = np.cumsum(sizes)
    doc = 0
    while doc < len(sizes):
        a = int(ends[doc] - sizes[doc])
        last = max(doc + 1, int(np.searchsorted(ends, a + SLICE, side="right")))
        b = int(ends[last - 1])
        yield a, b, Sources(c1[a:b], c2[a:b], c3[a:b], sizes[doc:last], tokens, texts, less)
        doc = last


def start_weights() -> np.ndarray:
    """Of each bit and gate, before they are fitted: the predictors' mean."""
    return np.tile(np.array([0.3, 0.3, 0.3, 0.1, 0.0]), (_BITS, _RUNS, 1))


def source_chances(sources: Sources, tables: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each bit's probability of a yes, by order and token (0 where there is no bit). A
    text's own weights start at 0 and move after every BLOCK tokens."""
    order = np.argsort(-sources.sizes, kind="stable")
    sizes = sources.sizes[order]
    # tokens block by block, in each the texts that reach it, the longest first
    lane = np.empty(len(order), dtype=np.int64)
    lane[order] = np.arange(len(order))
    blocks = -(-sources.sizes // BLOCK)
    done = ranges(np.zeros(len(blocks), dtype=np.int64), blocks)
    turn = np.argsort(done * len(order) + np.repeat(lane, blocks))
    begins = (np.repeat(sources.first, blocks) + done * BLOCK)[turn]
    at = ranges(begins, np.minimum(np.repeat(sources.sizes, blocks) - done * BLOCK, BLOCK)[turn])
    x = np.empty((len(at), _BITS, _INPUTS), dtype=np.float32)
    base = np.zeros((len(at), _BITS), dtype=np.float32)
    gate = sources.gate.take(at)
    for bit in range(_BITS):
        columns, own_weights = sources.inputs(tables, bit, at).T, weights[bit].T.astype(np.float32)
        for i in range(_INPUTS):
            x[:, bit, i] = columns[i]
            base[:, bit] += columns[i] * own_weights[i].take(gate)
    coded, value = sources.coded.T[at].astype(np.float32), sources.value.T[at].astype(np.float32)
    mixed_in = np.empty(base.shape, dtype=np.float32)
    own = np.zeros((len(sizes), _BITS, _INPUTS), dtype=np.float32)
    a = 0
    for done in range(0, int(sizes[0]) if len(sizes) else 0, BLOCK):
        live = int(np.searchsorted(-sizes, -done, side="left"))
        n = np.minimum(sizes[:live] - done, BLOCK)
        b = a + int(n.sum())
        xs = x[a:b]
        mixed = np.clip(base[a:b] + np.einsum("ijk,ijk->ij", xs, np.repeat(own[:live], n, axis=0)), -12, 12)
        mixed_in[a:b] = p = 1 / (1 + np.exp(-mixed))
        miss = coded[a:b] * (value[a:b] - p)
        own[:live] = np.clip(own[:live] + RATE * np.add.reduceat(xs * miss[:, :, None], np.cumsum(n) - n, axis=0), -BOUND, BOUND)
        a = b
    chances = np.zeros(sources.share.shape)
    chances[:, at] = mixed_in.T
    return np.where(sources.there, chances, 0.0)


def token_logs(sources: Sources, chances: np.ndarray, spelling: np.ndarray) -> np.ndarray:
    """log10 of each token's probability. spelling: log10 of an unknown word's spelling,
    0 (not used) for known ones."""
    (p3, p2, p1), (q3, q2, q1) = chances, sources.share
    known = p3 * q3 + (1 - p3) * (p2 * q2 + (1 - p2) * p1 * q1)
    new = ~sources.value.any(axis=0)
    out = np.log10(np.maximum(known, 1e-300))
    out[new] = (np.log1p(-p3[new]) + np.log1p(-p2[new]) + np.log1p(-p1[new])) / np.log(10) + spelling[new]
    return out


# Spelling.


class Code:
    """A Huffman code of the 256 bytes; every byte counts once more than it was seen.
    nodes and bits hold each byte's path, padded to the longest."""

    def __init__(self, counts: np.ndarray) -> None:
        heap: list[tuple[int, int, object]] = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        at = 256
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a + b, at, (at - 256, x, y)))
            at += 1
        paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        stack: list[tuple[object, list[tuple[int, int]]]] = [(heap[0][2], [])]
        while stack:
            tree, path = stack.pop()
            if isinstance(tree, tuple):
                stack += [(tree[1], [*path, (tree[0], 0)]), (tree[2], [*path, (tree[0], 1)])]
            else:
                paths[tree] = path
        self.sizes = np.array([len(p) for p in paths])
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        flat = [x for p in paths for x in p]
        self.nodes = np.array([n for n, _ in flat], dtype=np.uint32)
        self.bits = np.array([b for _, b in flat], dtype=np.uint8)


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words one after the other: bytes, sizes, each byte's place in its word, and the hash of
    what is before it, for every predictor. The end is its one byte, without a terminator."""
    buf = np.frombuffer(b"".join([w if w == END else w + b" " for w in words]), dtype=np.uint8)
    sizes = np.array([1 if w == END else len(w) + 1 for w in words], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(buf)) - np.repeat(starts, sizes)
    contexts = np.zeros((_N, len(buf)), dtype=np.uint32)
    older = np.concatenate((np.zeros(5, np.uint32), buf.astype(np.uint32)))
    for k in range(1, 6):
        at = np.where(place >= k, older[5 - k : 5 - k + len(buf)], np.where(place == k - 1, np.uint32(SPACE), np.uint32(0)))
        for i, order in enumerate(ORDERS):
            if order >= k:
                contexts[i] = (contexts[i] + at + np.uint32(1)) * np.uint32(0x2C1B3C6D)
                contexts[i] ^= contexts[i] >> np.uint32(15)
    if 0 in ORDERS:  # the polynomial prefix of the word, by differences of running products
        up, down = _powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], dtype=np.uint64, out=sums[1:])
        begin = np.repeat(starts, sizes)
        contexts[ORDERS.index(0)] = (mix((sums[:-1] - sums[begin]) * down[begin] + place.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return buf, sizes, place, contexts


def _bits_of(buf: np.ndarray, contexts: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of each byte, the bits, and each bit's slot in every predictor's table (predictors
    by bits)."""
    lengths = code.sizes[buf]
    where = ranges(code.first[buf], lengths)
    node = code.nodes.take(where) * np.uint32(0x9E3779B1)
    slots = np.empty((_N, len(where)), dtype=np.int32)
    for i in range(_N):
        h = (np.repeat(contexts[i], lengths) + node) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        slots[i] = (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - SLOT_BITS)
    return lengths, code.bits.take(where), slots


def spelled(words: list[bytes], code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words one after the other: bits of each word, the bits, and their slots."""
    buf, sizes, _, contexts = _letters(words)
    lengths, bits, slots = _bits_of(buf, contexts, code)
    return np.add.reduceat(lengths, np.cumsum(sizes) - sizes), bits, slots


def spelled_alike(words: list[bytes], code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bits of words and their slots, those that a word and the one before it begin alike with
    once, and how many words each stands for: the same bits in the same contexts. The words
    may come in any order; sorted, half the bytes go."""
    buf, sizes, place, contexts = _letters(words)
    starts = np.cumsum(sizes) - sizes
    back = np.repeat(np.concatenate((np.zeros(1, dtype=np.int64), sizes[:-1])), sizes)
    alike = (place < back) & (buf[np.arange(len(buf)) - back] == buf)
    until = np.minimum.reduceat(np.where(alike, len(buf), place), starts)
    new = place >= np.repeat(until, sizes)
    # by place, then word: those that a byte stands for follow it
    order = np.argsort(place.astype(np.uint16) if place.max() < 1 << 16 else place, kind="stable")
    heads = np.flatnonzero(new[order])
    some, times = order[heads], np.diff(np.append(heads, len(buf)))
    lengths, bits, slots = _bits_of(buf[some], contexts[:, some], code)
    return bits, slots, np.repeat(times, lengths)


def _byte_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(256, dtype=np.int64)
    for pdf in batches:
        for once in pdf["once"]:
            total += np.bincount(np.frombuffer(once + b" " if once else b"", np.uint8), minlength=256)
    yield pd.DataFrame({"byte": np.arange(256, dtype=np.int32), "n": total})


def _context_counts(code: Code):
    """Zeros and ones by slot of every byte predictor, over all words seen once."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = np.zeros((2, _N, _SLOTS), dtype=np.uint32)
        for pdf in batches:
            for once in pdf["once"]:
                words = once.split(b" ") if once else []
                for a in range(0, len(words), 10_000):
                    bits, slots, times = spelled_alike(words[a : a + 10_000], code)
                    times = times.astype(np.uint32)
                    for bit in (0, 1):
                        some = np.flatnonzero(bits == bit)
                        for i in range(_N):
                            np.add.at(tables[bit, i], slots[i].take(some), times.take(some))
        flat = tables.reshape(-1, SLOT_BLOCK)
        some = np.flatnonzero(flat.any(axis=1))
        for k in range(0, len(some), 32):
            yield pd.DataFrame({"block": some[k : k + 32].astype(np.int32), "sums": [_planes(flat[i]) for i in some[k : k + 32]]})

    return rows


def _add_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums by block, as 32-bit floats: a slot's log-odds need no more digits."""
    sums: dict[int, np.ndarray] = {}
    for pdf in batches:
        for block, data in zip(pdf["block"], pdf["sums"], strict=True):
            sums[block] = sums.get(block, 0) + _whole(data)
    yield pd.DataFrame({"block": np.array(list(sums), dtype=np.int32), "sums": [v.astype("<f4").tobytes() for v in sums.values()]})


def alone_odds(tables: np.ndarray) -> np.ndarray:
    """By predictor and class: the log-odds that a context which saw one value alone sees it
    again, over every bit of every word in the tables, each less its own sight."""
    out = np.zeros((_N, 2 * _CLASSES))
    for i in range(_N):
        for bit in (0, 1):
            own, other = tables[bit, i].astype(np.float64), tables[1 - bit, i].astype(np.float64)
            left = np.maximum(own - 1, 0)
            single = (own > 0) & ((left > 0) != (other > 0))
            level = np.searchsorted(EVIDENCE, (left + other)[single], side="right")
            out[i] += np.bincount(2 * level + (left[single] > 0), weights=own[single], minlength=2 * _CLASSES)
    return np.log((out[:, 1::2] + 0.5) / (out[:, ::2] + 0.5)).astype(np.float32)


class Looks:
    """What a spelling's look-ups give, by slot: every predictor's log-odds of a 1 and the part
    of the gate that the last two make up. less: a layer for each value of the bit, without one
    sight of it; else one layer."""

    def __init__(self, tables: np.ndarray, alone: np.ndarray, less: bool) -> None:
        layers = 1 + less
        self.odds = np.empty((_N, layers * _SLOTS), dtype=np.float32)
        self.parts = np.empty((2, layers * _SLOTS), dtype=np.uint8)
        for i in range(_N):
            for bit in range(layers):
                zeros, ones = tables[:, i]
                if less:
                    zeros, ones = np.maximum(zeros - (1 - bit), 0), np.maximum(ones - bit, 0)
                level = np.searchsorted(EVIDENCE, zeros + ones, side="right")
                both, sure = (zeros > 0) & (ones > 0), alone[i][level]
                some = slice(bit * _SLOTS, (bit + 1) * _SLOTS)
                self.odds[i, some] = np.where(both, np.log((ones + PRIOR) / (zeros + PRIOR)), np.where(level == 0, 0, np.where(ones > 0, sure, -sure)))
                if i >= _N - 2:
                    self.parts[i - _N, some] = level + _CLASSES * both

    def mixed(self, bits: np.ndarray, slots: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of bits: inputs, gates, and the combined log-odds of a 1."""
        if self.odds.shape[1] > _SLOTS:
            slots = slots + bits.astype(np.int32) * np.int32(_SLOTS)
        gate = self.parts[1].take(slots[-1]).astype(np.intp) * _CLASSES + self.parts[0].take(slots[-2]) % _CLASSES
        x = np.empty((_N, len(bits)), dtype=np.float32)
        mixed = np.zeros(len(bits), dtype=np.float32)
        for i, column in enumerate(weights.T.astype(np.float32)):
            x[i] = self.odds[i].take(slots[i])
            mixed += x[i] * column.take(gate)
        return x.T, gate, np.clip(mixed, -25, 25)


class Speller:
    """Gated mixing of what hashed byte contexts saw."""

    def __init__(self, code: Code, looks: Looks, weights: np.ndarray) -> None:
        self.code, self.looks, self.weights = code, looks, weights

    def logs(self, words: list[bytes]) -> np.ndarray:
        """log10 of the probability of each word's spelling."""
        out = [np.zeros(0)]
        for a in range(0, len(words), 4_000):
            sizes, bits, slots = spelled(words[a : a + 4_000], self.code)
            _, _, mixed = self.looks.mixed(bits, slots, self.weights)
            cost = np.log1p(np.exp(np.where(bits, -mixed, mixed)))
            out.append(-np.add.reduceat(cost, np.cumsum(sizes) - sizes) / np.log(10))
        return np.concatenate(out)


def start_spelling() -> np.ndarray:
    """By gate, before they are fitted: the whole word counts most."""
    weights = np.full((_GATES, _N), 0.1, dtype=np.float32)
    weights[:, -1] = 0.6
    return weights


def newton_sums(x: np.ndarray, y: np.ndarray, mixed: np.ndarray, gate: np.ndarray, gates: int, times: np.ndarray | None = None) -> np.ndarray:
    """By gate: gradient and curvature of the cost of bits y whose log-odds are mixed, each
    counted ``times`` (once, if not given)."""
    n = x.shape[1]
    sums = np.zeros((gates, n * (n + 1)))
    for a in range(0, len(y), BITS):  # what the caches hold
        some = slice(a, a + BITS)
        p = 1 / (1 + np.exp(-mixed[some].astype(np.float64)))
        miss, sure, own = y[some] - p, p * (1 - p), gate[some].astype(np.intp, copy=False)
        if times is not None:
            miss, sure = miss * times[some], sure * times[some]
        columns = [x[some, i].astype(np.float64) for i in range(n)]
        for i, column in enumerate(columns):
            sums[:, i] += np.bincount(own, weights=miss * column, minlength=gates)
            part = sure * column
            for j in range(i, n):
                sums[:, n + i * n + j] += np.bincount(own, weights=part * columns[j], minlength=gates)
    for i in range(n):
        for j in range(i):
            sums[:, n + i * n + j] = sums[:, n + j * n + i]
    return sums


def newton_step(sums: np.ndarray, n: int) -> np.ndarray:
    steps = np.zeros((len(sums), n))
    for g, s in enumerate(sums):
        curvature = s[n:].reshape(n, n)
        steps[g] = np.clip(np.linalg.solve(curvature + (0.01 * np.trace(curvature) / n + 1.0) * np.eye(n), s[:n]), -0.5, 0.5)
    return steps


# Learning, and scoring.


def _counts_of(row: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts by token of word, pair and triple; the documents' sizes."""
    return _whole(row["c1"]), _whole(row["c2"]), _whole(row["c3"]), np.asarray(row["sizes"], dtype=np.int64)


def _small_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(_BITS * 3 * _SMALL * 2)
    for pdf in batches:
        for small in pdf["small"]:
            total += _whole(small)
    yield _numbered(total)


def _weight_sums(tokens: int, texts: int, tables: np.ndarray, weights: np.ndarray):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((_BITS, _RUNS, _INPUTS * (_INPUTS + 1)))
        for pdf in batches:
            for _, row in pdf.iterrows():
                learn = np.repeat(np.asarray(row["learn"], dtype=bool), np.asarray(row["sizes"], dtype=np.int64))
                for a, b, sources in sliced(*_counts_of(row), tokens, texts, True):
                    for bit in range(_BITS):
                        some = np.flatnonzero(sources.coded[bit] & learn[a:b])
                        x, gate = sources.inputs(tables, bit, some), sources.gate[some]
                        mixed = np.zeros(len(some))
                        for i, column in enumerate(weights[bit].T):
                            mixed += x[:, i] * column.take(gate)
                        mixed = np.clip(mixed, -12, 12)
                        total[bit] += newton_sums(x, sources.value[bit][some], mixed, gate, _RUNS)
        yield _numbered(total)

    return rows


def _numbered(sums: np.ndarray) -> pd.DataFrame:
    some = np.flatnonzero(sums.reshape(-1))
    return pd.DataFrame({"i": some.astype(np.int32), "v": sums.reshape(-1)[some]})


def _summed(units: DataFrame, rows, shape: tuple[int, ...]) -> np.ndarray:
    """Tables of a fixed size, one of each task, added up."""
    out = np.zeros(shape).reshape(-1)
    for i, v in units.mapInPandas(tidy(rows), "i int, v double").groupBy("i").agg(F.sum("v")).collect():
        out[i] = v
    return out.reshape(shape)


def _spelling_sums(shared: Broadcast, weights: np.ndarray, share: float):
    """Newton sums by gate over the words seen once, each less its own sight."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, looks = shared.value
        total = np.zeros((_GATES, _N * (_N + 1)))
        for pdf in batches:
            for once in pdf["once"]:
                words = once.split(b" ") if once else []
                if share < 1:
                    words = [w for w in words if zlib.crc32(w) < share * (1 << 32)]
                for a in range(0, len(words), 4_000):
                    bits, slots, times = spelled_alike(words[a : a + 4_000], code)
                    x, gate, mixed = looks.mixed(bits, slots, weights)
                    total += newton_sums(x, bits, mixed, gate, _GATES, times)
        yield _numbered(total)

    return rows


def _train_speller(units: DataFrame, fit_words: int | None) -> Speller:
    """Counts, the log-odds of single values, and the damped Newton steps of a logistic
    regression for each gate: all over every word that training saw once."""
    sums = np.zeros(256)
    for byte, n in units.select("once").mapInPandas(_byte_counts, "byte int, n long").groupBy("byte").agg(F.sum("n")).collect():  # 256 rows
        sums[byte] = n
    code = Code(sums)
    partial = units.select("once").mapInPandas(tidy(_context_counts(code)), "block int, sums binary")
    tables = np.zeros((2 * _N * _SLOTS // SLOT_BLOCK, SLOT_BLOCK), dtype=np.float32)
    for block, data in partial.repartition("block").mapInPandas(_add_blocks, "block int, sums binary").toLocalIterator():  # 16 MB
        tables[block] = np.frombuffer(data, "<f4")
    tables = tables.reshape(2, _N, _SLOTS)
    alone, weights = alone_odds(tables), start_spelling()
    shared = units.sparkSession.sparkContext.broadcast((code, Looks(tables, alone, True)))  # 18 MB
    share = 1.0 if fit_words is None else min(1.0, fit_words / max(1, int(sums[SPACE])))
    for _ in range(NEWTON if sums[SPACE] else 0):
        weights += newton_step(_summed(units.select("once"), _spelling_sums(shared, weights, share), (_GATES, _N * (_N + 1))), _N).astype(np.float32)
    shared.destroy()
    return Speller(code, Looks(tables, alone, False), weights)


@dataclass
class Model:
    """What scoring needs, of a size that doesn't grow with the corpus."""

    tokens: int
    distinct: int
    texts: int
    tables: np.ndarray
    weights: np.ndarray
    speller: Speller


def counted_units(docs: DataFrame) -> tuple[DataFrame, int, int, int]:
    """``(doc_id, text, learn, held_out)`` -> units with the corpus counts of all their
    tokens; the learnable texts' tokens, distinct words, and number."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    bits = min(24, max(3, ceil(log2(max(1, size / BUCKET_BYTES)))))
    units = materialize(docs.mapInPandas(tidy(_units), UNIT), "mixing-units")
    asked = units.select("unit", "tokens", "words", "sizes", "learn").mapInPandas(tidy(_ask(bits)), ASKED)
    told = asked.repartition("bucket").sortWithinPartitions("bucket", "kind")
    told = materialize(told.mapInPandas(tidy(_answer), "unit long, bucket int, kind int, n int, totals binary, distinct long, tokens long"), "mixing-totals")
    distinct, tokens = told.filter("unit = -1").agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).head()
    texts = units.agg(F.coalesce(F.sum(F.size(F.filter("learn", lambda x: x))), F.lit(0))).head()[0]
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in units.schema.fields if f.name != "unit"]
    answers = told.filter("unit >= 0").select("unit", *none, "bucket", "kind", "n", "totals")
    whole = units.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("bucket", "int"), ("kind", "int"), ("n", "int"), ("totals", "binary"))])
    counted = whole.unionByName(answers).groupBy("unit").applyInPandas(_count_tokens(bits, tokens, texts), COUNTED)
    counted = materialize(counted, "mixing-counts")
    discard(units, told)
    return counted, int(tokens), int(distinct), int(texts)


def fit(units: DataFrame, tokens: int, distinct: int, texts: int, fit_units: int | None = None, fit_words: int | None = None) -> Model:
    """All counts and weights are fitted on all units; ``fit_units`` and ``fit_words`` are bounds,
    about, that a caller may set for the weights' units and words."""
    counts = _summed(units.select("small"), _small_counts, (_BITS, 3, _SMALL, 2))
    tables = np.log((counts[..., 1] + PRIOR) / (counts[..., 0] + PRIOR)).astype(np.float32)
    weights = start_weights()
    some = units
    if fit_units is not None:
        share = min(1.0, fit_units / max(1, units.count()))
        some = units.filter(F.pmod(F.xxhash64("unit"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sums = _summed(some.select("c1", "c2", "c3", "sizes", "learn"), _weight_sums(tokens, texts, tables, weights), (_BITS, _RUNS, _INPUTS * (_INPUTS + 1)))
    for bit in range(_BITS):
        weights[bit] += newton_step(sums[bit], _INPUTS)
    return Model(tokens, distinct, texts, tables, weights, _train_speller(units, fit_words))


def _score(shared: Broadcast):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Model = shared.value
        scale = model.tokens + 0.1 * (model.distinct + 1)
        for pdf in batches:
            for _, row in pdf.iterrows():
                c1, c2, c3, sizes = _counts_of(row)
                new_at, which = _whole(row["new_at"]).reshape(2, -1)
                spelling = np.zeros(len(c1))
                if len(new_at):
                    words = [w or END for w in row["new_words"].replace(END, b"").split(b" ")]
                    spelling[new_at] = model.speller.logs(words)[which]
                logs = [np.zeros(0)]
                for a, b, sources in sliced(c1, c2, c3, sizes, model.tokens, model.texts, False):
                    logs.append(token_logs(sources, source_chances(sources, model.tables, model.weights), spelling[a:b]))
                first, size = np.cumsum(sizes) - sizes, np.maximum(np.asarray(row["bytes"], dtype=np.int64), 1)
                score = np.add.reduceat(np.concatenate(logs), first)
                yield pd.DataFrame({
                    "doc_id": pd.array([None if i is None or i != i else int(i) for i in row["doc_ids"]], dtype="Int64"), "held_out": row["held"], "n_tokens": sizes,
                    "n_known": np.add.reduceat((c1 > 0).astype(np.int64), first), "train_tokens": model.tokens,
                    "base_score": np.add.reduceat(np.log10((c1 + 0.1) / scale), first), "score": score, "bits_per_byte": -score / np.log10(2) / size,
                })

    return rows


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_split(docs: DataFrame, learnable: Column, held_out: Column, fit_units: int | None = None, fit_words: int | None = None) -> DataFrame:
    """Learn from the rows where ``learnable`` holds and score all: ``doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``, a row for each
    input row.

    base_score: the sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))). score: the
    model's log10 probability of the same tokens; that of learnable rows is by counts that
    hold themselves. A null or empty text is its end alone. Texts are read whole and of any
    length; repeated rows are scored alike; other columns are ignored, whatever their names;
    an empty table gives no rows, and with nothing to learn all counts are 0.

    Counts are of all learnable texts, and the few hundred weights that combine them are
    fitted on all of them. A caller may bound that fit to about ``fit_units`` units of 4 MB and
    ``fit_words`` words.
    """
    spark: SparkSession = docs.sparkSession
    picked = small_batches(docs).select("doc_id", "text", F.coalesce(learnable, F.lit(False)).alias("learn"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    units, *sums = counted_units(picked)
    shared = spark.sparkContext.broadcast(fit(units, *sums, fit_units, fit_words))
    scored = materialize(units.mapInPandas(tidy(_score(shared)), RESULT), "mixing-scores")
    shared.destroy()
    discard(units)
    return scored
