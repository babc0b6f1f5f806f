"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact intersection.

1. Every text becomes a sorted set of 64-bit shingle hashes; texts with the same set
   are one class (128-bit digest).
2. Candidates by prefix filter. Shingles are ordered rarest first, by a count sketch
   over all documents, then by hash; two linked sets share a shingle among the first
   n - ceil(t n) + 1 of each, whatever the order is. So a passage that many documents
   share comes last and makes no candidates, unless it is most of a text. The sketch
   only orders: its collisions cost time, never a link. It has as many counters as
   the shingles call for, since a full one tells nothing apart.
3. Each class is first compared with one pivot. Of classes that share a key and are still
   in several components, parity bitmaps tell which may link: their bit counts bound the
   overlap from above. Those make clusters, whose components are compared tile by tile;
   tiles hold one size band each. Both times the bitmaps go first, and only rows that some
   partner may link with are dealt out again with their sets, to be intersected exactly.
4. Components by star contraction; copies only join at the end.

Nothing is capped: hot keys become more tiles and stream through sorted partitions.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, materialize, sized, small_batches, tidy
from .components import components
from .textkit import mix, ranges, shingle_sets

#: Bits of a parity bitmap, of one that is shuffled (at least), and the classes and
#: shingles that a tile holds at most.
BITMAP_BITS, SIGNATURE_BITS, TILE_ROWS, TILE_SHINGLES = 1024, 256, 4096, 3_000_000
#: Shingles of a tile from which on a task gives its memory back at once; bytes of a batch
#: of texts, whose sets take several times that.
LARGE_TILE, BATCH = 500_000, 2 << 20
#: The count sketch has 2 ** SKETCH_BITS counters at least, so many that each counts SLOT_LOAD
#: shingles, 2 ** SLOT_BITS at most; added up in 2 ** BLOCK_BITS blocks. Tasks send the slots of
#: so many shingles at a time.
SKETCH_BITS, SLOT_BITS, SLOT_LOAD, BLOCK_BITS, SLOTS_HELD = 22, 26, 16, 8, 4_000_000
#: Rows of a tile up to which its pairs are listed with those of other tiles; edges up to
#: which one task finds the components.
SMALL_TILE, FEW_EDGES = 64, 250_000


class Threshold:
    """Linked: den * |A and B| >= num * |A or B|; size bands and segment counts."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def least_overlap(self, total: np.ndarray) -> np.ndarray:
        """Of a linked pair with ``total`` = |A| + |B|."""
        return -(-self.num * total // (self.num + self.den))

    @lru_cache(maxsize=None)  # noqa: B019  one small object for each task
    def lower(self, band: int) -> int:
        """The smallest size of a band; a linked pair lies in one band or in neighbours."""
        return 1 if band <= 0 else max(self.lower(band - 1) + 1, -(-self.lower(band - 1) * self.den // self.num))

    def band(self, n: int) -> int:
        b = 0
        while self.lower(b + 1) <= n:
            b += 1
        return b

    def prefix(self, n: int) -> int:
        """Of any order of all shingles, so many first ones of a set of n hold one of every linked set's."""
        return n - -(-self.num * n // self.den) + 1


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def prefix_keys(values: np.ndarray, levels: np.ndarray, rule: Threshold) -> np.ndarray:
    """The candidate keys of one non-empty set: its rarest shingles, for its own size
    band and the next, of which a linked set of a neighbouring band has one."""
    high = levels[values >> np.uint64(65 - len(levels).bit_length())].astype(np.uint64) << np.uint64(58)
    rarest = np.sort(high | (values & np.uint64((1 << 58) - 1)))[: rule.prefix(len(values))]
    own = rule.band(len(values))
    return np.concatenate([mix(rarest + mix(np.array([band + 1], dtype=np.uint64))) for band in (own, own + 1)])


def bitmap(values: np.ndarray, least: int = BITMAP_BITS) -> np.ndarray:
    """Parity bits, at least one a value: two bitmaps of one width differ in no more
    bits than the sets in elements. Half as wide a bitmap is the two halves' xor. Sets that
    share little still differ in a quarter of all their values' number, which is enough."""
    width = max(least, 1 << (len(values) - 1).bit_length())
    odd = np.bincount((values & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _distinct_sets(batches: Iterator[pd.DataFrame], words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Marks and non-empty sets, without the copies that a task meets: map-side combining."""
    seen: set[int] = set()
    for pdf in batches:
        for s in shingle_sets(pdf["text"].tolist(), words):
            if len(s):
                mark = int(np.frombuffer(digest(s)[:8], "<i8")[0])
                if mark not in seen:
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(mark)
                    yield mark, s


def packed_slots(slots: np.ndarray) -> bytes:
    """Sorted numbers as steps of a byte; 255 goes on."""
    more, last = np.divmod(np.diff(slots, prepend=slots.dtype.type(0)), 255)
    out = np.full(len(slots) + int(more.sum()), 255, dtype=np.uint8)
    out[np.cumsum(more + 1) - 1] = last
    return zlib.compress(out.tobytes(), 1)


def unpacked_slots(data: bytes) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _light(words: int):
    """One pass over the texts: a row for each document, and the sketch's slots that
    different sets of the task count in, block by block."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, seen = [], 0, set()

        def blocks() -> pd.DataFrame:
            slots = np.sort(np.concatenate(held))
            starts = np.arange((1 << BLOCK_BITS) + 1, dtype=np.int64) << (SLOT_BITS - BLOCK_BITS)
            at = np.searchsorted(slots, starts)
            full = np.flatnonzero(at[1:] > at[:-1])
            packed = [packed_slots(slots[at[i] : at[i + 1]].astype(np.int64) - starts[i]) for i in full]
            return pd.DataFrame({"doc_id": None, "n_shingles": None, "cls": None, "block": full, "slots": packed})

        for pdf in batches:
            marks, sizes = [], []
            for s in shingle_sets(pdf["text"].tolist(), words):
                marks.append(digest(s) if len(s) else None)
                sizes.append(len(s))
                if len(s) and marks[-1] not in seen:
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(marks[-1])
                    held.append((s >> np.uint64(64 - SLOT_BITS)).astype(np.uint32))
                    size += len(s)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": sizes, "cls": marks, "block": None, "slots": None})
            if size > SLOTS_HELD:
                yield blocks()
                held, size = [], 0
        if held:
            yield blocks()

    return rows


def _add_sketches(bits: int):
    """Of each block the counts' levels: the number of binary digits."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for block, data in zip(pdf["block"], pdf["slots"], strict=True):
                if block not in sums:
                    sums[block] = np.zeros(1 << (bits - BLOCK_BITS), dtype=np.int64)
                slots = unpacked_slots(data) >> (SLOT_BITS - bits)
                if len(slots) * 8 < len(sums[block]):
                    np.add.at(sums[block], slots, 1)
                else:
                    sums[block] += np.bincount(slots, minlength=len(sums[block]))
        levels = [zlib.compress(np.frexp(v.astype(float))[1].astype(np.uint8).tobytes(), 1) for v in sums.values()]
        yield pd.DataFrame({"block": np.array(list(sums), dtype=np.int32), "levels": levels})

    return rows


def sketch_bits(shingles: int) -> int:
    """Of a sketch that tells so many shingles apart."""
    return min(SLOT_BITS, max(SKETCH_BITS, (shingles // SLOT_LOAD).bit_length()))


def shingle_levels(sketches: DataFrame, bits: int) -> list[bytes]:
    """How common shingles are, by the first bits of their hash: blocks for level_table."""
    found = sketches.repartition("block").mapInPandas(tidy(_add_sketches(bits)), "block int, levels binary").collect()
    known, none = {r.block: bytes(r.levels) for r in found}, zlib.compress(bytes(1 << (bits - BLOCK_BITS)), 1)
    return [known.get(i, none) for i in range(1 << BLOCK_BITS)]


def level_table(blocks: list[bytes]) -> np.ndarray:
    table = None
    for i, block in enumerate(blocks):
        levels = np.frombuffer(zlib.decompress(block), np.uint8)
        if table is None:
            table = np.empty((len(blocks), len(levels)), dtype=np.uint8)
        table[i] = levels
    return table.reshape(-1)


def _keys(words: int, rule: Threshold, levels: Broadcast):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, keys, marks, size = level_table(levels.value), [], [], 0
        for mark, s in _distinct_sets(batches, words):
            keys.append(prefix_keys(s, table, rule))
            marks.append(np.full(len(keys[-1]), mark))
            size += len(keys[-1])
            if size > 500_000:
                yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "mark": np.concatenate(marks)})
                keys, marks, size = [], [], 0
        if keys:
            yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "mark": np.concatenate(marks)})

    return rows


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key and mark -> (key, mark, pivot), the different marks of each key
    that has several; pivot: the key's least mark. Streams: it keeps the last row, its
    key's pivot, and the last key that it told."""
    key = pivot = last = told = None
    for pdf in batches:
        k, m = pdf["key"].to_numpy(), pdf["mark"].to_numpy()
        if not len(k):
            continue
        new = np.concatenate(([k[0] != key], k[1:] != k[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        pivots = np.where(first >= 0, m[np.maximum(first, 0)], m[0] if pivot is None else pivot)
        repeated = np.concatenate(([key is not None and not new[0] and m[0] == last], (k[1:] == k[:-1]) & (m[1:] == m[:-1])))
        keep = (m != pivots) & ~repeated
        key, pivot, last = k[-1], pivots[-1], m[-1]
        if keep.any():
            k, m, pivots = k[keep], m[keep], pivots[keep]
            begun = np.concatenate(([k[0] != told], k[1:] != k[:-1]))
            told = k[-1]
            yield pd.DataFrame({"key": np.concatenate((k, k[begun])), "mark": np.concatenate((m, pivots[begun])), "pivot": np.concatenate((pivots, pivots[begun]))})


def _signatures(words: int, rule: Threshold):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [s for s in shingle_sets(pdf["text"].tolist(), words) if len(s)]
            marks = [digest(s) for s in sets]
            yield pd.DataFrame({
                "cls": marks, "mark": [np.frombuffer(x[:8], "<i8")[0] for x in marks], "n": [len(s) for s in sets],
                "band": [rule.band(len(s)) for s in sets], "bits": [bitmap(s, SIGNATURE_BITS).tobytes() for s in sets],
            })

    return rows


def _sets(words: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [s for s in shingle_sets(pdf["text"].tolist(), words) if len(s)]
            yield pd.DataFrame({"digest": [digest(s) for s in sets], "vals": [s.tobytes() for s in sets]})

    return rows


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of different bits of each left bitmap to each right one."""
    if left.shape[1] > 64:
        return np.bitwise_count(left[:, None] ^ right[None]).sum(axis=2, dtype=np.int64)
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for a, b in zip(left.T, right.T, strict=True):
        out += np.bitwise_count(a[:, None] ^ b[None])
    return out


def sift_tile(side: np.ndarray, sizes: np.ndarray, labels: np.ndarray, bits: list[bytes], rule: Threshold) -> np.ndarray:
    """Which rows of a tile a row of the other side, of another label, may link with."""
    kept = np.zeros(len(side), dtype=bool)
    widths = np.array([len(x) // 8 for x in bits])
    groups = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}
    stacks = {w: np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(-1, w) for w, at in groups.items()}
    for w, at in groups.items():
        own = side[at] == 0
        left, left_bits = at[own], stacks[w][own]
        for v, right in groups.items() if len(left) else ():
            narrow = min(w, v)
            a, b = folded(left_bits, narrow), folded(stacks[v], narrow)
            step = max(1, (1 << 19) // (len(right) * (narrow if narrow > 64 else 1)))
            for k in range(0, len(left), step):
                l = left[k : k + step]
                n, m = sizes[l][:, None], sizes[right][None]
                least = rule.least_overlap(n + m)
                fit = (np.minimum(n, m) >= least) & (labels[l][:, None] != labels[right][None])
                if fit.any():
                    fit &= (n + m - _apart(a[k : k + step], b)) // 2 >= least
                    kept[l] |= fit.any(axis=1)
                    kept[right] |= fit.any(axis=0)
    return kept


def sift_pairs(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, labels: np.ndarray, bits: list[bytes], rule: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of different labels that may link."""
    least = rule.least_overlap(sizes[left] + sizes[right])
    fit = (labels[left] != labels[right]) & (np.minimum(sizes[left], sizes[right]) >= least)
    left, right, least = left[fit], right[fit], least[fit]
    widths, may = np.array([len(x) // 8 for x in bits]), np.zeros(len(left), dtype=bool)
    narrow = np.minimum(widths[left], widths[right])
    for w in np.unique(narrow).tolist():
        these = np.flatnonzero(narrow == w)
        used = np.unique(np.concatenate((left[these], right[these])))
        stack = np.empty((len(used), w), dtype=np.uint64)
        for v in np.unique(widths[used]).tolist():
            at = np.flatnonzero(widths[used] == v)
            stack[at] = folded(np.frombuffer(b"".join([bits[i] for i in used[at]]), np.uint64).reshape(-1, v), w)
        step = max(1, (1 << 19) // w)
        for k in range(0, len(these), step):
            i = these[k : k + step]
            apart = np.bitwise_count(stack[np.searchsorted(used, left[i])] ^ stack[np.searchsorted(used, right[i])]).sum(axis=1, dtype=np.int64)
            may[i] = (sizes[left[i]] + sizes[right[i]] - apart) // 2 >= least[i]
    return left[may], right[may]


def _sifted(pdf: pd.DataFrame, tile: np.ndarray, rule: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Of rows tile by tile: which may link with another of their tile, the pairs in small
    tiles that may, and where large tiles begin and end."""
    side, sizes, bits = pdf["side"].to_numpy(), pdf["n"].to_numpy(np.int64), pdf["bits"].tolist()
    labels, kept = pd.factorize(pdf["label"])[0], np.zeros(len(pdf), dtype=bool)
    heads = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
    rows = np.diff(heads, append=len(pdf))
    at = np.repeat(np.arange(len(heads)), rows)
    own = np.flatnonzero((side == 0) & (rows[at] <= SMALL_TILE))
    many = rows[at[own]]
    left, right = sift_pairs(np.repeat(own, many), ranges(heads[at[own]], many), sizes, labels, bits, rule)
    kept[left] = kept[right] = True
    large = [(a, a + n) for a, n in zip(heads.tolist(), rows.tolist(), strict=True) if n > SMALL_TILE]
    for a, b in large:
        kept[a:b] = sift_tile(side[a:b], sizes[a:b], labels[a:b], bits[a:b], rule)
    return kept, left, right, large


def _by_tile(keys: list[str], made: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]):
    """What is made of rows sorted by the keys, whole tiles at a time. Streams: it holds a
    batch and the tile that goes on in the next."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(pdf):
                tile = pdf.groupby(keys, sort=False).ngroup().to_numpy()
                whole = int(np.argmax(tile == tile[-1]))
                held = pdf.iloc[whole:]
                if whole:
                    yield made(pdf.iloc[:whole], tile[:whole])
        if held is not None:
            yield made(held, np.zeros(len(held)))

    return rows


def _sift(keys: list[str], rule: Threshold):
    return _by_tile(keys, lambda pdf, tile: pdf[_sifted(pdf, tile, rule)[0]].drop(columns="bits"))


def _near(keys: list[str], rule: Threshold):
    """Edges that join the classes of a tile that may link; in large tiles, all that may with any."""

    def edges(pdf: pd.DataFrame, tile: np.ndarray) -> pd.DataFrame:
        kept, left, right, large = _sifted(pdf, tile, rule)
        cls = pdf["cls"].to_numpy()
        stars = [np.unique(cls[a:b][kept[a:b]]) for a, b in large]
        u, v = (np.concatenate(x) for x in ((cls[left], *stars), (cls[right], *[np.repeat(x[:1], len(x)) for x in stars])))
        return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)}).drop_duplicates()

    return _by_tile(keys, edges)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def compare_tile(pdf: pd.DataFrame, rule: Threshold, every: bool) -> pd.DataFrame:
    """Side 0 against all rows of a tile. every: all links, else only links between
    what the labels and the links found so far leave apart."""
    pdf = pdf.drop_duplicates(["side", "cls"])
    left, right = pdf[pdf["side"] == 0], pdf
    marks = right["cls"].tolist()
    sizes = right["n"].to_numpy(np.int64)
    values = [np.frombuffer(x, np.uint64) for x in right["vals"]]
    bits = np.stack([folded(bitmap(v), BITMAP_BITS // 64) for v in values])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    labels = right["label"].tolist()
    found = []
    for i in np.flatnonzero((right["side"] == 0).to_numpy()) if len(left) else ():
        total = sizes + sizes[i]
        apart = np.bitwise_count(bits ^ bits[i]).sum(axis=1, dtype=np.int64)
        most = np.minimum((total - apart) // 2, np.minimum(sizes, sizes[i]))
        for j in np.flatnonzero(most >= rule.least_overlap(total)):
            if marks[j] == marks[i] or not every and root(labels[i]) == root(labels[j]):
                continue
            if rule.linked(_shared(values[i], values[j]), sizes[i], sizes[j]):
                parent[root(labels[i])] = root(labels[j])
                found.append((min(marks[i], marks[j]), max(marks[i], marks[j])))
    return pd.DataFrame(found, columns=["u", "v"])


def _unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All edges -> each node and the least node that it is joined with."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent[x]) != x:
            parent[x] = x = parent[up]
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            if u != v:
                a, b = sorted((root(parent.setdefault(u, u)), root(parent.setdefault(v, v))))
                parent[b] = a
    yield pd.DataFrame({"node": list(parent), "label": [root(x) for x in parent]}, dtype=np.int64)


def _joined(edges: DataFrame, name: str) -> DataFrame:
    """components() of a written table of edges; of few edges in one task, without its rounds."""
    if edges.count() > FEW_EDGES:
        return components(edges, name)
    return materialize(edges.coalesce(1).mapInPandas(_unite, "node long, label long"), name)


def _signed(rows: DataFrame, keys: list[str], signatures: DataFrame) -> DataFrame:
    """Rows with their sizes and bitmaps, dealt out and sorted by the keys."""
    dealt = rows.join(signatures.select("cls", "n", "bits"), "cls").select(*rows.columns, "n", "bits")
    return dealt.repartition(*keys).sortWithinPartitions(*keys)


def _compare(rows: DataFrame, keys: list[str], signatures: DataFrame, sets_of: Callable[[DataFrame], DataFrame], rule: Threshold, every: bool = False) -> DataFrame:
    """Links between side 0 and all rows of each tile; rows: keys, cls, label, side."""
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    sifted = materialize(_signed(rows, keys, signatures).mapInPandas(tidy(_sift(keys, rule)), f"{types}, n long"), "jaccard-sifted")
    whole = sifted.join(sets_of(sifted.select("cls").distinct()), "cls")

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        large = int(pdf["n"].sum()) > LARGE_TILE
        links = compare_tile(pdf, rule, every)
        if large:
            del pdf
            give_back()
        return links

    return whole.groupBy(*keys).applyInPandas(compared, "u long, v long").distinct()


_TILE = ["cluster", "mb", "mk", "ab", "ak"]


def _tiles(signatures: DataFrame, cluster: DataFrame, labelled: DataFrame, every: bool) -> DataFrame:
    """Tiles of each cluster of classes, which may be in several: what isn't in its largest
    component (``every``: all of it) against everything, by neighbouring size bands.
    Clusters that are in one component have none."""
    if every:
        cluster = cluster.withColumn("label", F.col("cls")).withColumn("minor", F.lit(True))
    else:
        state = materialize(cluster.join(labelled, "cls"), "jaccard-state")
        shares = state.groupBy("cluster", "label").agg(F.count("*").alias("c"))
        largest = shares.groupBy("cluster").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1")
        largest = materialize(largest.select("cluster", "main"), "jaccard-main")
        cluster = state.join(sized(largest), "cluster").select("cls", "cluster", "label", (F.col("label") != F.col("main")).alias("minor"))
    rows = materialize(signatures.select("cls", "n", "band").join(cluster, "cls"), "jaccard-rows")
    blocks = rows.groupBy("cluster", "band").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    blocks = blocks.select("cluster", "band", F.ceil(F.greatest(F.col("c") / TILE_ROWS, F.col("s") / TILE_SHINGLES)).cast("int").alias("k"))
    rows = rows.join(sized(materialize(blocks, "jaccard-blocks")), ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int")).drop("k", "n")
    tiles = rows.filter("minor").select("cluster", F.col("band").alias("mb"), F.col("block").alias("mk")).distinct()
    tiles = tiles.withColumn("ab", F.explode(F.array(*[F.col("mb") + x for x in (-1, 0, 1)])))
    tiles = tiles.join(rows.select("cluster", F.col("band").alias("ab"), F.col("block").alias("ak")).distinct(), ["cluster", "ab"])
    tiles = materialize(tiles.select(*_TILE), "jaccard-tiles")  # those with rows on both sides
    minor = rows.filter("minor").select("cluster", F.col("band").alias("mb"), F.col("block").alias("mk"), "cls", "label", F.lit(0).alias("side"))
    other = rows.select("cluster", F.col("band").alias("ab"), F.col("block").alias("ak"), "cls", "label", F.lit(1).alias("side"))
    dealt = minor.join(tiles, ["cluster", "mb", "mk"]).unionByName(other.join(tiles, ["cluster", "ab", "ak"]))
    return dealt.select(*_TILE, "cls", "label", "side")


def _met(groups: DataFrame, labelled: DataFrame, signatures: DataFrame, sets_of: Callable[[DataFrame], DataFrame], rule: Threshold, every: bool = False) -> DataFrame:
    """Links between classes of one group, of different labels unless ``every``; groups:
    ``(cls, cluster)``, a class being in several. Which classes may link is asked in each
    group; their sets are dealt out once, by the clusters that they make."""
    tiles = _tiles(signatures, groups, labelled, every)
    near = materialize(_signed(tiles, _TILE, signatures).mapInPandas(tidy(_near(_TILE, rule)), "u long, v long").distinct(), "jaccard-near")
    cluster = _joined(near, "jaccard-clusters").select(F.col("node").alias("cls"), F.col("label").alias("cluster"))
    return materialize(_compare(_tiles(signatures, cluster, labelled, every), _TILE, signatures, sets_of, rule, every), "jaccard-links")


def jaccard_classes(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, every_link: bool = False) -> tuple[DataFrame, DataFrame]:
    """Link texts whose sets of ``words``-word shingles have a Jaccard similarity of
    num/den or more.

    docs: ``doc_id``, ``text`` and any other columns, which are ignored. Returns two
    frames: documents ``(doc_id, n_shingles, cls)``, a row for each input row, and
    links ``(u, v)`` between different classes: all of them with ``every_link``, else
    as many as keep the connected components whole. A null or wordless text has no
    shingles, a null class and no links. Rows with one set of shingles share a class.
    """
    light, links, digests, _ = _numbered_links(docs, words, num, den, every_link)
    ends = [digests.select(F.col("cls").alias(c), F.col("digest").alias(f"{c}_digest")) for c in ("u", "v")]
    named = links.join(ends[0], "u").join(ends[1], "v")
    return light, named.select(F.least("u_digest", "v_digest").alias("u"), F.greatest("u_digest", "v_digest").alias("v"))


def _numbered_links(docs: DataFrame, words: int, num: int, den: int, every_link: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """jaccard_classes with links between numbers of classes, which shuffle as half of a
    digest, a frame ``(cls, digest)`` of the numbers of all classes with candidates, and,
    without every_link, their labels ``(cls, label)``: the least class that links reach."""
    rule = Threshold(num, den)
    texts = small_batches(docs, BATCH).select("doc_id", "text")
    once = materialize(texts.mapInPandas(tidy(_light(words)), "doc_id long, n_shingles long, cls binary, block int, slots binary"), "jaccard-docs")
    light = once.filter("block is null").select("doc_id", "n_shingles", "cls")
    bits = sketch_bits(once.agg(F.sum("n_shingles")).head()[0] or 0)
    levels = docs.sparkSession.sparkContext.broadcast(shingle_levels(once.filter("block is not null").select("block", "slots"), bits))
    keys = texts.mapInPandas(tidy(_keys(words, rule, levels)), "key long, mark long")
    spread = keys.repartition("key").sortWithinPartitions("key", "mark")
    members = materialize(spread.mapInPandas(tidy(_members), "key long, mark long, pivot long"), "jaccard-members")
    stars = materialize(members.filter("mark != pivot").groupBy("mark", "pivot").agg(F.count("*").alias("n")), "jaccard-pairs")
    groups = different_groups(members)
    discard(members)

    marks = stars.select("mark").union(stars.select("pivot")).distinct()
    first_of = light.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    first_of = materialize(first_of.withColumn("mark", _mark("cls")).join(marks, "mark", "left_semi").select("cls", "doc_id"), "jaccard-fetch")

    def texts_of(ids: DataFrame) -> DataFrame:
        ids = sized(materialize(ids.distinct(), "jaccard-fetch"))
        return texts.join(ids, texts["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")

    signatures = texts_of(first_of.select("doc_id")).mapInPandas(tidy(_signatures(words, rule)), "cls binary, mark long, n long, band int, bits binary")
    signatures = signatures.dropDuplicates(["cls"]).withColumnRenamed("cls", "digest")
    signatures = materialize(signatures.withColumn("cls", F.monotonically_increasing_id()), "jaccard-signatures")
    digests = signatures.select("cls", "digest")
    first_of = first_of.withColumnRenamed("cls", "digest")

    def sets_of(classes: DataFrame) -> DataFrame:
        wanted = materialize(digests.join(classes, "cls"), "jaccard-wanted")
        sets = texts_of(first_of.join(wanted, "digest").select("doc_id")).mapInPandas(tidy(_sets(words)), "digest binary, vals binary")
        return materialize(sets.dropDuplicates(["digest"]).join(sized(wanted), "digest").select("cls", "vals"), "jaccard-sets")

    names = signatures.select("cls", "mark", F.col("n").alias("size"))
    pairs = stars.join(names, "mark").withColumnRenamed("cls", "a")
    pairs = pairs.join(names.select(F.col("mark").alias("pivot"), F.col("cls").alias("b")), "pivot").select("a", "b", "n", "size")
    same_mark = names.groupBy("mark").agg(F.min("cls").alias("b"), F.count("*").alias("c")).filter("c > 1").select("mark", "b")
    same_mark = materialize(names.join(sized(materialize(same_mark, "jaccard-marks")), "mark"), "jaccard-same-mark")
    pairs = pairs.union(same_mark.filter("cls != b").select(F.col("cls").alias("a"), "b", F.lit(1).cast("long").alias("n"), "size"))
    # Classes by the keys that they share, and those of one mark, which share all of them.
    named = groups.join(names.select("mark", "cls"), "mark").select("cls", F.col("key").alias("cluster"))
    named = named.union(same_mark.select("cls", "mark"))
    if every_link:
        return light, _met(named, names, signatures, sets_of, rule, True), digests, None

    best = pairs.groupBy("a").agg(F.max_by(F.struct("b", "size"), F.struct(F.col("n"), F.col("b"))).alias("best")).select("a", "best.b", "best.size")
    best = materialize(best, "jaccard-best")
    parts = best.groupBy("b").agg(F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("size") / TILE_SHINGLES)).cast("int").alias("k"))
    split = best.join(sized(materialize(parts.filter("k > 1"), "jaccard-parts")), "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("k", F.lit(1))).cast("int")).select("a", "b", "part")
    member = split.select("b", "part", F.col("a").alias("cls"), F.lit(1).alias("side"))
    pivot = split.select("b", "part").distinct().select("b", "part", F.col("b").alias("cls"), F.lit(0).alias("side"))
    first = member.union(pivot).withColumn("label", F.col("cls"))
    links = materialize(_compare(first, ["b", "part"], signatures, sets_of, rule), "jaccard-links")

    # Only classes that share a key and aren't joined yet can bring another link.
    joined = _joined(links, "jaccard-first").select(F.col("node").alias("cls"), "label")
    labelled = signatures.select("cls").join(joined, "cls", "left").select("cls", F.coalesce("label", "cls").alias("label"))
    labelled = materialize(labelled, "jaccard-labels")
    more = _met(named, labelled, signatures, sets_of, rule)
    discard(stars, groups, best)

    # What the tiles have linked are labels already: their graph is small, or has no edge.
    at = lambda c: labelled.select(F.col("cls").alias(c), F.col("label").alias(f"{c}_label"))
    between = more.join(at("u"), "u").join(at("v"), "v").select(F.col("u_label").alias("u"), F.col("v_label").alias("v"))
    merged = _joined(materialize(between, "jaccard-between"), "jaccard-last").select(F.col("node").alias("label"), F.col("label").alias("least"))
    labels = labelled.join(sized(materialize(merged, "jaccard-merged")), "label", "left").select("cls", F.coalesce("least", "label").alias("label"))
    return light, links.union(more), digests, labels


def different_groups(members: DataFrame) -> DataFrame:
    """``(key, mark)`` of ``members`` without the keys whose marks are another key's: of keys
    with one set of marks (128 bits tell sets apart) the least stays."""
    seen = members.groupBy("key").agg(F.bit_xor(F.xxhash64("mark")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), F.col("mark"))).alias("y"), F.count("*").alias("c"))
    first = materialize(seen.groupBy("x", "y", "c").agg(F.min("key").alias("key")).select("key"), "jaccard-keys")
    groups = materialize(members.join(sized(first), "key", "left_semi").select("key", "mark"), "jaccard-groups")
    discard(first)
    return groups


def _mark(cls: str) -> Column:
    """The first eight bytes of a digest as the little-endian long that numpy reads."""
    hexed = F.hex(cls)
    turned = F.concat(*[F.substring(hexed, 15 - 2 * i, 2) for i in range(8)])
    high, low = F.conv(F.substring(turned, 1, 8), 16, 10).cast("long"), F.conv(F.substring(turned, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, a row for each input row.

    component_id: the smallest doc_id that links reach, its own included. A text
    without words is linked with nothing: its component is its own id. Null ids count
    as larger than any other; a component of null ids only has a null id. Rows that
    repeat an id are judged each by its own text. An empty table gives no rows.
    """
    light, _, digests, labels = _numbered_links(docs, words, num, den, False)
    labels = labels.join(digests, "cls").select(F.col("digest").alias("cls"), "label")
    least = light.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("m"))
    least = materialize(least.join(labels, "cls", "left").select("cls", "m", "label"), "jaccard-classes")
    linked, alone = least.filter("label is not null"), least.filter("label is null")
    whole = linked.groupBy("label").agg(F.min("m").alias("component_id"))
    final = linked.join(whole, "label").select("cls", "component_id").union(alone.select("cls", "m"))
    return light.join(final, "cls", "left").select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
