"""Tile archives read by byte ranges, their tiles as a table that grows, and archives written.

Wanted tiles are dealt out by archive and id, so a task's tiles lie side by side. A task reads
an archive's header, its root directory and the leaf directories that its ids fall into, each
once, finds all its ids in a directory with one search, level by level, and then reads the
tiles' bytes, near ones together. No archive and no directory that isn't needed is read.

Tiles that were fetched, and those that aren't there, are rows of a Parquet table: later
requests fetch only what it doesn't know.
"""

from __future__ import annotations

import gzip
import struct
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .archives import directory, header
from .objects import Store

#: Levels of directories at most; leaf directories that a task keeps; entries of a leaf, and
#: of a root that needs none; bytes of tiles read before they are handed on.
LEVELS, KEPT, LEAF_ENTRIES, ROOT_ENTRIES, READ_BYTES = 4, 64, 4096, 1024, 8 << 20
KEY = ["archive", "id"]


class Archive:
    """One archive of a store, opened by its header and root directory."""

    def __init__(self, store: Store, name: str) -> None:
        self.store, self.name = store, name
        root, root_size, _, _, self.leaves, _, self.tiles, _ = header(store.read(name, 0, 127))
        self.root = directory(store.read(name, root, root_size))
        self.kept: OrderedDict[tuple[int, int], pd.DataFrame] = OrderedDict()

    def _leaf(self, off: int, size: int) -> pd.DataFrame:
        found = self.kept.pop((off, size), None)
        if found is None:
            found = directory(self.store.read(self.name, self.leaves + off, size))
        self.kept[off, size] = found
        if len(self.kept) > KEPT:
            self.kept.popitem(last=False)
        return found

    def locate(self, ids: np.ndarray) -> np.ndarray:
        """Offset (in the archive) and size of each id's tile, -1 and 0 where there is none.
        The last entry at or before an id serves it if its run reaches that far; an entry
        without a run leads to another directory."""
        out = np.zeros((len(ids), 2), np.int64)
        out[:, 0] = -1
        level = [(self.root, np.arange(len(ids)))]
        for _ in range(LEVELS):
            deeper = []
            for entries, which in level:
                at = np.searchsorted(entries["id"].to_numpy(), ids[which], "right") - 1
                which, at = which[at >= 0], at[at >= 0]
                first, run, off, size = (entries[c].to_numpy()[at] for c in ("id", "run", "off", "len"))
                hit = (run > 0) & (ids[which] - first < run)
                out[which[hit]] = np.column_stack([off[hit] + self.tiles, size[hit]])
                for entry in np.unique(at[run == 0]):
                    deeper.append((self._leaf(int(entries["off"].iloc[entry]), int(entries["len"].iloc[entry])), which[at == entry]))
            level = deeper
        return out


def _fetch(root: str, suffix: str):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, opened = Store(root), None
        for pdf in batches:
            for name, some in pdf.groupby("archive", sort=False):
                if opened is None or opened.name != f"{name}{suffix}":
                    opened = Archive(store, f"{name}{suffix}")  # rows come in order: one is open at a time
                where = opened.locate(some["id"].to_numpy(np.int64))
                ends = np.cumsum(where[:, 1])
                for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(ends // READ_BYTES)) + 1):
                    found = store.ranges(opened.name, [(int(o), int(n)) for o, n in where[part] if o >= 0])
                    yield some.iloc[part][KEY].assign(blob=[found[int(o), int(n)] if o >= 0 else None for o, n in where[part]])

    return rows


def fetch_tiles(wanted: DataFrame, root: str, suffix: str = ".pmtiles") -> DataFrame:
    """``(archive, id, blob)`` of the distinct ``wanted(archive, id)``; the blob of a tile that
    its archive doesn't have is null. An archive that isn't there is an error."""
    dealt = wanted.select(*KEY).distinct().repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    return dealt.mapInPandas(_fetch(root, suffix), "archive string, id long, blob binary")


def cached_tiles(wanted: DataFrame, root: str, cache: str) -> DataFrame:
    """``wanted`` with each tile's ``blob``, null for one that is known to be absent. What the
    table below ``cache`` doesn't hold yet is fetched and appended, absent tiles too."""
    spark = wanted.sparkSession
    schema = "id long, blob binary, archive string"
    spark.createDataFrame([], schema).write.mode("append").partitionBy("archive").parquet(cache)  # made if it isn't there
    known = spark.read.schema(schema).parquet(cache)
    missing = wanted.select(*KEY).distinct().join(known.select(*KEY), KEY, "left_anti")
    fetch_tiles(missing, root).write.mode("append").partitionBy("archive").parquet(cache)
    return wanted.join(spark.read.schema(schema).parquet(cache), KEY, "left")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def encode_directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """Entries ``(id, run, size, offset)`` in order, column by column; an offset where the
    entry before ends is 0."""
    steps = [b[0] - a[0] for a, b in zip([(0,), *entries], entries, strict=False)]
    coded = [0 if i and off == entries[i - 1][3] + entries[i - 1][2] else off + 1 for i, (_, _, _, off) in enumerate(entries)]
    columns = [[len(entries)], steps, [e[1] for e in entries], [e[2] for e in entries], coded]
    return gzip.compress(b"".join(_varint(v) for c in columns for v in c), mtime=0)


def _head(entries: list[tuple[int, int, int, int]], tiles: int, addressed: int, contents: int) -> bytes:
    """Everything before the tiles: header, root, metadata and leaf directories."""
    leaves, root = b"", entries
    if len(entries) > ROOT_ENTRIES:
        root = []
        for a in range(0, len(entries), LEAF_ENTRIES):
            leaf = encode_directory(entries[a : a + LEAF_ENTRIES])
            root.append((entries[a][0], 0, len(leaf), len(leaves)))
            leaves += leaf
    packed, metadata = encode_directory(root), gzip.compress(b"{}", mtime=0)
    ends = np.cumsum([127, len(packed), len(metadata), len(leaves)]).tolist()
    places = struct.pack("<11Q", 127, len(packed), ends[1], len(metadata), ends[2], len(leaves), ends[3], tiles, addressed, len(entries), contents)
    return (b"PMTiles\x03" + places + bytes([1, 2, 2, 1])).ljust(127, b"\0") + packed + metadata + leaves


def _write(root: str, suffix: str):
    """Write archives from rows in order of archive and id. Tiles go to an object of their
    own first; only entries are held, a tile that repeats the one before adds to its run."""

    def finish(store: Store, name: str, part: str, entries: list, tiles: int, addressed: int, contents: int) -> pd.DataFrame:
        target = store._path(f"{name}{suffix}")
        with store.system.open_output_stream(f"{part}.whole") as out, store.system.open_input_stream(part) as tile_bytes:
            out.write(_head(entries, tiles, addressed, contents))
            while piece := tile_bytes.read(READ_BYTES):
                out.write(piece)
        store.system.move(f"{part}.whole", target)
        store.system.delete_file(part)
        return pd.DataFrame({"archive": [name], "tiles": [addressed], "entries": [len(entries)]})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, now, stream = Store(root), None, None
        store.system.create_dir(store.root, recursive=True)
        for pdf in batches:
            for name, tile, blob in zip(pdf["archive"], pdf["id"], pdf["blob"], strict=True):
                if name != now:
                    if stream is not None:
                        stream.close()
                        yield finish(store, now, part, entries, at, addressed, contents)
                    now, part, entries, at, addressed, contents, last = name, store._path(f"{uuid.uuid4().hex}.part"), [], 0, 0, 0, None
                    stream = store.system.open_output_stream(part)
                if entries and tile < entries[-1][0] + entries[-1][1]:
                    raise ValueError(f"tile {tile} of {name} is given twice")
                addressed += 1
                if blob == last:
                    first, run, size, off = entries[-1]
                    entries.append((tile, 1, size, off))
                    if tile == first + run:
                        entries[-2:] = [(first, run + 1, size, off)]
                else:
                    stream.write(blob)
                    entries.append((int(tile), 1, len(blob), at))
                    at, contents, last = at + len(blob), contents + 1, blob
        if stream is not None:
            stream.close()
            yield finish(store, now, part, entries, at, addressed, contents)

    return rows


def write_archives(tiles: DataFrame, root: str, suffix: str = ".pmtiles") -> DataFrame:
    """Write ``tiles(archive, id, blob)``, an object for each archive below ``root``; returns
    ``(archive, tiles, entries)``. A tile that is given twice is an error. An archive is
    one object and so one task's work, in a stream: its tiles aren't held in memory."""
    given = tiles.select("archive", F.col("id").cast("long").alias("id"), "blob")
    dealt = given.repartition("archive").sortWithinPartitions(*KEY)
    done = dealt.mapInPandas(_write(root, suffix), "archive string, tiles long, entries long")
    return done.sparkSession.createDataFrame(done.collect(), done.schema)  # a row an archive


def _field(number: int, value: int | bytes) -> bytes:
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def _zigzag(v: int) -> int:
    return v << 1 ^ v >> 63


def encode_rings(rings: list[list[tuple[int, int]]]) -> bytes:
    """A packed geometry: move to a ring's first point, lines to the others, close; a ring
    comes without its first point repeated."""
    out, cursor = b"", (0, 0)
    for ring in rings:
        for k, (x, y) in enumerate(ring):
            if k < 2:
                out += _varint(1 << 3 | 1 if k == 0 else (len(ring) - 1) << 3 | 2)
            out += _varint(_zigzag(x - cursor[0])) + _varint(_zigzag(y - cursor[1]))
            cursor = (x, y)
        out += _varint(1 << 3 | 7)
    return out


def encode_tile(layers: dict[str, list[list[tuple[int, int]]]], extent: int = 4096) -> bytes:
    """A vector tile with a polygon feature for each ring of each layer, gzipped."""
    body = b""
    for name, rings in layers.items():
        features = b"".join(_field(2, _field(3, 3) + _field(4, encode_rings([r]))) for r in rings)
        body += _field(3, _field(15, 2) + _field(1, name.encode()) + features + _field(5, extent))
    return gzip.compress(body, mtime=0)


def vector_tiles(rings: DataFrame, extent: int = 4096) -> DataFrame:
    """``rings(archive, id, layer, ring, points array<struct<x,y>>)`` -> ``(archive, id, blob)``:
    a tile of all its layers' rings, in order of ring. A task holds one batch of tiles."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            blobs = []
            for rows in pdf["rings"]:
                layers: dict[str, list] = {}
                for r in rows:
                    layers.setdefault(r["layer"], []).append([(int(p["x"]), int(p["y"])) for p in r["points"]])
                blobs.append(encode_tile(layers, extent))
            yield pdf[KEY].assign(blob=blobs)

    gathered = rings.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("layer", "ring", "points"))).alias("rings"))
    return gathered.mapInPandas(encode, "archive string, id long, blob binary")
