"""Binary formats: directories of tile archives, vector tiles, chunks of arrays.

The helpers below decode one directory, one tile or one chunk; ``tiles`` and ``zarr3`` find
and read them by byte ranges. ``read_grid`` takes arrays without shards through Spark's own
file source, also from stores that nothing else can open.
"""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def varints(data: bytes) -> np.ndarray:
    """All little-endian base-128 numbers of a byte string."""
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    raw = raw[: last[-1] + 1]
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)


def directory(data: bytes) -> pd.DataFrame:
    """``id, run, len, off`` of a directory's entries. Stored column by column: steps of
    ids, runs, lengths, offsets; an offset of 0 goes on where the entry before ends."""
    found = varints(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    n = int(found[0]) if len(found) else 0
    steps, run, length, coded = found[1 : 1 + 4 * n].reshape(4, n)
    before = np.cumsum(length) - length
    start = np.maximum.accumulate(np.where((coded != 0) | (np.arange(n) == 0), np.arange(n), 0)) if n else coded
    return pd.DataFrame({"id": np.cumsum(steps), "run": run, "len": length, "off": coded[start] - 1 + before - before[start]})


def header(data: bytes) -> tuple[int, ...]:
    """Offsets and lengths of the root directory, metadata, leaves and tiles."""
    if data[:7] != b"PMTiles" or data[7] != 3:
        raise ValueError("not a tile archive of version 3")
    return struct.unpack_from("<8Q", data, 8)


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(number, value)`` of a protocol-buffer message; fixed-width values stay bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
            yield key >> 3, value
            continue
        if kind == 2:
            size, at = number(at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, data[at : at + size]
        at += size


def ring_steps(geometry: np.ndarray) -> list[np.ndarray]:
    """The rings of a packed geometry, as absolute points; a closed ring repeats its first."""
    rings, now, at, cursor = [], [], 0, np.zeros(2, np.int64)
    while at < len(geometry):
        command, n = int(geometry[at]) & 7, int(geometry[at]) >> 3
        at += 1
        if command == 7:
            if now:
                now.append(now[0])
            continue
        if command not in (1, 2):
            raise ValueError(f"unknown command {command}")
        coded = geometry[at : at + 2 * n]
        points = cursor + np.cumsum(((coded >> 1) ^ -(coded & 1)).reshape(-1, 2), axis=0)
        at += 2 * n
        if len(points):
            cursor = points[-1]
        for p in points:
            if command == 1:
                if len(now) > 1:
                    rings.append(np.array(now))
                now = []
            now.append(tuple(p))
    if len(now) > 1:
        rings.append(np.array(now))
    return rings


def tile_rings(blob: bytes, layer: str) -> tuple[int, list[np.ndarray]]:
    """A layer's extent and its polygons' rings. An empty tile or an absent layer has none."""
    blob = gzip.decompress(blob) if blob[:2] == b"\x1f\x8b" else blob
    for number, value in wire_fields(blob):
        if number != 3:
            continue
        parts = list(wire_fields(value))
        if dict(parts).get(1) != layer.encode():
            continue
        extent, rings = 4096, []
        for k, v in parts:
            if k == 5:
                extent = int(v)
            elif k == 2:
                feature = dict(wire_fields(v))
                if feature.get(3) == 3:
                    rings += ring_steps(varints(feature.get(4, b"")))
        return extent, rings
    return 4096, []


def polygon_points(tiles: DataFrame, layer: str, key: str | None = None) -> DataFrame:
    """``tiles(tile long, blob)`` -> ``(tile, ring, seq, x, y, extent)``, a row a point, in
    tile units. Null blobs (absent tiles) have no points. Where ``tile`` is a struct, ``key``
    names its fields with their types."""
    kind = "long" if key is None else f"struct<{', '.join(': '.join(f.split()) for f in key.split(','))}>"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: list[tuple] = []
            for tile, blob in zip(pdf["tile"], pdf["blob"], strict=True):
                extent, rings = tile_rings(blob, layer)
                held += [(tile, i, k, int(x), int(y), extent) for i, ring in enumerate(rings) for k, (x, y) in enumerate(ring)]
                if len(held) > 100_000:
                    yield pd.DataFrame(held, columns=["tile", "ring", "seq", "x", "y", "extent"])
                    held = []
            if held:
                yield pd.DataFrame(held, columns=["tile", "ring", "seq", "x", "y", "extent"])

    return tiles.filter("blob is not null").select("tile", "blob").mapInPandas(rows, f"tile {kind}, ring long, seq int, x long, y long, extent int")


def read_grid(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], layer: int | None = None) -> DataFrame:
    """A window of a chunked array (version 3: regular grid, codecs bytes, gzip and zstd)
    -> ``(layer, iy, ix, value)``. Only chunks that meet the window are read: their paths
    follow from the metadata. A chunk that isn't stored holds the fill value and gives no
    rows. Sharded arrays aren't read."""
    meta = json.loads(spark.read.text(f"{path}/zarr.json", wholetext=True).head()[0])
    shape, chunk = meta["shape"], meta["chunk_grid"]["configuration"]["chunk_shape"]
    codecs = [c["name"] for c in meta["codecs"]]
    if unknown := set(codecs) - {"bytes", "gzip", "zstd"}:
        raise ValueError(f"codecs not supported: {sorted(unknown)}")
    kind, lead = np.dtype(meta["data_type"]), len(shape) - 2
    pick = "*" if layer is None else str(layer // chunk[0])
    spans = [range(max(0, w[0]) // c, min(w[1], n - 1) // c + 1) for w, c, n in zip((rows, cols), chunk[lead:], shape[lead:], strict=True)]
    braces = ["{" + ",".join(map(str, s)) + "}" for s in spans]
    if not all(spans):
        return spark.createDataFrame([], "layer int, iy long, ix long, value double")
    pattern = "/".join([path, "c", *([pick] * lead), *braces])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                for codec in reversed(codecs):
                    if codec == "gzip":
                        data = gzip.decompress(data)
                    elif codec == "zstd":
                        import zstandard

                        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
                at = [int(k) * c for k, c in zip(name.split("/")[-len(shape) :], chunk, strict=True)]
                block = np.frombuffer(data, kind.newbyteorder("<")).reshape(-1, *chunk[lead:])
                for i, plane in enumerate(block):
                    z = (at[0] if lead else 0) + i
                    y, x = np.indices(plane.shape)
                    y, x = y + at[lead], x + at[lead + 1]
                    keep = (y >= rows[0]) & (y <= rows[1]) & (x >= cols[0]) & (x <= cols[1]) & (y < shape[lead]) & (x < shape[lead + 1])
                    if keep.any() and (not lead or z < shape[0]) and (layer is None or z == layer):
                        yield pd.DataFrame({"layer": z, "iy": y[keep], "ix": x[keep], "value": plane[keep].astype(float)})

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInPandas(decode, "layer int, iy long, ix long, value double")
