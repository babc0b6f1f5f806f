"""Chunked arrays of version 3, sharded or not, as a Spark data source.

    spark.dataSource.register(ArraySource)
    spark.read.format("zarr3").option("rows", "0:99").option("cols", "5:70").option("year", 2024).option("band", "field").load(path)

The driver reads the metadata and the short coordinate arrays and plans a partition for
each shard, or part of one, that meets the window. A task reads the shard's index (the
object's last bytes), then the byte ranges of the inner chunks that meet the window, near
ones together. Nothing else is read, and no chunk leaves its task but as rows.

Writing goes the other way: cells are dealt to inner chunks, which are encoded, and then to
shards, which are joined and get their index.
"""

from __future__ import annotations

import gzip
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .objects import Store, save_objects

#: Cells of a partition at most (one inner chunk is never split); the index's mark for a
#: chunk that isn't stored; the reflected polynomial of CRC-32C.
PARTITION_CELLS, ABSENT, CASTAGNOLI = 1 << 22, (1 << 64) - 1, 0x82F63B78

CELLS = "year int, band string, iy long, ix long, value double"
RANGES = "name string, start long, size long"


def _crc_table() -> list[int]:
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (CASTAGNOLI if c & 1 else 0)
        table.append(c)
    return table


_CRC = _crc_table()


def crc32c(data: bytes) -> int:
    """The checksum of an index: a few thousand bytes at most."""
    c = 0xFFFFFFFF
    for byte in data:
        c = c >> 8 ^ _CRC[(c ^ byte) & 255]
    return c ^ 0xFFFFFFFF


def _unpack(data: bytes, codecs: list[str]) -> bytes:
    for codec in reversed(codecs):
        if codec == "gzip":
            data = gzip.decompress(data)
        elif codec == "zstd":
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        elif codec == "crc32c":
            data, told = data[:-4], int.from_bytes(data[-4:], "little")
            if crc32c(data) != told:
                raise ValueError("checksum doesn't agree")
    return data


@dataclass(frozen=True)
class Layout:
    """What an array's metadata says. Without shards, each chunk is an object of its own."""

    shape: tuple[int, ...]
    shard: tuple[int, ...]
    chunk: tuple[int, ...]
    kind: str
    fill: float | str
    codecs: tuple[str, ...]
    index: tuple[str, ...]
    sharded: bool
    at_end: bool
    dims: tuple[str, ...]
    separator: str

    @classmethod
    def of(cls, meta: dict) -> Layout:
        names = lambda codecs: tuple(c["name"] for c in codecs)
        codecs, outer = meta["codecs"], tuple(meta["chunk_grid"]["configuration"]["chunk_shape"])
        sharded = codecs[0]["name"] == "sharding_indexed"
        inner = codecs[0]["configuration"] if sharded else {"chunk_shape": outer, "codecs": codecs}
        if sharded and len(codecs) > 1:
            raise ValueError("codecs around shards aren't supported")
        unknown = set(names(inner["codecs"])) | set(names(inner.get("index_codecs", [])))
        if unknown := unknown - {"bytes", "gzip", "zstd", "crc32c"}:
            raise ValueError(f"codecs not supported: {sorted(unknown)}")
        kind = meta["data_type"]
        if isinstance(kind, dict):
            if kind["name"] != "fixed_length_utf32":
                raise ValueError(f"data type not supported: {kind['name']}")
            kind = f"U{kind['configuration']['length_bytes'] // 4}"
        big = any(c["name"] == "bytes" and c.get("configuration", {}).get("endian") == "big" for c in inner["codecs"])
        order = np.dtype(kind).newbyteorder(">" if big else "<").str
        dims = meta.get("dimension_names") or [None] * len(outer)
        key = meta.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
        return cls(
            tuple(meta["shape"]), outer, tuple(inner["chunk_shape"]), order, meta["fill_value"], names(inner["codecs"]), names(inner.get("index_codecs", [])),
            sharded, inner.get("index_location", "end") == "end", tuple(d or "" for d in dims), key,
        )

    @property
    def per_shard(self) -> tuple[int, ...]:
        return tuple(s // c for s, c in zip(self.shard, self.chunk, strict=True))

    def object_name(self, shard: tuple[int, ...]) -> str:
        return self.separator.join(["c", *map(str, shard)])

    def decode(self, data: bytes) -> np.ndarray:
        return np.frombuffer(_unpack(data, list(self.codecs)), self.kind).reshape(self.chunk)

    def chunk_ranges(self, store: Store, name: str, wanted: list[tuple[int, ...]]) -> dict[tuple[int, ...], tuple[int, int]]:
        """Where the wanted inner chunks (numbered within the shard) lie; absent ones are
        left out. One range is read for the index, none without shards."""
        size = store.size(name)
        if size is None:
            return {}
        if not self.sharded:
            return {wanted[0]: (0, size)}
        length = 16 * math.prod(self.per_shard) + 4 * self.index.count("crc32c")
        data = store.read(name, size - length if self.at_end else 0, length)
        table = np.frombuffer(_unpack(data, list(self.index)), "<u8").reshape(*self.per_shard, 2)
        return {w: (int(table[w][0]), int(table[w][1])) for w in wanted if int(table[w][0]) != ABSENT}


def layout(store: Store, path: str = "") -> Layout:
    return Layout.of(json.loads(store.read(f"{path}/zarr.json".lstrip("/"))))


def _cuts(low: int, high: int, step: int) -> range:
    """The numbers of the steps that meet ``low`` to ``high``, both included."""
    return range(low // step, high // step + 1)


def read_axis(store: Store, name: str) -> np.ndarray:
    """A coordinate array, whole; chunks that aren't stored hold the fill value."""
    own = layout(store, name)
    out = np.full(own.shape, np.nan if own.fill == "NaN" else own.fill, own.kind)
    for k in _cuts(0, own.shape[0] - 1, own.shard[0]) if own.shape[0] else ():
        at = f"{name}/{own.object_name((k,))}"
        for (c,), where in own.chunk_ranges(store, at, [(c,) for c in range(own.per_shard[0])]).items():
            start = k * own.shard[0] + c * own.chunk[0]
            part = own.decode(store.read(at, *where))[: own.shape[0] - start]
            out[start : start + len(part)] = part
    return out


def _years(store: Store) -> list[int]:
    """The years of a group's axis ``time``: days since a date that the units name."""
    values = read_axis(store, "time")
    units = json.loads(store.read("time/zarr.json")).get("attributes", {}).get("units", "days since 1970-01-01")
    since = date.fromisoformat(units.removeprefix("days since ").split(" ")[0].split("T")[0])
    return [(since + timedelta(days=int(v))).year for v in values]


@dataclass
class _Part(InputPartition):
    """Part of a shard: rows ``first`` to ``last`` of inner chunks, of one year and band."""

    shard: tuple[int, ...]
    lead: tuple[int, ...]
    first: int
    last: int
    year: int | None
    band: str | None


class _ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        given = options["path"].rstrip("/")
        self.group, self.array = given.rsplit("/", 1)
        store = Store(self.group)
        self.layout = layout(store, self.array)
        self.show, self.most = options.get("show", "cells"), int(options.get("partition_cells", PARTITION_CELLS))
        dims, shape = self.layout.dims, self.layout.shape
        axes: list[list[tuple[int, int | str | None]]] = []
        for d, n in zip(dims[:-2], shape[:-2], strict=True):
            names = _years(store) if d == "time" else [str(v) for v in read_axis(store, d)] if d == "band" else [None] * n
            asked = options.get("year" if d == "time" else d)
            axes.append([(i, v) for i, v in enumerate(names) if asked is None or str(v if v is not None else i) == asked])
        self.lead, self.dims = axes, dims[:-2]
        self.window = [self._span(options.get(name), n) for name, n in zip(("rows", "cols"), shape[-2:], strict=True)]

    @staticmethod
    def _span(text: str | None, n: int) -> tuple[int, int]:
        low, high = map(int, text.split(":")) if text else (0, n - 1)
        return max(0, low), min(n - 1, high)

    def partitions(self) -> list[_Part]:
        own, parts = self.layout, []
        (y0, y1), (x0, x1) = self.window
        if y0 > y1 or x0 > x1:
            return []
        rows = max(1, self.most // (own.chunk[-2] * own.shard[-1]))
        for places in product(*self.lead):
            lead = tuple(i for i, _ in places)
            names = dict(zip(self.dims, (v for _, v in places), strict=True))
            for sy, sx in product(_cuts(y0, y1, own.shard[-2]), _cuts(x0, x1, own.shard[-1])):
                shard = (*(i // s for i, s in zip(lead, own.shard, strict=False)), sy, sx)
                low, high = (min(max(y - sy * own.shard[-2], 0), own.shard[-2] - 1) // own.chunk[-2] for y in (y0, y1))
                for first in range(low, high + 1, rows):
                    parts.append(_Part(shard, lead, first, min(high, first + rows - 1), names.get("time"), names.get("band")))
        return parts

    def read(self, part: _Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing is in the window
            return
        own, store = self.layout, Store(self.group)
        (y0, y1), (x0, x1) = self.window
        name = f"{self.array}/{own.object_name(part.shard)}"
        base = [k * s for k, s in zip(part.shard, own.shard, strict=True)]
        inside = tuple((i - b) // c for i, b, c in zip(part.lead, base, own.chunk, strict=False))
        at = tuple((i - b) % c for i, b, c in zip(part.lead, base, own.chunk, strict=False))
        columns = _cuts(max(x0 - base[-1], 0), min(x1 - base[-1], own.shard[-1] - 1), own.chunk[-1])
        wanted = [(*inside, y, x) for y in range(part.first, part.last + 1) for x in columns]
        where = own.chunk_ranges(store, name, wanted)
        data = store.ranges(name, list(where.values()))
        if self.show == "ranges":
            yield pa.RecordBatch.from_pydict({k: [r[i] for r in store.reads] for i, k in enumerate(("name", "start", "size"))})
            return
        for chunk, place in where.items():
            plane = own.decode(data[place])[at].astype(np.float64)
            top, left = base[-2] + chunk[-2] * own.chunk[-2], base[-1] + chunk[-1] * own.chunk[-1]
            a, b = max(y0 - top, 0), max(x0 - left, 0)
            plane = plane[a : y1 - top + 1, b : x1 - left + 1]
            iy, ix = np.nonzero(~np.isnan(plane) if own.fill == "NaN" else plane != own.fill)
            n = len(iy)
            yield pa.RecordBatch.from_pydict({
                "year": pa.array([part.year] * n, pa.int32()), "band": pa.array([part.band] * n, pa.string()),
                "iy": pa.array(iy + top + a, pa.int64()), "ix": pa.array(ix + left + b, pa.int64()), "value": pa.array(plane[iy, ix], pa.float64()),
            })


class ArraySource(DataSource):
    """Options: ``path`` of an array, its group's axes beside it; ``rows`` and ``cols``,
    ``low:high`` with both included; ``year`` and ``band``, or all of them;
    ``partition_cells`` of a partition at most; ``show=ranges`` gives the byte ranges that the window needs instead of its cells. Cells that hold the fill
    value, stored or not, give no rows."""

    @classmethod
    def name(cls) -> str:
        return "zarr3"

    def schema(self) -> str:
        return RANGES if self.options.get("show") == "ranges" else CELLS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArrayReader(dict(self.options))


def read_window(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], year: int | None = None, band: str | None = None, show: str = "cells") -> DataFrame:
    """A window ``(year, band, iy, ix, value)`` of an array, bounds included."""
    spark.dataSource.register(ArraySource)
    source = spark.read.format("zarr3").option("rows", f"{rows[0]}:{rows[1]}").option("cols", f"{cols[0]}:{cols[1]}").option("show", show)
    for name, value in (("year", year), ("band", band)):
        source = source if value is None else source.option(name, str(value))
    return source.load(path)


def label_window(spark: SparkSession, group: str, x: tuple[float, float], y: tuple[float, float]) -> tuple[tuple[int, int], tuple[int, int]]:
    """Rows and columns whose cell centres lie within a box, bounds included, by the group's
    axes ``y`` and ``x``, whichever way they run; none gives an empty span."""
    store, out = Store(group), []
    for axis, (low, high) in (("y", y), ("x", x)):
        hit = np.flatnonzero((values := read_axis(store, axis)) >= min(low, high))
        hit = hit[values[hit] <= max(low, high)]
        out.append((int(hit[0]), int(hit[-1])) if len(hit) else (0, -1))
    return out[0], out[1]


def _meta(shape: list[int], chunk: list[int], kind: str | dict, fill, codecs: list[dict], dims: list[str], **attributes) -> bytes:
    return json.dumps({
        "zarr_format": 3, "node_type": "array", "shape": shape, "data_type": kind, "fill_value": fill, "codecs": codecs, "dimension_names": dims, "attributes": attributes,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
    }).encode()


_BYTES = {"name": "bytes", "configuration": {"endian": "little"}}


def _axis(name: str, values: np.ndarray, fill, **attributes) -> list[tuple[str, bytes]]:
    kind: str | dict = str(values.dtype)
    if values.dtype.kind == "U":
        kind = {"name": "fixed_length_utf32", "configuration": {"length_bytes": values.dtype.itemsize}}
    return [(f"{name}/zarr.json", _meta([len(values)], [len(values)], kind, fill, [_BYTES], [name], **attributes)), (f"{name}/c/0", values.tobytes())]


def write_cells(cells: DataFrame, group: str, array: str, years: list[int], bands: list[str], size: tuple[int, int], shard: tuple[int, int], chunk: tuple[int, int], axes: dict[str, np.ndarray] | None = None) -> None:
    """Write ``cells(year, band, iy, ix, value)`` as a sharded array of 32-bit floats, one
    year and band a shard, with its axes (``y`` and ``x`` as given). Cells that aren't given
    are NaN, chunks and shards without any aren't stored; a cell given twice is an error.

    Cells are dealt out twice: to inner chunks, where they are encoded, and as blobs to
    shards. A task holds one chunk's cells, or one shard's blobs.
    """
    per = (shard[0] // chunk[0], shard[1] // chunk[1])
    t, b = (F.array_position(F.array(*[F.lit(v) for v in of]), F.col(c)) - 1 for of, c in ((years, "year"), (bands, "band")))
    cut = lambda c, n: F.floor(F.col(c) / n)
    placed = cells.select(t.alias("t"), b.alias("b"), cut("iy", shard[0]).alias("sy"), cut("ix", shard[1]).alias("sx"), (cut("iy", chunk[0]) % per[0]).alias("cy"), (cut("ix", chunk[1]) % per[1]).alias("cx"), (F.col("iy") % chunk[0]).alias("y"), (F.col("ix") % chunk[1]).alias("x"), "value")

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        plane = np.full(chunk, np.nan, "<f4")
        at = (pdf["y"].to_numpy(), pdf["x"].to_numpy())
        if len(np.unique(at[0] * chunk[1] + at[1])) < len(pdf):
            raise ValueError("a cell is given twice")
        plane[at] = pdf["value"]
        head = pdf.iloc[:1][["t", "b", "sy", "sx", "cy", "cx"]]
        return head.assign(blob=[zstandard.ZstdCompressor().compress(plane.tobytes())])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        table, at, blobs = np.full((*per, 2), ABSENT, "<u8"), 0, []
        for cy, cx, blob in zip(*(pdf.sort_values(["cy", "cx"])[c] for c in ("cy", "cx", "blob")), strict=True):
            table[cy, cx] = at, len(blob)
            at += len(blob)
            blobs.append(blob)
        index = table.tobytes()
        name = "/".join([array, "c", *(str(pdf[c].iloc[0]) for c in ("t", "b", "sy", "sx"))])
        return pd.DataFrame({"name": [name], "content": [b"".join([*blobs, index, crc32c(index).to_bytes(4, "little")])]})

    keys = "t long, b long, sy long, sx long, cy long, cx long"
    chunks = placed.groupBy("t", "b", "sy", "sx", "cy", "cx").applyInPandas(encode, f"{keys}, blob binary")
    save_objects(chunks.groupBy("t", "b", "sy", "sx").applyInPandas(join, "name string, content binary"), group)
    inner = {"chunk_shape": [1, 1, *chunk], "codecs": [_BYTES, {"name": "zstd", "configuration": {"level": 0}}], "index_codecs": [_BYTES, {"name": "crc32c"}], "index_location": "end"}
    objects = [(f"{array}/zarr.json", _meta([len(years), len(bands), *size], [1, 1, *shard], "float32", "NaN", [{"name": "sharding_indexed", "configuration": inner}], ["time", "band", "y", "x"]))]
    days = np.array([(date(y, 1, 1) - date(1970, 1, 1)).days for y in years], "<i8")
    objects += _axis("time", days, 0, units="days since 1970-01-01") + _axis("band", np.array(bands), "")
    for name, values in (axes or {}).items():
        objects += _axis(name, np.asarray(values, "<f8"), "NaN")
    save_objects(cells.sparkSession.createDataFrame([(n, bytearray(c)) for n, c in objects], "name string, content binary"), group)
