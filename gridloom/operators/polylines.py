"""Polylines against tiles: which tiles a line runs through, cut at the tiles' borders.

A segment in tile units is parted where it crosses whole x or y; between two crossings it lies
in one tile. So a line's tiles are those that it really enters, not those of its box, and each
tile's pieces end exactly on the border, where the next tile's begin. Runs of pieces that
follow each other in one tile are one polyline again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points that are cut at once.
SLICE = 1 << 16


def tile_units(lon: Column, lat: Column, z: Column | int) -> tuple[Column, Column]:
    """A point's place in tiles from the north-west, with fractions, within the projection."""
    n = F.pow(F.lit(2.0), z if isinstance(z, Column) else F.lit(z))
    rad = F.radians(F.greatest(F.least(lat, F.lit(85.05)), F.lit(-85.05)))
    return (lon + 180.0) / 360.0 * n, (1 - F.asinh(F.tan(rad)) / F.lit(3.141592653589793)) / 2 * n


def _crossings(a: Column, b: Column) -> Column:
    """Where, from 0 to 1, a step from ``a`` to ``b`` passes whole numbers."""
    low, high = F.floor(F.least(a, b)) + 1, F.ceil(F.greatest(a, b)) - 1
    whole = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(whole, lambda k: (k - a) / (b - a))


def pieces(lines: DataFrame) -> DataFrame:
    """``lines(id, line array<struct<x,y>>)`` in tile units -> ``(id, seq, step, tx, ty, x0, y0,
    x1, y1)``: every segment (seq) in the stretches (step) that lie in one tile (tx, ty)."""
    several = lines.filter(F.size("line") >= 2)
    zipped = F.arrays_zip(F.slice("line", 1, F.size("line") - 1).alias("a"), F.slice("line", 2, F.size("line") - 1).alias("b"))
    seg = several.select("id", F.posexplode(zipped).alias("seq", "s")).select("id", "seq", *[F.col(f"s.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"])
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), _crossings(ax, bx), _crossings(ay, by))))
    parts = seg.withColumn("cuts", cuts).select("*", F.posexplode(F.slice("cuts", 1, F.size("cuts") - 1)).alias("step", "t0")).withColumn("t1", F.get("cuts", F.col("step") + 1))
    at = lambda a, b, t: F.when(t == 1.0, b).otherwise(a + (b - a) * t)
    middle = (F.col("t0") + F.col("t1")) / 2
    tile = [F.floor(at(a, b, middle)).alias(name) for a, b, name in ((ax, bx, "tx"), (ay, by, "ty"))]
    ends = [at(a, b, F.col(f"t{k}")).alias(f"{c}{k}") for k in (0, 1) for a, b, c in ((ax, bx, "x"), (ay, by, "y"))]
    return parts.select("id", "seq", "step", *tile, *ends)


def tile_cover(lines: DataFrame) -> DataFrame:
    """The distinct tiles ``(id, tx, ty)`` that lines run through."""
    return pieces(lines).select("id", "tx", "ty").distinct()


def _cut(lines: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments in the order of their lines (their numbers, ascending) -> their pieces as
    ``pieces`` has them: segment, tile, and both ends."""
    n, at, where = len(lines), [np.zeros(len(lines)), np.ones(len(lines))], [np.arange(len(lines))] * 2
    for a, b in ((ax, bx), (ay, by)):
        low = np.floor(np.minimum(a, b)) + 1
        count = np.maximum(np.ceil(np.maximum(a, b)) - low, 0).astype(np.int64)
        seg = np.repeat(np.arange(n), count)
        k = low[seg] + (np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count))
        at.append((k - a[seg]) / (b - a)[seg])
        where.append(seg)
    t, seg = np.concatenate(at), np.concatenate(where)
    order = np.lexsort((t, seg))
    t, seg = t[order], seg[order]
    new = np.ones(len(t), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (t[1:] != t[:-1])
    t, seg = t[new], seg[new]
    same = np.flatnonzero(seg[1:] == seg[:-1])
    own, t0, t1 = seg[same], t[same], t[same + 1]
    place = lambda a, b, v: np.where(v == 1.0, b[own], a[own] + (b - a)[own] * v)
    middle = (t0 + t1) / 2
    tx, ty = (np.floor(place(a, b, middle)).astype(np.int64) for a, b in ((ax, bx), (ay, by)))
    return own, tx, ty, place(ax, bx, t0), place(ay, by, t0), place(ax, bx, t1), place(ay, by, t1)


def _cut_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Lines of a batch -> the polylines of their tiles."""
    line = batch.column("line")
    flat = line.flatten()
    x, y = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
    sizes = pc.fill_null(pc.list_value_length(line), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    head = np.flatnonzero((of[1:] == of[:-1]) & np.isfinite(x[1:] + y[1:] + x[:-1] + y[:-1]))
    seg, tx, ty, x0, y0, x1, y1 = _cut(of[head], x[head], y[head], x[head + 1], y[head + 1])
    row = of[head][seg]
    change = np.ones(len(seg), bool)
    change[1:] = (row[1:] != row[:-1]) | (tx[1:] != tx[:-1]) | (ty[1:] != ty[:-1]) | (head[seg[1:]] - head[seg[:-1]] > 1)
    first = np.flatnonzero(change)
    run = np.cumsum(change) - 1
    # a run has its first point and the end of each piece
    many = np.diff(np.append(first, len(seg))) + 1
    px, py = np.empty(len(seg) + len(first)), np.empty(len(seg) + len(first))
    begin = np.cumsum(many) - many
    px[begin], py[begin] = (x0 - tx)[first], (y0 - ty)[first]
    rest = np.arange(len(seg)) + run + 1
    px[rest], py[rest] = x1 - tx, y1 - ty
    row, tx, ty = row[first], tx[first], ty[first]
    order = np.lexsort((ty, tx, row))  # stable: along the line within a tile
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(row[order]) != 0) | (np.diff(tx[order]) != 0) | (np.diff(ty[order]) != 0)
    index = np.arange(len(order))
    part = np.empty(len(order), np.int32)
    part[order] = index - np.maximum.accumulate(np.where(fresh, index, 0))
    points = pa.StructArray.from_arrays([pa.array(px), pa.array(py)], ["x", "y"])
    cut = pa.ListArray.from_arrays(pa.array(np.append(begin, len(px)).astype(np.int32)), points)
    return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(tx), pa.array(ty), pa.array(part), cut], ["id", "tx", "ty", "part", "line"])


def cut_at_tiles(lines: DataFrame) -> DataFrame:
    """``(id, tx, ty, part, line)``: the polylines of each tile that a line runs through, in the
    tile's own units (0 to 1), numbered along the line. A line is one row and is cut where it
    lies, some SLICE points at once: its pieces are neither shuffled nor sorted by Spark. A
    point that isn't finite parts its line."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("line")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
                yield _cut_batch(batch.slice(at, upto - at))
                at = upto

    kind = lines.schema["id"].dataType.simpleString()
    return lines.select("id", "line").mapInArrow(cut, f"id {kind}, tx long, ty long, part int, line array<struct<x:double,y:double>>")


def lines_of_tiles(jobs: DataFrame, lines: DataFrame) -> DataFrame:
    """``jobs(request, state, z, x, y)`` and ``lines(state, z, x, y, ring, line)`` (from tiles
    of states) -> ``(request, state, z, x, y, ring, line)``: the lines of all states and tiles of a
    request as one list. Tiles without lines give none; a tile that two requests name is
    joined once for each."""
    return jobs.hint("merge").join(lines, ["state", "z", "x", "y"]).select("request", "state", "z", "x", "y", "ring", "line")


def tile_totals(jobs: DataFrame, lines: DataFrame) -> DataFrame:
    """``(request, states, lines, points)``: what ``lines_of_tiles`` lists for each request,
    counted. A tile's lines are counted once, before the requests that name it are joined."""
    key = ["state", "z", "x", "y"]
    held = lines.groupBy(*key).agg(F.count("*").alias("lines"), F.sum(F.size("line")).alias("points"))
    found = jobs.hint("merge").join(held, key).groupBy("request")
    return found.agg(F.count_distinct("state").alias("states"), F.sum("lines").alias("lines"), F.sum("points").alias("points"))


def meets_box(line: str, w: Column, s: Column, e: Column, n: Column) -> Column:
    """Whether the bounds of a line of ``(lon, lat)`` meet a box, strictly."""
    lon, lat = F.transform(line, lambda p: p["lon"]), F.transform(line, lambda p: p["lat"])
    return (F.array_min(lon) < e) & (F.array_max(lon) > w) & (F.array_min(lat) < n) & (F.array_max(lat) > s)
