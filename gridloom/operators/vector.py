"""Tile ids, field outlines and packed masks as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of one packed block; what bitmap_construct_agg holds.
BLOCK_BITS = 32768
CHUNK = 512


def hilbert_id(z: str, x: str, y: str) -> Column:
    """The archive's tile id: all tiles of coarser zooms, then the place on the Hilbert curve."""
    return F.expr(f"""(shiftleft(1L, 2 * cast({z} as int)) - 1) div 3 + aggregate(
        filter(transform(sequence(1, greatest(cast({z} as int), 1)), i -> cast({z} as int) - i), k -> k >= 0),
        named_struct('x', cast({x} as bigint), 'y', cast({y} as bigint), 'd', 0L),
        (a, k) -> transform(array(named_struct('s', shiftleft(1L, k), 'r', shiftright(a.x, k) & 1, 't', shiftright(a.y, k) & 1,
            'u', a.x & (shiftleft(1L, k) - 1), 'v', a.y & (shiftleft(1L, k) - 1))), q -> named_struct(
            'x', if(q.t = 1, q.u, if(q.r = 1, q.s - 1 - q.v, q.v)),
            'y', if(q.t = 1, q.v, if(q.r = 1, q.s - 1 - q.u, q.u)),
            'd', a.d + q.s * q.s * ((3 * q.r) ^ q.t)))[0],
        a -> a.d)""")


def entry_offsets(entries: DataFrame) -> DataFrame:
    """``(dir, k, v, len)`` -> with ``off``: a coded v of 0 (not first) goes on where the
    entry before ends, else the offset is v - 1. Runs of such entries are islands."""
    order = Window.partitionBy("dir").orderBy("k")
    island = F.sum(F.when((F.col("v") != 0) | (F.col("k") == 0), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    inside = Window.partitionBy("dir", "island").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    off = F.first("v").over(inside) - 1 + F.sum("len").over(inside) - F.col("len")
    return entries.withColumn("island", island).withColumn("off", off).drop("island")


def ring_points(deltas: DataFrame) -> DataFrame:
    """``(ring, seq, dx, dy)``, zigzag-decoded -> with the cursor ``x, y``."""
    w = Window.partitionBy("ring").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("x", F.sum("dx").over(w)).withColumn("y", F.sum("dy").over(w))


def clipped_polylines(points: DataFrame, extent: int = 4096) -> DataFrame:
    """``(ring, seq, x, y)`` -> ``(ring, part, line)``: a segment goes when both ends lie
    beyond the same edge; runs of kept segments are polylines, in order of seq."""
    order = Window.partitionBy("ring").orderBy("seq")
    nx, ny = F.lead("x").over(order), F.lead("y").over(order)
    pairs = points.withColumn("nx", nx).withColumn("ny", ny).filter("nx is not null")
    out = F.lit(False)
    for a, b in (("x", "nx"), ("y", "ny")):
        out |= ((F.col(a) < 0) & (F.col(b) < 0)) | ((F.col(a) > extent) & (F.col(b) > extent))
    runs = pairs.withColumn("nth", F.row_number().over(order)).filter(~out).withColumn("part", F.col("nth") - F.row_number().over(order))
    lines = runs.groupBy("ring", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "nx", "ny"))).alias("s"))
    head = F.array(F.struct(F.col("s")[0]["x"].alias("x"), F.col("s")[0]["y"].alias("y")))
    rest = F.transform("s", lambda v: F.struct(v["nx"].alias("x"), v["ny"].alias("y")))
    return lines.select("ring", "part", F.concat(head, rest).alias("line"))


def bounds(line: str) -> list[Column]:
    """w, s, e, n of an array of ``(lon, lat)``."""
    lon, lat = F.transform(line, lambda p: p["lon"]), F.transform(line, lambda p: p["lat"])
    return [F.array_min(lon).alias("w"), F.array_min(lat).alias("s"), F.array_max(lon).alias("e"), F.array_max(lat).alias("n")]


def box_join(boxes: DataFrame, others: DataFrame, cell: float) -> DataFrame:
    """Pairs ``(a, b)`` of boxes ``(id, w, s, e, n)`` that overlap strictly. Both sides are
    dealt to square cells; a pair is taken in the cell of its common corner alone, so it
    needs no distinct. A box over very many cells is as many rows: choose cell by box size."""

    def dealt(df: DataFrame, name: str) -> DataFrame:
        on = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
        return df.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}{c}") for c in "wsen"], on("w", "e").alias("cx"), "s", "n").withColumn("cy", on("s", "n")).drop("s", "n")

    both = dealt(boxes, "a").join(dealt(others, "b"), ["cx", "cy"])
    overlap = (F.col("aw") < F.col("be")) & (F.col("ae") > F.col("bw")) & (F.col("as") < F.col("bn")) & (F.col("an") > F.col("bs"))
    corner = (F.col("cx") == F.floor(F.greatest("aw", "bw") / cell)) & (F.col("cy") == F.floor(F.greatest("as", "bs") / cell))
    return both.filter(overlap & corner).select("a", "b")


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """``points(id, x, y)`` and ``polygons(field, ring array<struct<x,y>>)``, a closed ring
    each -> ``(id, field)`` by the even-odd rule. An equi-join on cells, then ray casting."""
    at = lambda c, best: F.floor(best(F.transform("ring", lambda p: p[c])) / cell)
    wide = polygons.withColumn("cx", F.explode(F.sequence(at("x", F.array_min), at("x", F.array_max))))
    wide = wide.withColumn("cy", F.explode(F.sequence(at("y", F.array_min), at("y", F.array_max))))
    near = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell)).join(wide, ["cx", "cy"])
    inside = F.expr("""aggregate(sequence(1, size(ring) - 1), false, (a, i) ->
        a != ((ring[i - 1].y > y) != (ring[i].y > y) and
              x < (ring[i].x - ring[i - 1].x) * (y - ring[i - 1].y) / if(ring[i].y = ring[i - 1].y, 1.0D, ring[i].y - ring[i - 1].y) + ring[i - 1].x))""")
    return near.filter("size(ring) >= 4").filter(inside).select("id", "field")


def pack_mask(cells: DataFrame, side: int = CHUNK) -> DataFrame:
    """True cells ``(iy, ix)`` -> ``(cy, cx, block, bits)``, chunks of ``side`` by ``side`` cells
    (512: eight blocks of bits). A block without a true cell has no row."""
    at = F.pmod("iy", F.lit(side)) * side + F.pmod("ix", F.lit(side))
    rows = cells.select(F.floor(F.col("iy") / side).alias("cy"), F.floor(F.col("ix") / side).alias("cx"), at.cast("long").alias("at"))
    block = F.floor(F.col("at") / BLOCK_BITS).alias("block")
    return rows.groupBy("cy", "cx", block).agg(F.bitmap_construct_agg(F.col("at") % BLOCK_BITS).alias("bits"))


def unpack_mask(packed: DataFrame, side: int = CHUNK) -> DataFrame:
    """The true cells ``(iy, ix)`` of packed chunks."""
    byte = packed.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 8 - 1))))
    byte = byte.withColumn("byte", F.conv(F.hex(F.expr("substring(bits, i + 1, 1)")), 16, 10).cast("int")).filter("byte != 0")
    bit = byte.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(7)))).filter("shiftright(byte, bit) & 1 = 1")
    at = F.col("block") * BLOCK_BITS + F.col("i") * 8 + F.col("bit")
    return bit.select((F.col("cy") * side + F.floor(at / side)).alias("iy"), (F.col("cx") * side + at % side).alias("ix"))


def finest_level(width: Column, height: Column, base: Column | float, ks: list[int], most: int) -> Column:
    """The smallest k whose cells (base * k wide) number at most ``most`` in a box; null where
    even the largest has more."""
    fits = lambda k: F.ceil(width / (base * k)) * F.ceil(height / (base * k)) <= most
    return F.array_min(F.filter(F.array(*[F.lit(k).cast("long") for k in ks]), fits))


def line_pixels(lines: DataFrame) -> DataFrame:
    """``(tile, line array<struct<x,y>>)`` in pixels of a tile -> distinct ``(tile, px, py)``:
    each segment's steps along its longer axis, kept within 256 by 256."""
    parts = lines.select("tile", F.explode(F.arrays_zip(F.slice("line", 1, F.size("line") - 1).alias("a"), F.slice("line", 2, F.size("line") - 1).alias("b"))).alias("s"))
    a, b = F.col("s.a"), F.col("s.b")
    parts = parts.select("tile", a["x"].alias("x"), a["y"].alias("y"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))
    steps = F.greatest(F.ceil(F.abs("dx")), F.ceil(F.abs("dy")), F.lit(1)).cast("int")
    at = parts.withColumn("n", steps).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    spot = lambda c: F.floor(F.col(c) + F.col("d" + c) * F.col("i") / F.col("n")).cast("int").alias("p" + c)
    return at.select("tile", spot("x"), spot("y")).filter("px between 0 and 255 and py between 0 and 255").distinct()
