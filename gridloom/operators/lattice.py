"""Sampling lattices: boxes and sample points of tiles and views, looked up in rasters.

A lattice is a row for each sample, made by exploding two sequences; a look-up is a left
equi-join on the cell that holds the sample, so samples outside a raster keep the default.
Boxes and cells are column expressions: nothing is collected and nothing is a UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

#: The categorical raster's extent in EPSG:5070, the view's size in pixels
#: and its margin, samples of a view along an axis.
RASTER_EXTENT = (-2417835.0, 158265.0, 2387295.0, 3321225.0)
VIEW_WIDTH, VIEW_HEIGHT, VIEW_MARGIN = 1400, 700, 0.35
FEWEST, MOST = 8, 2000
#: Bytes up to which a window is broadcast, and what a cell takes there.
BROADCAST_BYTES, CELL_BYTES = 16 << 20, 32
#: Points on each side of a box whose outline is projected.
SIDE = 9


def tile_box(z: Column, x: Column, y: Column) -> Column:
    """A tile's west, south, east and north."""
    return F.struct(geo.tile_edge_lon(x, z).alias("w"), geo.tile_edge_lat(y + 1, z).alias("s"), geo.tile_edge_lon(x + 1, z).alias("e"), geo.tile_edge_lat(y, z).alias("n"))


def view_box(lon: Column, lat: Column, zoom: Column) -> Column:
    """A camera's box with the margin; zooms count 512 pixels at 0."""
    span = 360.0 / (512 * F.pow(F.lit(2.0), zoom))
    dlon = VIEW_WIDTH * span * (1 + VIEW_MARGIN) / 2
    dlat = VIEW_HEIGHT * span * F.cos(F.radians(lat)) * (1 + VIEW_MARGIN) / 2
    return F.struct((lon - dlon).alias("w"), (lat - dlat).alias("s"), (lon + dlon).alias("e"), (lat + dlat).alias("n"))


def albers_box(box: Column) -> Column:
    """The EPSG:5070 box ``x0, y0, x1, y1`` of a box, within the raster's extent. Parallels
    bow, so SIDE points of every side are projected, not the corners alone."""
    steps = F.sequence(F.lit(0), F.lit(SIDE - 1))
    along = lambda a, b: F.transform(steps, lambda i: box[a] + (box[b] - box[a]) * i / (SIDE - 1))

    def parallel(edge: str) -> Column:
        return F.transform(along("w", "e"), lambda v: F.struct(v.alias("lon"), box[edge].alias("lat")))

    def meridian(edge: str) -> Column:
        return F.transform(along("s", "n"), lambda v: F.struct(box[edge].alias("lon"), v.alias("lat")))

    outline = F.concat(parallel("s"), parallel("n"), meridian("w"), meridian("e"))
    xs = F.transform(outline, lambda p: geo.albers(p["lon"], p["lat"])[0])
    ys = F.transform(outline, lambda p: geo.albers(p["lon"], p["lat"])[1])
    x0, y0, x1, y1 = RASTER_EXTENT
    return F.struct(
        F.greatest(F.array_min(xs), F.lit(x0)).alias("x0"), F.greatest(F.array_min(ys), F.lit(y0)).alias("y0"),
        F.least(F.array_max(xs), F.lit(x1)).alias("x1"), F.least(F.array_max(ys), F.lit(y1)).alias("y1"),
    )


def projected_bounds(box: Column) -> Column:
    """EPSG:5070 bounds ``x0, y0, x1, y1`` that hold every point of a box, within the raster's
    extent or not. A parallel is an arc around the pole, lowest at the central meridian, and
    eastings grow along it; so the corners and the lowest point of the south side are enough."""
    lowest = F.greatest(F.least(F.lit(geo.LON_ORIGIN), box["e"]), box["w"])
    corners = [geo.albers(lon, lat) for lon, lat in ((box["w"], box["s"]), (box["e"], box["s"]), (box["w"], box["n"]), (box["e"], box["n"]), (lowest, box["s"]))]
    xs, ys = ([c[i] for c in corners] for i in (0, 1))
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def raster_window(boxes: DataFrame, pixel: float, box: str = "box") -> tuple[tuple[int, int], tuple[int, int]]:
    """The rows and columns of the raster that some boxes' samples can fall into, one more on
    each side; one row comes to the driver. Without boxes both spans are empty."""
    x0, _, _, y1 = RASTER_EXTENT
    b = boxes.select(projected_bounds(F.col(box)).alias("b")).agg(F.min("b.x0"), F.min("b.y0"), F.max("b.x1"), F.max("b.y1")).head()
    if b[0] is None:
        return (0, -1), (0, -1)
    rows, cols = ((y1 - b[3]) / pixel, (y1 - b[1]) / pixel), ((b[0] - x0) / pixel, (b[2] - x0) / pixel)
    return tuple((int(low) - 1, int(high) + 1) for low, high in (rows, cols))


def grid_window(boxes: DataFrame, factor: int, box: str = "box") -> tuple[tuple[int, int], tuple[int, int]]:
    """The same of the probability grid at a level."""
    b = boxes.agg(F.max(f"{box}.n"), F.min(f"{box}.s"), F.min(f"{box}.w"), F.max(f"{box}.e")).head()
    if b[0] is None:
        return (0, -1), (0, -1)
    size = geo.GRID_CELL * factor
    rows, cols = ((geo.GRID_TOP - b[0]) / size, (geo.GRID_TOP - b[1]) / size), ((b[2] + 180) / size, (b[3] + 180) / size)
    return tuple((math.floor(low) - 1, math.floor(high) + 1) for low, high in (rows, cols))


def cut(cells: DataFrame, window: tuple[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """``cells(iy, ix, ...)`` of a window, however often a cell comes."""
    (y0, y1), (x0, x1) = window
    return cells.filter(F.col("iy").between(y0, y1) & F.col("ix").between(x0, x1))


def within(cells: DataFrame, window: tuple[tuple[int, int], tuple[int, int]], layers: int = 1) -> DataFrame:
    """``cut``, for a join: broadcast if the window's whole area, times the layers that a cell
    may be in, takes BROADCAST_BYTES at most."""
    (y0, y1), (x0, x1) = window
    some = cut(cells, window)
    area = max(0, y1 - y0 + 1) * max(0, x1 - x0 + 1) * layers
    return F.broadcast(some) if area * CELL_BYTES <= BROADCAST_BYTES else some


def samples(boxes: DataFrame, nx: Column, ny: Column, box: str = "box") -> DataFrame:
    """``boxes`` with a row for each sample: its column ``j`` and row ``i`` (from the north),
    ``lon`` and ``lat`` of its centre."""
    at = boxes.withColumn("j", F.explode(F.sequence(F.lit(0), (nx - 1).cast("int")))).withColumn("i", F.explode(F.sequence(F.lit(0), (ny - 1).cast("int"))))
    b = F.col(box)
    return at.withColumn("lon", b["w"] + (F.col("j") + 0.5) * (b["e"] - b["w"]) / nx).withColumn("lat", b["n"] - (F.col("i") + 0.5) * (b["n"] - b["s"]) / ny)


def view_size(box: Column, pixel: Column | float) -> tuple[Column, Column]:
    """Samples of a view along both axes: one a pixel (metres), FEWEST to MOST."""
    wide = (box["e"] - box["w"]) * geo.KM_PER_DEG_LON * 1000 * F.cos(F.radians((box["n"] + box["s"]) / 2))
    high = (box["n"] - box["s"]) * geo.KM_PER_DEG_LAT * 1000
    return tuple(F.greatest(F.least((v / pixel).cast("int"), F.lit(MOST)), F.lit(FEWEST)) for v in (wide, high))


def sample_acres(box: Column, nx: Column, ny: Column) -> Column:
    """The ground area of one sample of a view."""
    return geo.pixel_acres((box["n"] + box["s"]) / 2, (box["e"] - box["w"]) / nx, (box["n"] - box["s"]) / ny)


def look_up(lattice: DataFrame, raster: DataFrame, pixel: float) -> DataFrame:
    """The code ``(iy, ix, code)`` of the raster cell under each sample, 0 outside. The
    raster's origin is the extent's north-west; positions are truncated toward zero."""
    x0, _, _, y1 = RASTER_EXTENT
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    cells = lattice.withColumn("ix", geo.raster_cell(x, x0, pixel)).withColumn("iy", geo.raster_cell(y1 - y, 0.0, pixel))
    return cells.join(raster.select("iy", "ix", "code"), ["iy", "ix"], "left").withColumn("code", F.coalesce("code", F.lit(0))).drop("iy", "ix")


def look_up_field(lattice: DataFrame, fields: DataFrame, factor: int) -> DataFrame:
    """Whether a sample's cell of the probability grid is among ``fields(iy, ix)``; the
    cell's position is floored. Only the cells that are fields are joined."""
    iy, ix = geo.grid_cell(F.col("lon"), F.col("lat"), factor)
    cells = lattice.withColumn("iy", iy).withColumn("ix", ix)
    return cells.join(fields.select("iy", "ix", F.lit(True).alias("field")), ["iy", "ix"], "left").withColumn("field", F.coalesce("field", F.lit(False))).drop("iy", "ix")


def timelapse_level(base: Column, k: Column) -> Column:
    """The level of the 30 m group nearest to a pixel of base * k metres, 1 to 256: a power
    of two, halves to even."""
    exact = F.log2(F.greatest(base * k / 30.0, F.lit(1.0)))
    return F.greatest(F.least(F.pow(F.lit(2.0), F.bround(exact)), F.lit(256.0)), F.lit(1.0)).cast("int")


def mask_level(pixel: Column, factors: tuple[int, ...] = (4, 16, 64, 256), metres: float = 10.0) -> Column:
    """The mask's level for raster pixels of so many metres: the coarsest whose cells are at
    most four thirds of them wide, the finest where none is."""
    widest = F.greatest(pixel * 4 / 3, F.lit(metres * min(factors)))
    return F.array_max(F.filter(F.array(*[F.lit(f) for f in factors]), lambda f: f * metres <= widest))


def nearest_level(ratio: float, ks: list[int]) -> int:
    """The level of a group nearest to samples that are ``ratio`` of its finest pixels wide:
    a power of two, halves to even, within what the group has."""
    return max(min(ks), min(max(ks), 2 ** round(math.log2(max(ratio, 1.0)))))


def timelapse_series(counts: DataFrame, top: DataFrame) -> DataFrame:
    """``counts(year, code, n)`` -> a row for each year in which any of the top codes occurs
    and each top code, 0 where there is none, with its share of the series' peak. Years
    times top codes (at most ten) are few: they are put into one map and dealt out again."""
    seen = counts.join(F.broadcast(top.select("code")), "code", "left_semi")
    by = F.map_from_entries(F.collect_list(F.struct(F.struct("year", "code").alias("k"), F.col("n").alias("v"))))
    whole = seen.agg(F.collect_set("year").alias("years"), F.collect_set("code").alias("codes"), by.alias("by"), F.max("n").alias("peak"))
    filled = whole.withColumn("year", F.explode("years")).withColumn("code", F.explode("codes"))
    n = F.coalesce(F.try_element_at("by", F.struct("year", "code")), F.lit(0)).cast("long")
    return filled.select("year", "code", n.alias("n"), F.round(n / F.greatest("peak", F.lit(1)), 9).alias("height"))


def tile_point(z: Column, x: Column, y: Column, px: Column, py: Column, extent: Column | int) -> tuple[Column, Column]:
    """Longitude and latitude of a point in a vector tile's units."""
    return geo.tile_edge_lon(x + px / extent, z), geo.tile_edge_lat(y + py / extent, z)


def outline_jobs(views: DataFrame, states: DataFrame) -> DataFrame:
    """The outline tiles that views ask for: ``views(id, z, fields, box)``, where fields are
    shown from zoom 12 on, times the states whose box they meet (``states`` is small), times
    the tiles of the box at zoom 13 at most: ``id, state, z, x, y``."""
    b = F.col("box")
    shown = views.filter(F.col("fields") & (F.col("z") >= 12)).withColumn("z", F.least("z", F.lit(13)))
    meets = (b["w"] < F.col("xmax")) & (b["e"] > F.col("xmin")) & (b["s"] < F.col("ymax")) & (b["n"] > F.col("ymin"))
    jobs = shown.join(F.broadcast(states), meets)
    (x0, y0), (x1, y1) = geo.tile_of(b["w"], b["n"], F.col("z")), geo.tile_of(b["e"], b["s"], F.col("z"))
    return jobs.withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("y", F.explode(F.sequence(y0, y1))).select("id", "state", "z", "x", "y")


def whole_status(z: Column, k: Column, base: Column | int, tiles: Column, pixels: Column, drawn: Column, year: Column, fields_year: Column, outlines: Column, fields: Column, disagreement: Column, factor: Column, ms: Column) -> Column:
    """The status line with all its parts. Those on fields and on the disagreement are there
    while these are on; from zoom 12 on outlines are drawn, below it the line says so; a
    disagreement asked for outside 2024 and 2025 isn't there, and the line says that."""
    part = lambda on, text: F.when(on, text).otherwise("")
    able = year.isin(2024, 2025)
    return F.concat(
        F.format_string("z%d · %dx · %d m pixels · %d tiles · %s px · %s drawn · year %d", z, k, base * k, tiles, F.format_number(pixels, 0), F.format_number(drawn, 0), year),
        part(fields, F.format_string(" · FTW %d fields · %d outline tiles", fields_year, F.when(z >= 12, outlines).otherwise(0))),
        part(disagreement & able, F.format_string(" · disagreement vs P(field) at %d m", 10 * factor)),
        part(disagreement & ~able, F.lit(" · disagreement needs 2024 or 2025")),
        part(fields & (z < 12), F.lit(" · outlines from z12")),
        F.format_string(" · %d ms", ms),
    )


def status_line(z: Column, k: Column, tiles: Column, pixels: Column, drawn: Column, year: Column) -> Column:
    return F.format_string("z%d k%d: %d tiles, %s px, %s drawn, %d", z, k, tiles, F.format_number(pixels, 0), F.format_number(drawn, 0), year)


def legend_json(rows: DataFrame, *by: str) -> DataFrame:
    """``code, name, hex, pct`` and, where rows have one, ``note``, in the order of the counts
    ``n`` (descending) and code, as one JSON array a group; a legend has 14 rows at most. A
    column ``place`` sets another order."""
    given = [c for c in ("code", "name", "hex", "pct", "note") if c in rows.columns]
    first = F.col("place") if "place" in rows.columns else -F.col("n")
    sorted_rows = F.array_sort(F.collect_list(F.struct(first.alias("o"), *given)))
    entries = F.transform(sorted_rows, lambda r: F.struct(*[r[c].alias(c) for c in given]))
    return rows.groupBy(*by).agg(F.to_json(entries).alias("legend"))


def disagreement_notes(counts: DataFrame, kinds: DataFrame, fields: bool) -> DataFrame:
    """The legend of the disagreement: all of ``kinds(kind, label, hex)`` in their order, those
    without a cell too, their share of ``counts(kind, n, acres)`` (acres a cell), and a note:
    the area in thousands of acres, or, where fields clip, why kind 2 has none."""
    whole = F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1))
    acres = F.max("acres").over(Window.partitionBy())
    every = F.broadcast(kinds).join(counts, "kind", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    area = F.concat(F.format_number(F.coalesce(F.col("n") * acres, F.lit(0.0)) / 1e3, 1), F.lit("k ac"))
    note = F.when(F.lit(fields) & (F.col("kind") == 2), "turn fields off to see").otherwise(area)
    return every.select(F.col("kind").alias("code"), F.col("label").alias("name"), "hex", F.round(100.0 * F.col("n") / whole, 1).alias("pct"), note.alias("note"), F.col("kind").alias("place"), "n")


def metres_per_pixel(lat: Column, z: Column) -> Column:
    """Ground metres of a pixel of a 256-pixel tile at a latitude and zoom."""
    return 2 * math.pi * geo.SEMI_MAJOR / 256 * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), z)
