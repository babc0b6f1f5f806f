"""Queries over lattices, boxes, levels and sinks, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import lattice as lat
from ..operators import raster as ops
from ..sources import views
from .queries import _FIELDS, _KIND, _POINTS, _TILES, _WITH, _fields, _points, _table, _tiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Metres of a raster cell and the level of the mask, so that the tables' rasters span CONUS.
PIXEL, FACTOR = 30_720.0, 8192
#: One camera for the lattice queries.
CAMERA = (-98.0, 39.0, 3.4)


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = _WITH + sql
        return f

    return register


# SQL fragments.


def _num(v: float) -> str:
    return f"({v!r}e0)" if "e" not in repr(float(v)) else f"({v!r})"


def _albers_sql(lon: str, lat_: str) -> tuple[str, str]:
    e2, e, cone, base = _num(geo.ECC2), _num(geo._E), _num(geo.CONE), _num(geo.BASE)
    s = f"sin(radians({lat_}))"
    q = f"({_num(1 - geo.ECC2)} * ({s} / (1 - {e2} * {s} * {s}) - ln((1 - {e} * {s}) / (1 + {e} * {s})) / (2 * {e})))"
    rho, theta = f"({_num(geo.SEMI_MAJOR)} * sqrt({base} - {cone} * {q}) / {cone})", f"({cone} * radians({lon} - {_num(geo.LON_ORIGIN)}))"
    return f"({rho} * sin({theta}))", f"({_num(geo.RHO0)} - {rho} * cos({theta}))"


def _box_sql(lon: str, lat_: str, zoom: str) -> str:
    span = f"(360e0 / (512 * pow(2e0, {zoom})))"
    dlon, dlat = f"(1400 * {span} * 1.35e0 / 2)", f"(700 * {span} * cos(radians({lat_})) * 1.35e0 / 2)"
    return f"{lon} - {dlon} AS w, {lat_} - {dlat} AS s, {lon} + {dlon} AS e, {lat_} + {dlat} AS n"


def _edge_sql(y: str, z: str) -> str:
    return f"degrees(atan(sinh(pi() * (1 - 2 * ({y}) / pow(2e0, {z})))))"


_VIEWS = _POINTS + f", v AS (SELECT id, zoom, {_box_sql('lon', 'lat', 'zoom')} FROM (SELECT *, 3 + id % 24 / 2e0 AS zoom FROM pts))"


def _views(spark, sf_dir):
    zoom = 3 + F.col("id") % 24 / 2.0
    return _points(spark, sf_dir).select("id", zoom.alias("zoom"), lat.view_box(F.col("lon"), F.col("lat"), zoom).alias("box"))


# Boxes.


@query(_VIEWS + " SELECT id, round(w, 8) AS w, round(s, 8) AS s, round(e, 8) AS e, round(n, 8) AS n FROM v")
def view_boxes(spark, sf_dir):
    return _views(spark, sf_dir).select("id", *[F.round(f"box.{k}", 8).alias(k) for k in "wsen"])


_OUTLINE = """, t AS (SELECT unnest(range(9)) AS i), o AS (
  SELECT id, w + (e - w) * i / 8 AS lon, s AS lat FROM v, t UNION ALL SELECT id, w + (e - w) * i / 8, n FROM v, t
  UNION ALL SELECT id, w, s + (n - s) * i / 8 FROM v, t UNION ALL SELECT id, e, s + (n - s) * i / 8 FROM v, t)"""


@query(_VIEWS + _OUTLINE + """, a AS (SELECT id, {} AS x, {} AS y FROM o)
SELECT id, round(greatest(min(x), -2417835e0), 3) AS x0, round(greatest(min(y), 158265e0), 3) AS y0,
  round(least(max(x), 2387295e0), 3) AS x1, round(least(max(y), 3321225e0), 3) AS y1 FROM a GROUP BY id""".format(*_albers_sql("lon", "lat")))
def albers_box(spark, sf_dir):
    """The projected box of every view, in one projection without a shuffle."""
    boxes = _views(spark, sf_dir).select("id", lat.albers_box(F.col("box")).alias("a"))
    return boxes.select("id", *[F.round(f"a.{k}", 3).alias(k) for k in ("x0", "y0", "x1", "y1")])


_SIZE = """, m AS (SELECT *, (e - w) * 111320e0 * cos(radians((n + s) / 2)) AS wide, (n - s) * 110574e0 AS high FROM v),
sz AS (SELECT *, greatest(least(CAST(trunc(wide / 30) AS INTEGER), 2000), 8) AS nx, greatest(least(CAST(trunc(high / 30) AS INTEGER), 2000), 8) AS ny FROM m)"""


@query(_VIEWS + _SIZE + """ SELECT id, nx, ny, round((e - w) / nx * 111.32e0 * cos(radians((n + s) / 2)) * ((n - s) / ny) * 110.574e0 * 247.10538e0, 6) AS acres FROM sz""")
def pixel_area(spark, sf_dir):
    """Samples of every view along both axes, and the ground area of one."""
    box = F.col("box")
    nx, ny = lat.view_size(box, 30.0)
    return _views(spark, sf_dir).select("id", nx.alias("nx"), ny.alias("ny"), F.round(lat.sample_acres(box, nx, ny), 6).alias("acres"))


# Lattices.


_TILE_LATTICE = f""", b AS (SELECT x, y, x / 16e0 * 360 - 180 AS w, (x + 1) / 16e0 * 360 - 180 AS e, {_edge_sql('y + 1', '4')} AS s, {_edge_sql('y', '4')} AS n
  FROM (SELECT unnest(range(2, 5)) AS x), (SELECT unnest(range(5, 7)) AS y)),
l AS (SELECT x, y, j, i, w + (j + 0.5e0) * (e - w) / 64 AS lon, n - (i + 0.5e0) * (n - s) / 64 AS lat FROM b, (SELECT unnest(range(64)) AS j), (SELECT unnest(range(64)) AS i))"""
_CELLS = """, c AS (SELECT *, CAST(trunc(({0} + 2417835e0) / 30720e0) AS BIGINT) AS cx, CAST(trunc((3321225e0 - {1}) / 30720e0) AS BIGINT) AS cy,
  CAST(floor((83.748345e0 - lat) / (8.98311982e-05 * 8192)) AS BIGINT) AS fy, CAST(floor((lon + 180) / (8.98311982e-05 * 8192)) AS BIGINT) AS fx FROM l)""".format(*_albers_sql("lon", "lat"))


def _lattice_fields(spark, sf_dir, window=None):
    """The cells of the probability grid that are fields; a window's rows reach the scan."""
    if window is None:
        return views.probability(spark, sf_dir).filter(ops.in_field())
    return lat.within(views.probability(spark, sf_dir, window[0]).filter(ops.in_field()), window)


def _raster_within(spark, sf_dir, years, window):
    """The raster in a window, whose rows reach the scan."""
    some = views.stored_rows(views.raster(spark, sf_dir, years), window[0])
    return lat.within(some, window, len(years))


@query(_TILE_LATTICE + _CELLS + """ SELECT c.x, c.y, c.j, c.i, coalesce(r.code, 0) AS code, coalesce(f.field, false) AS field FROM c
LEFT JOIN (SELECT iy, ix, code FROM raster WHERE year = 2025) r ON r.iy = c.cy AND r.ix = c.cx LEFT JOIN field f ON f.iy = c.fy AND f.ix = c.fx""")
def lattice_lookup(spark, sf_dir):
    """Tiles' pixel centres, the raster cell and the mask cell under each: truncated and
    floored positions, 0 and false outside. Both grids are read in the tiles' window only."""
    z, x, y = F.lit(4), F.col("x"), F.col("y")
    tiles = spark.range(2, 5).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(5), F.lit(6))).alias("y")).withColumn("box", lat.tile_box(z, x, y))
    raster = _raster_within(spark, sf_dir, [2025], lat.raster_window(tiles, PIXEL))
    found = lat.look_up(lat.samples(tiles, F.lit(64), F.lit(64)), raster, PIXEL)
    fields = _lattice_fields(spark, sf_dir, lat.grid_window(tiles, FACTOR))
    return lat.look_up_field(found, fields, FACTOR).select("x", "y", "j", "i", "code", "field")


_VIEW_LATTICE = f""", v AS (SELECT {_box_sql(_num(CAMERA[0]), _num(CAMERA[1]), _num(CAMERA[2]))}),
m AS (SELECT *, (e - w) * 111320e0 * cos(radians((n + s) / 2)) AS wide, (n - s) * 110574e0 AS high FROM v),
sz AS (SELECT *, greatest(least(CAST(trunc(wide / 30720e0) AS INTEGER), 2000), 8) AS nx, greatest(least(CAST(trunc(high / 30720e0) AS INTEGER), 2000), 8) AS ny FROM m),
l AS (SELECT j, i, nx, ny, (e - w) / nx * 111.32e0 * cos(radians((n + s) / 2)) * ((n - s) / ny) * 110.574e0 * 247.10538e0 AS acres,
  w + (j + 0.5e0) * (e - w) / nx AS lon, n - (i + 0.5e0) * (n - s) / ny AS lat FROM sz, (SELECT unnest(range(2000)) AS j), (SELECT unnest(range(2000)) AS i) WHERE j < nx AND i < ny)""" + _CELLS


def _sized_view(spark):
    """CAMERA's view with its samples along both axes and the ground area of one."""
    box = F.col("box")
    view = spark.range(1).select(lat.view_box(*[F.lit(v) for v in CAMERA]).alias("box"))
    nx, ny = lat.view_size(box, PIXEL)
    return view.withColumn("nx", nx).withColumn("ny", ny).withColumn("acres", lat.sample_acres(box, F.col("nx"), F.col("ny")))


def _view_lattice(spark):
    """The samples of CAMERA's view, with the ground area of one."""
    return lat.samples(_sized_view(spark), F.col("nx"), F.col("ny")).drop("box")


@query(_VIEW_LATTICE + " SELECT nx, ny, count(*) AS samples, round(min(acres), 3) AS acres, round(min(lon), 8) AS west, round(max(lat), 8) AS north FROM c GROUP BY nx, ny")
def view_lattice(spark, sf_dir):
    every = _view_lattice(spark).groupBy("nx", "ny")
    return every.agg(F.count("*").alias("samples"), F.round(F.min("acres"), 3).alias("acres"), F.round(F.min("lon"), 8).alias("west"), F.round(F.max("lat"), 8).alias("north"))


_SAMPLED = _VIEW_LATTICE + ", h AS (SELECT r.year, r.code, count(*) AS n, min(c.acres) AS acres FROM c JOIN raster r ON r.iy = c.cy AND r.ix = c.cx JOIN field f ON f.iy = c.fy AND f.ix = c.fx AND f.field WHERE r.code > 0 GROUP BY ALL)"


def _sampled(spark, sf_dir, years):
    """Counts by year and code over the view's samples that are fields, from its window."""
    view = _sized_view(spark)
    fields = _lattice_fields(spark, sf_dir, lat.grid_window(view, FACTOR))
    clipped = lat.look_up_field(_view_lattice(spark), fields, FACTOR).filter("field")
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    cells = clipped.withColumn("ix", geo.raster_cell(x, lat.RASTER_EXTENT[0], PIXEL)).withColumn("iy", geo.raster_cell(lat.RASTER_EXTENT[3] - y, 0.0, PIXEL))
    raster = _raster_within(spark, sf_dir, years, lat.raster_window(view, PIXEL))
    found = cells.join(raster, ["iy", "ix"]).filter("code > 0")  # outside is 0, which isn't counted
    return found.groupBy("year", "code").agg(F.count("*").alias("n"), F.min("acres").alias("acres"))


@query(_SAMPLED + ", t AS (SELECT * FROM h WHERE year = 2025 AND code <> 81 ORDER BY n DESC, code LIMIT 10) SELECT code, name, n, round(n * acres, 1) AS acres, round(100e0 * n / sum(n) OVER (), 6) AS pct FROM t JOIN classes USING (code)")
def analyze_lattice(spark, sf_dir):
    """The view's top classes within fields, over samples; shares of what is listed."""
    top = _sampled(spark, sf_dir, [2025]).filter("code != 81").orderBy(F.desc("n"), "code").limit(10)
    named = top.join(F.broadcast(views.classes(spark)), "code")
    share = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6)
    return named.select("code", "name", "n", F.round(F.col("n") * F.col("acres"), 1).alias("acres"), share.alias("pct"))


@query(_SAMPLED + """, t AS (SELECT code FROM h WHERE year = 2025 AND code <> 81 ORDER BY n DESC, code LIMIT 6), s AS (SELECT year, code, n FROM h JOIN t USING (code)),
g AS (SELECT year, code FROM (SELECT DISTINCT year FROM s), (SELECT DISTINCT code FROM s))
SELECT year, code, coalesce(n, 0) AS n, round(coalesce(n, 0) / CAST((SELECT greatest(max(n), 1) FROM s) AS DOUBLE), 9) AS height FROM g LEFT JOIN s USING (year, code)""")
def timelapse_series(spark, sf_dir):
    """All years' counts of the current top six (after the drop list) over the same samples
    and mask, filled with zeros, with the height in the chart."""
    counts = _sampled(spark, sf_dir, views.YEARS)
    top = counts.filter("year = 2025 and code != 81").orderBy(F.desc("n"), "code").limit(6)
    return lat.timelapse_series(counts.select("year", "code", "n"), top)


@query(", b AS (SELECT base, CAST(pow(2, i) AS BIGINT) AS k FROM (SELECT unnest([10, 30]) AS base), (SELECT unnest(range(10)) AS i)), e AS (SELECT *, log2(greatest(base * k / 30e0, 1e0)) AS x FROM b) SELECT base, k, CAST(greatest(least(pow(2, round_even(x, 0)), 256), 1) AS INTEGER) AS level FROM e")
def timelapse_level(spark, sf_dir):
    rows = spark.range(10).select(F.pow(F.lit(2.0), F.col("id")).cast("long").alias("k"), F.explode(F.array(F.lit(10), F.lit(30))).alias("base"))
    return rows.select("base", "k", lat.timelapse_level(F.col("base"), F.col("k")).alias("level"))


@query(""", p1 AS (SELECT 1 AS k, year, iy AS ry, ix AS rx, code FROM raster WHERE year >= 2024),
p2 AS (SELECT 2 AS k, year, ry, rx, arg_max(code, n * 1000 - code) AS code FROM (SELECT year, iy // 2 AS ry, ix // 2 AS rx, code, count(*) AS n FROM raster WHERE year >= 2024 GROUP BY ALL) GROUP BY ALL),
p4 AS (SELECT 4 AS k, year, ry, rx, arg_max(code, n * 1000 - code) AS code FROM (SELECT year, iy // 4 AS ry, ix // 4 AS rx, code, count(*) AS n FROM raster WHERE year >= 2024 GROUP BY ALL) GROUP BY ALL)
SELECT 30 AS grp, k, year, 30 * k AS px_m, count(*) AS cells, count(DISTINCT code) AS codes FROM (FROM p1 UNION ALL FROM p2 UNION ALL FROM p4) GROUP BY k, year""")
def level_registry(spark, sf_dir):
    """The levels of a group: each a raster of its own pixel, by level and year."""
    fine = views.raster(spark, sf_dir, [2024, 2025])
    levels = fine.select(F.lit(1).alias("k"), "year", F.col("iy").alias("ry"), F.col("ix").alias("rx"), "code")
    for k in (2, 4):
        levels = levels.unionByName(ops.majority_pyramid(fine, k).withColumn("k", F.lit(k)))
    counts = levels.groupBy("k", "year").agg(F.count("*").alias("cells"), F.count_distinct("code").alias("codes"))
    return counts.select(F.lit(30).alias("grp"), "k", "year", (30 * F.col("k")).alias("px_m"), "cells", "codes")


# Outlines.


_STATES = ", st AS (SELECT CAST(s_suppkey AS BIGINT) AS state, -125e0 + s_suppkey % 50 AS xmin, 25e0 + (s_suppkey * 91 % 2400) / 100e0 AS ymin FROM supplier WHERE s_suppkey < 60)"


def _states(spark, sf_dir):
    """At most 60 extents of two by two degrees."""
    k = F.col("s_suppkey")
    corner = _table(spark, sf_dir, "supplier").filter("s_suppkey < 60").select(k.cast("long").alias("state"), (-125.0 + k % 50).alias("xmin"), (25.0 + (k * 91 % 2400) / 100.0).alias("ymin"))
    return corner.withColumn("xmax", F.col("xmin") + 2).withColumn("ymax", F.col("ymin") + 2)


def _tile_sql(lon: str, lat_: str, z: str) -> tuple[str, str]:
    n, rad = f"pow(2e0, {z})", f"radians(greatest(least({lat_}, 85.05e0), -85.05e0))"
    x, y = f"CAST(trunc(({lon} + 180) / 360 * {n}) AS BIGINT)", f"CAST(trunc((1 - ln(tan({rad}) + 1 / cos({rad})) / pi()) / 2 * {n}) AS BIGINT)"
    top = f"CAST({n} - 1 AS BIGINT)"
    return tuple(f"greatest(least({v}, {top}), 0)" for v in (x, y))


_SHOWN = _POINTS + f", v AS (SELECT id, zoom, least(zoom, 13) AS z, id % 2 = 0 AS fields, {_box_sql('lon', 'lat', 'zoom')} FROM (SELECT *, 10 + id % 6 AS zoom FROM pts))" + _STATES


@query(_SHOWN + ", j AS (SELECT id, state, z, {0} AS x0, {1} AS y0, {2} AS x1, {3} AS y1 FROM v, st WHERE fields AND zoom >= 12 AND w < xmin + 2 AND e > xmin AND s < ymin + 2 AND n > ymin) SELECT id, state, z, unnest(range(x0, x1 + 1)) AS x, y FROM (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM j)".format(*_tile_sql("w", "n", "z"), *_tile_sql("e", "s", "z")))
def outline_jobs(spark, sf_dir):
    zoom = 10 + F.col("id") % 6
    shown = _points(spark, sf_dir).select("id", zoom.alias("z"), (F.col("id") % 2 == 0).alias("fields"), lat.view_box(F.col("lon"), F.col("lat"), zoom).alias("box"))
    return lat.outline_jobs(shown, _states(spark, sf_dir))


@query(_TILES + ", q AS (SELECT id, z, x, y, id * 37 % 4096 AS px, id * 101 % 4096 AS py FROM tiles) SELECT id, round((x + px / 4096e0) / pow(2e0, z) * 360 - 180, 9) AS lon, round(" + _edge_sql("y + py / 4096e0", "z") + ", 9) AS lat FROM q")
def tile_points(spark, sf_dir):
    """Points in vector tiles' units to longitude and latitude."""
    i = F.col("id")
    lon, lat_ = lat.tile_point(F.col("z"), F.col("x"), F.col("y"), i * 37 % 4096, i * 101 % 4096, 4096)
    return _tiles(spark, sf_dir).select("id", F.round(lon, 9).alias("lon"), F.round(lat_, 9).alias("lat"))


@query(_TILES + _STATES + f", b AS (SELECT id, x / pow(2e0, z) * 360 - 180 AS w, (x + 1) / pow(2e0, z) * 360 - 180 AS e, {_edge_sql('y + 1', 'z')} AS s, {_edge_sql('y', 'z')} AS n FROM tiles) SELECT id, min(state) AS held_by FROM b JOIN st ON w >= xmin AND e <= xmin + 2 AND s >= ymin AND n <= ymin + 2 GROUP BY id")
def containment_reuse(spark, sf_dir):
    """Requests that a box fetched earlier holds whole, and the first such box."""
    held = F.broadcast(_states(spark, sf_dir))  # at most 60 boxes
    tiles = _tiles(spark, sf_dir).select("id", lat.tile_box(F.col("z"), F.col("x"), F.col("y")).alias("b"))
    inside = (F.col("b.w") >= F.col("xmin")) & (F.col("b.e") <= F.col("xmax")) & (F.col("b.s") >= F.col("ymin")) & (F.col("b.n") <= F.col("ymax"))
    return tiles.join(held, inside).groupBy("id").agg(F.min("state").alias("held_by"))


# Places, batches, sinks.


@query(""", p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS city, CASE WHEN c_custkey % 3 = 0 THEN 'S' || c_nationkey END AS state, c_custkey % 700 / 100e0 AS d FROM customer)
SELECT id, coalesce(nullif(concat_ws(', ', nullif(name, ''), city, state), ''), 'query') AS label,
  round(greatest(least(CASE WHEN id % 11 = 0 THEN 10e0 ELSE log2(360e0 * (1400 / 512e0) / greatest(d, d, 0.01e0)) - 0.3e0 END, 13.5e0), 3.5e0), 9) AS zoom FROM p""")
def geocode_zoom(spark, sf_dir):
    """A place's label and the zoom that its extent asks for."""
    k, d = F.col("c_custkey"), F.col("c_custkey") % 700 / 100.0
    name, city, state = F.when(k % 7 == 0, "").otherwise(F.col("c_name")), F.when(k % 5 != 0, F.col("c_mktsegment")), F.when(k % 3 == 0, F.concat(F.lit("S"), F.col("c_nationkey").cast("string")))
    west = F.when(k % 11 != 0, F.lit(0.0))
    return _table(spark, sf_dir, "customer").select(k.alias("id"), geo.place_label(name, city, state, F.lit("query")).alias("label"), F.round(geo.span_zoom(west, d / 2, d, F.lit(0.0)), 9).alias("zoom"))


@query(_TILES + f""", b AS (SELECT *, x / pow(2e0, z) * 360 - 180 AS w, (x + 1) / pow(2e0, z) * 360 - 180 AS e, {_edge_sql('y + 1', 'z')} AS s, {_edge_sql('y', 'z')} AS n FROM tiles),
held AS (SELECT DISTINCT 3 + user_id % 13 AS z, user_id % 64 // 4 AS cx, user_id % 48 // 4 AS cy FROM events WHERE event_type = 'view')
SELECT z, state, round(min(w), 8) AS w, round(min(s), 8) AS s, round(max(e), 8) AS e, round(max(n), 8) AS n,
  min(x // 512) FILTER (misses) AS cx0, max(x // 512) FILTER (misses) AS cx1, min(y // 512) FILTER (misses) AS cy0, max(y // 512) FILTER (misses) AS cy1,
  count(*) AS requests, count(DISTINCT x * 65536 + y) AS tiles, count(*) FILTER (misses) AS misses
FROM (SELECT b.*, k.cx IS NULL AS misses FROM b LEFT JOIN held k ON k.z = b.z AND k.cx = b.x // 512 AND k.cy = b.y // 512) GROUP BY z, state""")
def batch_summary(spark, sf_dir):
    """A batch's union box, its tiles and misses, and the bounds of the chunks that an earlier
    batch's table doesn't hold: of these alone, along both axes."""
    x, y, u = F.col("x"), F.col("y"), F.col("user_id")
    boxes = _tiles(spark, sf_dir).withColumn("b", lat.tile_box(F.col("z"), x, y)).withColumn("cx", F.floor(x / 512)).withColumn("cy", F.floor(y / 512))
    earlier = _table(spark, sf_dir, "events").filter("event_type = 'view'")
    held = earlier.select((3 + u % 13).alias("z"), F.floor(u % 64 / 4).alias("cx"), F.floor(u % 48 / 4).alias("cy"), F.lit(True).alias("held")).distinct()
    told = boxes.join(held, ["z", "cx", "cy"], "left").withColumn("misses", F.col("held").isNull())
    edges = [F.round(f(f"b.{k}"), 8).alias(k) for k, f in (("w", F.min), ("s", F.min), ("e", F.max), ("n", F.max))]
    missed = lambda f, c: f(F.when(F.col("misses"), F.col(c)))
    chunks = [missed(f, c).alias(f"{c}{i}") for c in ("cx", "cy") for i, f in enumerate((F.min, F.max))]
    tiles = F.count_distinct(x * 65536 + y).alias("tiles")
    return told.groupBy("z", "state").agg(*edges, *chunks, F.count("*").alias("requests"), tiles, F.count_if("misses").alias("misses"))


@query(""", h AS (SELECT year, code, count(*) AS n FROM raster WHERE year >= 2024 AND code NOT IN (0, 81) GROUP BY ALL),
s AS (SELECT *, round(100e0 * n / sum(n) OVER (PARTITION BY year), 1) AS pct, row_number() OVER (PARTITION BY year ORDER BY n DESC, code) AS rn FROM h)
SELECT year, CAST(to_json(list({'code': code, 'name': name, 'hex': hex, 'pct': pct} ORDER BY n DESC, code)) AS VARCHAR) AS legend FROM s JOIN classes USING (code) WHERE rn <= 14 GROUP BY year""")
def legend_json(spark, sf_dir):
    """Each year's legend as the text that a client reads."""
    kinds = views.classes(spark)
    counts = ops.drop_codes(views.raster(spark, sf_dir, [2024, 2025]), kinds, False).filter("code > 0").groupBy("year", "code").agg(F.count("*").alias("n"))
    year = Window.partitionBy("year")
    shares = counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(year), 1)).withColumn("rn", F.row_number().over(year.orderBy(F.desc("n"), "code")))
    return lat.legend_json(shares.filter("rn <= 14").join(F.broadcast(kinds), "code"), "year")


@query(_TILES + ", m AS (SELECT state, id, 'z' || z || ' k' || (1 + x % 4) || ': ' || (y % 80) || ' tiles, ' || format('{:,}', x * 1000) || ' px, ' || format('{:,}', y * 1000) || ' drawn, ' || (2008 + id % 18) AS line FROM tiles) SELECT state, max(id) AS id, arg_max(line, id) AS status FROM m GROUP BY state")
def last_status(spark, sf_dir):
    """The newest status line of every state."""
    x, y = F.col("x"), F.col("y")
    line = lat.status_line(F.col("z"), 1 + x % 4, y % 80, x * 1000, y * 1000, 2008 + F.col("id") % 18)
    return _tiles(spark, sf_dir).select("state", "id", line.alias("line")).groupBy("state").agg(F.max("id").alias("id"), F.max_by("line", "id").alias("status"))


@query(" SELECT code, name, hex FROM classes WHERE code % 3 <> 1")
def class_attributes(spark, sf_dir):
    """Names and colours from a store's attributes, two JSON maps keyed by the code's text."""
    some = views.classes(spark).filter("code % 3 != 1")
    packed = lambda c: F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("code").cast("string"), c))))
    attrs = some.agg(packed("name").alias("class_names"), packed("hex").alias("class_colors"))
    read = attrs.select(F.explode(F.from_json("class_names", "map<string,string>")).alias("code", "name"), F.from_json("class_colors", "map<string,string>").alias("hex"))
    return read.select(F.col("code").cast("int").alias("code"), "name", F.try_element_at("hex", F.col("code")).alias("hex"))


@query(" SELECT 0 AS code UNION SELECT 81 UNION SELECT code FROM classes WHERE noncrop")
def drop_list(spark, sf_dir):
    return spark.range(1).select(F.explode(F.array(F.lit(0), F.lit(81))).alias("code")).union(views.classes(spark).filter("noncrop").select("code")).distinct()


@query(_KIND + """ SELECT kind, label, hex, n FROM h JOIN (VALUES (1, 'both', '#1a9850'), (2, 'crop only', '#d73027'), (3, 'field only', '#4575b4')) d(kind, label, hex) USING (kind)""")
def disagreement_colours(spark, sf_dir):
    """Counts of the disagreement classes with their labels and colours."""
    kinds = views.classes(spark)
    cells = ops.with_field(ops.drop_codes(views.raster(spark, sf_dir, [2024]), kinds, False), views.probability(spark, sf_dir))
    colours = spark.sql("SELECT * FROM VALUES (1, 'both', '#1a9850'), (2, 'crop only', '#d73027'), (3, 'field only', '#4575b4') AS d(kind, label, hex)")
    return ops.histogram(ops.disagreement(cells, kinds), "kind").join(F.broadcast(colours), "kind").select("kind", "label", "hex", "n")


# Fields.


@query(_FIELDS + ", r AS (SELECT fy, fx, code, n, row_number() OVER (PARTITION BY fy, fx ORDER BY n DESC, code) AS rn FROM c), w AS (SELECT * FROM f ORDER BY most / CAST(total AS DOUBLE), fy, fx LIMIT 20) SELECT fy, fx, round(most / CAST(total AS DOUBLE), 9) AS purity, a.code AS first, b.code AS second FROM w JOIN r a USING (fy, fx) LEFT JOIN (SELECT * FROM r WHERE rn = 2) b USING (fy, fx) WHERE a.rn = 1")
def least_pure(spark, sf_dir):
    """The twenty least pure fields and the two crops that they merge."""
    px = views.raster(spark, sf_dir, [2025]).filter("code > 0").select(F.floor(F.col("iy") / 10).alias("fy"), F.floor(F.col("ix") / 10).alias("fx"), "code")
    counts = px.groupBy("fy", "fx", "code").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rn", F.row_number().over(Window.partitionBy("fy", "fx").orderBy(F.desc("n"), "code")))
    two = ranked.groupBy("fy", "fx").agg((F.max("n") / F.sum("n")).alias("purity"), F.max(F.when(F.col("rn") == 1, F.col("code"))).alias("first"), F.max(F.when(F.col("rn") == 2, F.col("code"))).alias("second"))
    return two.orderBy("purity", "fy", "fx").limit(20).select("fy", "fx", F.round("purity", 9).alias("purity"), "first", "second")


@query(_FIELDS + " SELECT count(*) AS fields, round(avg(most / CAST(total AS DOUBLE)), 9) AS mean, round(median(most / CAST(total AS DOUBLE)), 9) AS median, count(*) FILTER (most < 0.6e0 * total) AS mixed FROM f")
def purity_bands(spark, sf_dir):
    purity = F.col("most") / F.col("total")
    return _fields(spark, sf_dir).agg(F.count("*").alias("fields"), F.round(F.avg(purity), 9).alias("mean"), F.round(F.median(purity), 9).alias("median"), F.count_if(F.col("most") < 0.6 * F.col("total")).alias("mixed"))


@query(_FIELDS + " SELECT code, count(*) AS fields, CAST(sum(total) AS BIGINT) AS pixels, round(avg(total), 6) AS mean FROM f GROUP BY code")
def field_size_by_crop(spark, sf_dir):
    return _fields(spark, sf_dir).groupBy("code").agg(F.count("*").alias("fields"), F.sum("total").alias("pixels"), F.round(F.avg("total"), 6).alias("mean"))


@query(" SELECT count(*) AS cells, count(CASE WHEN NOT isnan(p) THEN p END) AS known FROM probability")
def confidence_nonnull(spark, sf_dir):
    return views.probability(spark, sf_dir).agg(F.count("*").alias("cells"), F.count(F.when(~F.isnan("p"), F.col("p"))).alias("known"))


@query(_FIELDS + ", y AS (SELECT iy // 10 AS fy, ix // 10 AS fx, year, code, count(*) AS n FROM raster WHERE year >= 2023 AND code > 0 GROUP BY ALL), t AS (SELECT fy, fx, year, arg_max(code, n * 1000 - code) AS code FROM y GROUP BY ALL) SELECT year, count(*) AS fields, count(*) FILTER (t.code = f.code) AS same FROM t JOIN f USING (fy, fx) GROUP BY year")
def view_chain(spark, sf_dir):
    """Temporary views, each made from the one before: pixels, fields by year, and how many
    fields had the crop of 2025 then."""
    pixels, counts, fields = (f"chain_{step}_{uuid.uuid4().hex}" for step in ("pixels", "counts", "fields"))
    views.raster(spark, sf_dir, range(2023, 2026)).createOrReplaceTempView(pixels)
    spark.sql(f"CREATE OR REPLACE TEMP VIEW {counts} AS SELECT iy DIV 10 AS fy, ix DIV 10 AS fx, year, code, count(*) AS n FROM {pixels} WHERE code > 0 GROUP BY ALL")
    spark.sql(f"CREATE OR REPLACE TEMP VIEW {fields} AS SELECT fy, fx, year, max_by(code, n * 1000 - code) AS code FROM {counts} GROUP BY ALL")
    same = "SELECT a.year, count(*) AS fields, count_if(a.code = b.code) AS same"
    found = spark.sql(f"{same} FROM {fields} a JOIN {fields} b ON a.fy = b.fy AND a.fx = b.fx AND b.year = 2025 GROUP BY a.year")
    for name in (fields, counts, pixels):  # the plan has them by now
        spark.catalog.dropTempView(name)
    return found
