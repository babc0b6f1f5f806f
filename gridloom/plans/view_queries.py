"""Queries over levels, palettes and keys as the given tables' rows ask for them, and the same in
DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import lattice as lat
from ..operators import raster as ops
from ..operators import vector
from ..sources import levels, views
from ..streaming import requests
from .field_queries import _LINES, _walks
from .lattice_queries import _edge_sql
from .queries import _TILES, _WITH, _table, _tiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, _WITH + sql
        return f

    return register


@query(""", seen AS (SELECT code, count(*) AS n FROM raster WHERE code NOT IN (0, 81) GROUP BY code), c AS (
  SELECT code, n, name, CAST('0x' || substr(hex, 2, 2) AS INTEGER) AS r, CAST('0x' || substr(hex, 4, 2) AS INTEGER) AS g, CAST('0x' || substr(hex, 6, 2) AS INTEGER) AS b
  FROM seen JOIN classes USING (code)
), d AS (SELECT *, r >= 170 AND g <= 100 AND b <= 110 AS red FROM c)
SELECT code, n, name, r, g, b, CASE WHEN red THEN CAST((row_number() OVER (PARTITION BY red ORDER BY code) - 1) % 8 AS INTEGER) ELSE -1 END AS safe FROM d""")
def palette_of_codes(spark, sf_dir):
    """The codes that the raster shows, with their colours and places in the safe palette."""
    kinds = views.classes(spark)
    seen = ops.histogram(ops.drop_codes(views.raster(spark, sf_dir), kinds, False))
    shown = kinds.join(F.broadcast(seen.select("code")), "code", "left_semi")  # no more codes than classes
    return seen.join(F.broadcast(ops.palette_cycle(shown)), "code").select("code", "n", "name", "r", "g", "b", "safe")


_CENTRE = _edge_sql("y + 0.5e0", "z")


@query(_TILES + f""", v AS (SELECT id, z, CASE WHEN state = 0 THEN 30 ELSE 10 END AS base, {_CENTRE} AS lat FROM tiles), w AS (
  SELECT *, greatest(2 * pi() * 6378137e0 / 256 * cos(radians(lat)) / pow(2e0, z) * 1.4e0 / base, 1) AS want FROM v
), p AS (SELECT *, (SELECT CAST(max(pow(2, i)) AS INTEGER) FROM range(10) t(i) WHERE pow(2, i) <= want) AS k FROM w)
SELECT id, base, k, CASE WHEN 2560 <= greatest(base * k * 4 / 3e0, 40) THEN 256 WHEN 640 <= greatest(base * k * 4 / 3e0, 40) THEN 64 WHEN 160 <= greatest(base * k * 4 / 3e0, 40) THEN 16 ELSE 4 END AS f,
  CAST(greatest(least(pow(2, round_even(log2(greatest(base * k / 30e0, 1e0)), 0)), 256), 1) AS INTEGER) AS years_level FROM p""")
def event_levels(spark, sf_dir):
    """What each requested tile is served from: the raster's level, the mask's, the timelapse's."""
    z, base = F.col("z"), F.when(F.col("state") == 0, 30).otherwise(10)
    middle = geo.tile_edge_lat(F.col("y") + 0.5, z)
    asked = _tiles(spark, sf_dir).select("id", base.alias("base"), lat.metres_per_pixel(middle, z).alias("mpp"))
    picked = asked.withColumn("k", levels.pick_level(F.col("mpp"), F.col("base"), [1 << i for i in range(10)]))
    pixel = (F.col("base") * F.col("k")).cast("double")
    return picked.select("id", "base", "k", lat.mask_level(pixel).alias("f"), lat.timelapse_level(F.col("base"), F.col("k")).alias("years_level"))


@query(""", gone AS (SELECT 0 AS code UNION SELECT 81 UNION SELECT code FROM classes WHERE noncrop)
SELECT year, count(*) AS cells, count(*) FILTER (code IN (SELECT code FROM gone)) AS dropped, count(DISTINCT code) FILTER (code IN (SELECT code FROM gone)) AS codes FROM raster GROUP BY year""")
def dropped_by_year(spark, sf_dir):
    """What crops-only drops in every year: the fixed codes and, joined to them, the classes that
    are no crops."""
    fixed = spark.range(1).select(F.explode(F.array(F.lit(ops.NODATA), F.lit(ops.CLOUDS))).alias("code"))
    gone = fixed.union(views.classes(spark).filter("noncrop").select("code")).distinct().withColumn("gone", F.lit(True))
    cells = views.raster(spark, sf_dir).join(F.broadcast(gone), "code", "left")  # 256 codes at most
    code = F.when(F.col("gone"), F.col("code"))
    return cells.groupBy("year").agg(F.count("*").alias("cells"), F.count(code).alias("dropped"), F.count_distinct(code).alias("codes"))


@query(""" SELECT p_brand AS store, CAST(p_partkey % 256 AS INTEGER) AS code, max(p_name) AS name, '#' || lpad(CAST(max(p_size) AS VARCHAR), 6, '0') AS hex FROM part GROUP BY ALL""")
def stored_attributes(spark, sf_dir):
    """Classes' names and colours of several stores, packed into two JSON maps each, as their
    attributes have them, and read from there."""
    code = (F.col("p_partkey") % 256).cast("int")
    rows = _table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("store"), code.alias("code")).agg(F.max("p_name").alias("name"), F.lpad(F.max("p_size").cast("string"), 6, "0").alias("size"))
    packed = lambda c: F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("code").cast("string"), c))))
    attributes = rows.groupBy("store").agg(packed(F.col("name")).alias("class_names"), packed(F.concat(F.lit("#"), F.col("size"))).alias("class_colors"))
    names, colours = (F.from_json(c, "map<string,string>") for c in ("class_names", "class_colors"))
    read = attributes.select("store", F.explode(names).alias("code", "name"), colours.alias("hex"))
    return read.select("store", F.col("code").cast("int").alias("code"), "name", F.try_element_at("hex", F.col("code")).alias("hex"))


@query(_LINES + """, bounds AS (SELECT id, min(x) AS w, min(y) AS s, max(x) AS e, max(y) AS n FROM vertices GROUP BY id HAVING count(*) >= 2 AND count(*) <= 4),
boxes AS (SELECT s_suppkey AS box, s_suppkey * 7 % 61 / 4e0 AS w, s_suppkey * 5 % 43 / 4e0 AS s FROM supplier)
SELECT box, count(*) AS lines, min(id) AS first FROM boxes x JOIN bounds b ON b.w < x.w + 0.75e0 AND b.e > x.w AND b.s < x.s + 0.5e0 AND b.n > x.s GROUP BY box""")
def lines_in_boxes(spark, sf_dir):
    """Lines whose bounds meet a box, strictly: an equi-join on cells, each pair once."""
    walks = _walks(spark, sf_dir).filter(F.size("line").between(2, 4))
    named = walks.select("id", F.transform("line", lambda p: F.struct(p["x"].alias("lon"), p["y"].alias("lat"))).alias("line"))
    bounds = named.select("id", *vector.bounds("line"))
    k = F.col("s_suppkey")
    west, south = k * 7 % 61 / 4.0, k * 5 % 43 / 4.0
    boxes = _table(spark, sf_dir, "supplier").select(k.alias("id"), west.alias("w"), south.alias("s"), (west + 0.75).alias("e"), (south + 0.5).alias("n"))
    pairs = vector.box_join(boxes, bounds, 2.0)
    return pairs.groupBy(F.col("a").alias("box")).agg(F.count("*").alias("lines"), F.min("b").alias("first"))


@query(_TILES + """, shown AS (SELECT o_orderkey % 9 + 3 AS z, o_custkey % 3 AS state, o_orderkey % 50 AS x0, o_orderkey % 50 + o_custkey % 14 AS x1, o_orderkey % 40 AS y0, o_orderkey % 40 + o_custkey % 11 AS y1 FROM orders),
ahead AS (SELECT z, unnest(range(x0, x1 + 1)) AS x, y, state FROM (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM shown WHERE (x1 - x0 + 1) * (y1 - y0 + 1) <= 80)),
held AS (SELECT c_custkey % 9 + 3 AS z, c_custkey % 50 AS x, c_custkey % 40 AS y, c_nationkey % 3 AS state FROM customer)
SELECT DISTINCT z, x, y, state FROM (SELECT z, x, y, state FROM tiles UNION ALL SELECT z, x, y, state FROM ahead) ANTI JOIN held USING (z, x, y, state)""")
def keys_to_serve(spark, sf_dir):
    """Requested tiles and those of the views on screen, once each, less what a table holds."""
    o, u, c = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_custkey")
    shown = _table(spark, sf_dir, "orders").select((o % 9 + 3).alias("z"), (u % 3).alias("state"), (o % 50).alias("x0"), (o % 50 + u % 14).alias("x1"), (o % 40).alias("y0"), (o % 40 + u % 11).alias("y1"))
    held = _table(spark, sf_dir, "customer").select((c % 9 + 3).alias("z"), (c % 50).alias("x"), (c % 40).alias("y"), (F.col("c_nationkey") % 3).cast("long").alias("state"))
    return requests.missing(_tiles(spark, sf_dir), held, shown)
