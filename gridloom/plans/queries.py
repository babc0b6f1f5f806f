"""Queries over the raster views of ``sources.views``, and the same in DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import raster as ops
from ..sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_WITH = f"WITH {views.SQL}"


def query(sql: str | None = None, with_views: bool = True):
    """Register a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (_WITH if with_views else "WITH one AS (SELECT 1)") + sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(" SELECT iy, ix, code FROM raster WHERE year = 2024 AND iy BETWEEN 2 AND 60 AND ix BETWEEN 10 AND 90")
def window_scan(spark, sf_dir):
    rows = (2, 60)
    stored = views.stored_rows(views.raster(spark, sf_dir, [2024]), rows)  # reaches the scan; the cell filter can't
    return ops.window_scan(stored, 2024, rows, (10, 90)).select("iy", "ix", "code")


@query(" SELECT code, count(*) AS n FROM raster WHERE year = 2025 AND code NOT IN (0, 81) GROUP BY code")
def drop_list_histogram(spark, sf_dir):
    return ops.histogram(ops.drop_codes(views.raster(spark, sf_dir, [2025]), views.classes(spark), False))


@query(""", h AS (SELECT code, count(*) AS n FROM raster WHERE year = 2025 AND code NOT IN (0, 81) GROUP BY code),
s AS (SELECT *, round(100.0e0 * n / sum(n) OVER (), 1) AS pct FROM h),
t AS (SELECT * FROM s ORDER BY n DESC, code LIMIT 14)
SELECT code, name, hex, n, pct FROM t JOIN classes USING (code)""")
def legend_top14(spark, sf_dir):
    kinds = views.classes(spark)
    return ops.legend(ops.histogram(ops.drop_codes(views.raster(spark, sf_dir, [2025]), kinds, False)), kinds)


@query(""", h AS (SELECT code, count(*) AS n FROM raster JOIN classes USING (code) WHERE year = 2025 AND code NOT IN (0, 81) AND NOT noncrop GROUP BY code)
SELECT code, n FROM h""")
def crops_only_histogram(spark, sf_dir):
    return ops.histogram(ops.drop_codes(views.raster(spark, sf_dir, [2025]), views.classes(spark), True))


_PALETTE = """, c AS (SELECT code, name, noncrop, CAST('0x' || substr(hex, 2, 2) AS INTEGER) AS r, CAST('0x' || substr(hex, 4, 2) AS INTEGER) AS g,
  CAST('0x' || substr(hex, 6, 2) AS INTEGER) AS b FROM classes), d AS (SELECT *, r >= 170 AND g <= 100 AND b <= 110 AS red FROM c)
SELECT code, name, noncrop, r, g, b, CASE WHEN red THEN CAST((row_number() OVER (PARTITION BY red ORDER BY code) - 1) % 8 AS INTEGER) ELSE -1 END AS safe FROM d"""


@query(_PALETTE)
def class_dimension(spark, sf_dir):
    return ops.palette_cycle(views.classes(spark))


_POINTS = ", pts AS (SELECT s_suppkey AS id, -125e0 + (s_suppkey * 37 % 5800) / 100e0 AS lon, 25e0 + (s_suppkey * 91 % 2400) / 100e0 AS lat FROM supplier)"


def _points(spark, sf_dir):
    k = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(k.alias("id"), (-125.0 + (k * 37 % 5800) / 100.0).alias("lon"), (25.0 + (k * 91 % 2400) / 100.0).alias("lat"))


_E = repr(math.sqrt(geo.ECC2))
_ALBERS = f""", s AS (SELECT *, sin(radians(lat)) AS s FROM pts),
q AS (SELECT *, (1 - {geo.ECC2}e0) * (s / (1 - {geo.ECC2}e0 * s * s) - ln((1 - {_E}e0 * s) / (1 + {_E}e0 * s)) / (2 * {_E}e0)) AS q FROM s),
xy AS (SELECT id, lon, lat, {geo.SEMI_MAJOR}e0 * sqrt({geo.BASE!r}e0 - {geo.CONE!r}e0 * q) / {geo.CONE!r}e0 AS rho, {geo.CONE!r}e0 * radians(lon + 96e0) AS t FROM q)"""


@query(_POINTS + _ALBERS + f" SELECT id, round(rho * sin(t), 4) AS x, round({geo.RHO0!r}e0 - rho * cos(t), 4) AS y FROM xy")
def albers_forward(spark, sf_dir):
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    return _points(spark, sf_dir).select("id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query(_POINTS + ", z AS (SELECT unnest(range(3, 16)) AS z) SELECT id, z, CAST(trunc((lon + 180) / 360 * pow(2, z)) AS BIGINT) AS x, CAST(trunc((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, z)) AS BIGINT) AS y FROM pts, z")
def lonlat_to_tile(spark, sf_dir):
    x, y = geo.tile_of(F.col("lon"), F.col("lat"), F.col("z"))
    return _points(spark, sf_dir).withColumn("z", F.explode(F.sequence(F.lit(3).cast("long"), F.lit(15).cast("long")))).select("id", "z", x.alias("x"), y.alias("y"))


_TILES = ", tiles AS (SELECT event_id AS id, 3 + event_id % 13 AS z, (event_id * 7919) % CAST(pow(2, 3 + event_id % 13) AS BIGINT) AS x, (event_id * 104729) % CAST(pow(2, 3 + event_id % 13) AS BIGINT) AS y, user_id % 3 AS state, ts FROM events)"


def _tiles(spark, sf_dir):
    i = F.col("event_id")
    z = 3 + i % 13
    n = F.pow(F.lit(2.0), z).cast("long")
    return _table(spark, sf_dir, "events").select(i.alias("id"), z.alias("z"), (i * 7919 % n).alias("x"), (i * 104729 % n).alias("y"), (F.col("user_id") % 3).alias("state"), "ts")


@query(_TILES + " SELECT id, round(x / pow(2, z) * 360 - 180, 8) AS w, round((x + 1) / pow(2, z) * 360 - 180, 8) AS e, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2, z))))), 8) AS s, round(degrees(atan(sinh(pi() * (1 - 2 * y / pow(2, z))))), 8) AS n FROM tiles")
def tile_bounds(spark, sf_dir):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    edges = {"w": geo.tile_edge_lon(x, z), "e": geo.tile_edge_lon(x + 1, z), "s": geo.tile_edge_lat(y + 1, z), "n": geo.tile_edge_lat(y, z)}
    return _tiles(spark, sf_dir).select("id", *[F.round(c, 8).alias(k) for k, c in edges.items()])


_LEVELS = """, zl AS (SELECT z, lat FROM (SELECT unnest(range(3, 16)) AS z), (SELECT unnest([25e0, 31e0, 38e0, 45e0]) AS lat)),
m AS (SELECT z, lat, base, 156543.03392804097e0 * cos(radians(lat)) / pow(2, z) AS mpp FROM zl, (SELECT unnest([10, 30]) AS base)),
k AS (SELECT m.*, CAST(max(l.k) AS BIGINT) AS k FROM m JOIN (SELECT CAST(pow(2, i) AS BIGINT) AS k, i FROM range(10) t(i)) l
  ON l.k <= greatest(mpp * 1.4e0 / base, 1) AND (base = 10 OR i < 9) GROUP BY ALL)
SELECT z, lat, base, k, CASE WHEN 2560 <= greatest(4e0 / 3 * k * base, 40) THEN 256 WHEN 640 <= greatest(4e0 / 3 * k * base, 40) THEN 64 WHEN 160 <= greatest(4e0 / 3 * k * base, 40) THEN 16 ELSE 4 END AS f FROM k"""


@query(_LEVELS, with_views=False)
def level_pick(spark, sf_dir):
    """The coarsest level that is still fine enough, of the raster and of the mask."""
    z = F.explode(F.sequence(F.lit(3).cast("long"), F.lit(15).cast("long"))).alias("z")
    rows = spark.range(1).select(z).select("z", F.explode(F.array(*[F.lit(v) for v in (25.0, 31.0, 38.0, 45.0)])).alias("lat")).select("*", F.explode(F.array(F.lit(10), F.lit(30))).alias("base"))
    want = F.greatest(156543.03392804097 * F.cos(F.radians("lat")) / F.pow(F.lit(2.0), F.col("z")) * 1.4 / F.col("base"), F.lit(1.0))
    ladder = F.transform(F.sequence(F.lit(0), F.when(F.col("base") == 10, 9).otherwise(8)), lambda i: F.pow(F.lit(2.0), i).cast("long"))
    k = F.array_max(F.filter(ladder, lambda v: v <= want))
    fine = F.greatest(4.0 / 3 * k * F.col("base"), F.lit(40.0))
    f = F.array_max(F.filter(F.array(*[F.lit(v) for v in (4, 16, 64, 256)]), lambda v: v * 10 <= fine))
    return rows.select("z", "lat", "base", k.alias("k"), f.alias("f"))


@query(" SELECT iy // 512 AS cy, ix // 512 AS cx, count(*) FILTER (WHERE field) AS n FROM field GROUP BY ALL")
def mask_chunks(spark, sf_dir):
    chunk = [F.floor(F.col(c) / 512).alias(n) for c, n in (("iy", "cy"), ("ix", "cx"))]
    return views.probability(spark, sf_dir).groupBy(*chunk).agg(F.count_if(ops.in_field()).alias("n"))


@query(" SELECT iy, ix, field FROM field")
def mask_threshold(spark, sf_dir):
    return views.probability(spark, sf_dir).select("iy", "ix", ops.in_field().alias("field"))


@query(" SELECT code, count(*) AS n FROM raster JOIN field USING (iy, ix) WHERE year = 2024 AND field AND code > 0 GROUP BY code")
def clip_fields(spark, sf_dir):
    return ops.histogram(ops.clip(ops.with_field(views.raster(spark, sf_dir, [2024]), views.probability(spark, sf_dir))))


_KIND = """, kinds AS (SELECT code, field, CASE WHEN code IN (0, 81) THEN 0 WHEN NOT noncrop AND field THEN 1 WHEN NOT noncrop THEN 2 WHEN field THEN 3 ELSE 0 END AS kind
  FROM raster JOIN field USING (iy, ix) JOIN classes USING (code) WHERE year = 2024), h AS (SELECT kind, count(*) AS n FROM kinds WHERE kind > 0 GROUP BY kind)"""


def _kinds(spark, sf_dir):
    kinds = views.classes(spark)
    cells = ops.drop_codes(views.raster(spark, sf_dir, [2024]), kinds, False)
    return ops.disagreement(ops.with_field(cells, views.probability(spark, sf_dir)), kinds)


@query(_KIND + " SELECT kind, n, round(100e0 * n / sum(n) OVER (), 6) AS pct FROM h")
def disagreement_split(spark, sf_dir):
    counts = ops.histogram(_kinds(spark, sf_dir), "kind")
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(""", picked AS (SELECT DISTINCT p_size * 5 % 256 AS code FROM part), px AS (
  SELECT iy // 32 AS ty, ix // 32 AS tx, r.code, p.code IS NOT NULL AS kept FROM raster r LEFT JOIN picked p USING (code) WHERE year = 2025 AND r.code NOT IN (0, 81))
SELECT ty, tx, code, count(*) AS counted, count(*) FILTER (kept) AS drawn FROM px GROUP BY ALL""")
def selection_after_count(spark, sf_dir):
    """Tiles' classes: a legend counts all pixels, and of these the selected classes' alone
    are drawn. The selection comes from a table and is applied pixel by pixel."""
    cells = ops.drop_codes(views.raster(spark, sf_dir, [2025]), views.classes(spark), False).filter("code > 0")
    picked = _table(spark, sf_dir, "part").select((F.col("p_size") * 5 % 256).alias("code")).distinct()
    kept = ops.select_classes(cells, F.broadcast(picked))  # no more than there are classes
    tile = [F.floor(F.col(c) / 32).alias(t) for c, t in (("iy", "ty"), ("ix", "tx"))]
    return kept.groupBy(*tile, "code").agg(F.count("*").alias("counted"), F.count_if(F.col("shown") > 0).alias("drawn"))


@query(" SELECT code, count(*) AS n FROM raster WHERE year = 2025 AND code IN (3, 17, 42) GROUP BY code")
def selection_before_count(spark, sf_dir):
    return ops.histogram(views.raster(spark, sf_dir, [2025]).filter(F.col("code").isin(3, 17, 42)))


_TOP = """, h AS (SELECT code, count(*) AS n FROM raster WHERE year = 2025 AND code NOT IN (0, 81) GROUP BY code), top AS (SELECT * FROM h ORDER BY n DESC, code LIMIT 10)"""


@query(_TOP + " SELECT code, name, n, round(n * 0.2223948e0, 3) AS acres, round(100e0 * n / sum(n) OVER (), 6) AS pct FROM top JOIN classes USING (code)")
def analyze_top10(spark, sf_dir):
    kinds = views.classes(spark)
    return ops.top_of_view(ops.histogram(ops.drop_codes(views.raster(spark, sf_dir, [2025]), kinds, False)), kinds, 0.2223948)


@query(" SELECT count(*) FILTER (WHERE field) AS cells, round(count(*) FILTER (WHERE field) * 0.2223948e0, 4) AS acres FROM field")
def field_area(spark, sf_dir):
    return views.probability(spark, sf_dir).agg(F.count_if(ops.in_field()).alias("cells"), F.round(F.count_if(ops.in_field()) * 0.2223948, 4).alias("acres"))


@query(_TOP + ", t6 AS (SELECT code FROM top ORDER BY n DESC, code LIMIT 6) SELECT year, code, count(*) AS n FROM raster SEMI JOIN t6 USING (code) GROUP BY year, code")
def timelapse(spark, sf_dir):
    top = ops.histogram(ops.drop_codes(views.raster(spark, sf_dir, [2025]), views.classes(spark), False)).orderBy(F.desc("n"), "code").limit(6)
    return ops.timelapse(views.raster(spark, sf_dir), top)


@query(", b AS (SELECT year, iy // 4 AS ry, ix // 4 AS rx, code, count(*) AS n FROM raster WHERE year >= 2024 GROUP BY ALL) SELECT year, ry, rx, arg_max(code, n * 1000 - code) AS code FROM b GROUP BY ALL")
def majority_pyramid(spark, sf_dir):
    return ops.majority_pyramid(views.raster(spark, sf_dir, [2024, 2025]), 4)


@query(_TILES + """, b AS (SELECT id, CAST(s_suppkey AS BIGINT) AS st, x / pow(2, z) * 360 - 180 AS w, (x + 1) / pow(2, z) * 360 - 180 AS e, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2, z))))) AS s, degrees(atan(sinh(pi() * (1 - 2 * y / pow(2, z))))) AS n,
  -125e0 + s_suppkey % 50 AS xmin, 25e0 + (s_suppkey * 91 % 2400) / 100e0 AS ymin FROM tiles, supplier WHERE s_suppkey < 60)
SELECT id, st FROM b WHERE w < xmin + 2 AND e > xmin AND s < ymin + 2 AND n > ymin""")
def state_overlap(spark, sf_dir):
    """All boxes against at most 60 state extents: strict overlap on both axes, a
    broadcast range join. A state's south edge is its supplier's latitude in ``_points``."""
    k = F.col("s_suppkey")
    states = _table(spark, sf_dir, "supplier").filter("s_suppkey < 60").select(k.alias("st"), (-125.0 + k % 50).alias("xmin"), (25.0 + (k * 91 % 2400) / 100.0).alias("ymin"))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    boxes = _tiles(spark, sf_dir).select("id", geo.tile_edge_lon(x, z).alias("w"), geo.tile_edge_lat(y + 1, z).alias("s"), geo.tile_edge_lon(x + 1, z).alias("e"), geo.tile_edge_lat(y, z).alias("n"))
    meets = (F.col("w") < F.col("xmin") + 2) & (F.col("e") > F.col("xmin")) & (F.col("s") < F.col("ymin") + 2) & (F.col("n") > F.col("ymin"))
    return boxes.join(F.broadcast(states), meets).select("id", "st")


@query(_TILES + """, held AS (SELECT 3 + o_orderkey % 13 AS z, (o_orderkey * 7919) % CAST(pow(2, 3 + o_orderkey % 13) AS BIGINT) AS x,
  (o_orderkey * 104729) % CAST(pow(2, 3 + o_orderkey % 13) AS BIGINT) AS y, o_custkey % 3 AS state FROM orders)
SELECT DISTINCT z, x, y, state FROM tiles ANTI JOIN held USING (z, x, y, state)""")
def missing_keys(spark, sf_dir):
    """Requested tiles that the cache, a table of its own, doesn't hold under their state."""
    key, i = ["z", "x", "y", "state"], F.col("o_orderkey")
    z = 3 + i % 13
    n = F.pow(F.lit(2.0), z).cast("long")
    held = _table(spark, sf_dir, "orders").select(z.alias("z"), (i * 7919 % n).alias("x"), (i * 104729 % n).alias("y"), (F.col("o_custkey") % 3).alias("state"))
    return _tiles(spark, sf_dir).select(*key).distinct().join(held, key, "left_anti")


@query(_TILES + " SELECT z, state, date_trunc('hour', ts) AS batch, count(*) AS requests, count(DISTINCT x * 65536 + y) AS tiles FROM tiles GROUP BY ALL")
def request_batches(spark, sf_dir):
    return _tiles(spark, sf_dir).groupBy("z", "state", F.date_trunc("hour", "ts").alias("batch")).agg(F.count("*").alias("requests"), F.count_distinct(F.col("x") * 65536 + F.col("y")).alias("tiles"))


@query(" SELECT user_id, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), event_id) AS k, max(event_id) AS n FROM events GROUP BY user_id")
def latest_control(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(k, "event_id").alias("k"), F.max("event_id").alias("n"))


@query(", v AS (SELECT event_id AS id, event_id * 31 AS v FROM events) SELECT id, CASE WHEN v % 2 = 0 THEN v // 2 ELSE -((v + 1) // 2) END AS z FROM v")
def zigzag_decode(spark, sf_dir):
    v = F.col("event_id") * 31
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), geo.zigzag(v).alias("z"))


@query(", d AS (SELECT user_id AS tile, event_id AS i, event_id % 7 + 1 AS step, event_id % 5 * 8 AS len FROM events) SELECT tile, i, CAST(sum(step) OVER w AS BIGINT) AS id, CAST(sum(len) OVER w - len AS BIGINT) AS off FROM d WINDOW w AS (PARTITION BY tile ORDER BY i)")
def directory_decode(spark, sf_dir):
    """Running sums of id steps and of lengths, by directory."""
    w = Window.partitionBy("tile").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    i = F.col("event_id")
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("tile"), i.alias("i"), (i % 7 + 1).alias("step"), (i % 5 * 8).alias("len"))
    return rows.select("tile", "i", F.sum("step").over(w).alias("id"), (F.sum("len").over(w) - F.col("len")).alias("off"))


@query(", e AS (SELECT p_partkey * 5 AS id, p_size % 6 AS run FROM part), t AS (SELECT o_orderkey AS tid FROM orders) SELECT tid, CASE WHEN run = 0 OR tid - id < run THEN id ELSE -1 END AS entry FROM t ASOF LEFT JOIN e ON tid >= id")
def directory_lookup(spark, sf_dir):
    """The last entry at or before a tile id, within its run: union and windows over
    ids in blocks, blocks in groups, and groups."""
    e = _table(spark, sf_dir, "part").select((F.col("p_partkey") * 5).alias("id"), (F.col("p_size") % 6).alias("run"))
    both = e.select("id", F.struct("id", "run").alias("e"), F.lit(None).cast("long").alias("tid")).unionByName(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("struct<id:bigint,run:int>").alias("e"), F.col("o_orderkey").alias("tid")))
    both = both.withColumn("block", F.floor(F.col("id") / 4096))
    ends = both.groupBy("block").agg(F.max("e").alias("end")).withColumn("group", F.floor(F.col("block") / 4096))
    groups = ends.groupBy("group").agg(F.max("end").alias("last"))  # a row for 16 million ids
    earlier = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("group", F.max("last").over(earlier).alias("before"))
    earlier = Window.partitionBy("group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("near", F.max("end").over(earlier)).join(groups, "group").select("block", F.coalesce("near", "before").alias("carried"))
    inside = Window.partitionBy("block").orderBy("id").rangeBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("own", F.max("e").over(inside)).filter("tid is not null").join(ends, "block")
    hit = F.coalesce("own", "carried")
    return rows.select("tid", F.when((hit["run"] == 0) | (F.col("tid") - hit["id"] < hit["run"]), hit["id"]).otherwise(-1).alias("entry"))


_FIELDS = ", px AS (SELECT iy // 10 AS fy, ix // 10 AS fx, code FROM raster WHERE year = 2025 AND code > 0), c AS (SELECT fy, fx, code, count(*) AS n FROM px GROUP BY ALL), f AS (SELECT fy, fx, arg_max(code, n * 1000 - code) AS code, max(n) AS most, sum(n) AS total FROM c GROUP BY ALL)"


def _fields(spark, sf_dir):
    px = views.raster(spark, sf_dir, [2025]).filter("code > 0").select(F.floor(F.col("iy") / 10).alias("fy"), F.floor(F.col("ix") / 10).alias("fx"), "code")
    counts = px.groupBy("fy", "fx", "code").agg(F.count("*").alias("n"))
    return counts.groupBy("fy", "fx").agg(F.max_by("code", F.struct("n", -F.col("code"))).alias("code"), F.max("n").alias("most"), F.sum("n").alias("total"))


@query(_FIELDS + " SELECT fy, fx, code, most AS n FROM f")
def majority_per_field(spark, sf_dir):
    return _fields(spark, sf_dir).select("fy", "fx", "code", F.col("most").alias("n"))


@query(_FIELDS + " SELECT fy, fx, round(most / CAST(total AS DOUBLE), 9) AS purity FROM f")
def field_purity(spark, sf_dir):
    return _fields(spark, sf_dir).select("fy", "fx", F.round(F.col("most") / F.col("total"), 9).alias("purity"))


@query(", s AS (SELECT iy, ix, string_agg(CAST(code AS VARCHAR), '-' ORDER BY year) AS seq FROM raster WHERE year >= 2022 GROUP BY iy, ix) SELECT seq, count(*) AS n FROM s GROUP BY seq")
def crop_sequences(spark, sf_dir):
    years = views.raster(spark, sf_dir, range(2022, 2026)).groupBy("iy", "ix").agg(F.array_sort(F.collect_list(F.struct("year", "code"))).alias("s"))
    return years.select(F.array_join(F.transform("s", lambda v: v["code"].cast("string")), "-").alias("seq")).groupBy("seq").agg(F.count("*").alias("n"))


@query(" SELECT a.code AS before, b.code AS after, count(*) AS n FROM raster a JOIN raster b USING (iy, ix) WHERE a.year = 2024 AND b.year = 2025 AND a.code <> b.code GROUP BY ALL")
def rotation_selfjoin(spark, sf_dir):
    a, b = (views.raster(spark, sf_dir, [y]).select("iy", "ix", F.col("code").alias(n)) for y, n in ((2024, "before"), (2025, "after")))
    return a.join(b, ["iy", "ix"]).filter("before != after").groupBy("before", "after").agg(F.count("*").alias("n"))


@query(_KIND + " SELECT NOT noncrop AS crop, field, count(*) AS n FROM raster JOIN field USING (iy, ix) JOIN classes USING (code) WHERE year = 2024 AND code NOT IN (0, 81) GROUP BY ALL")
def agreement_2x2(spark, sf_dir):
    kinds = views.classes(spark)
    cells = ops.with_field(ops.drop_codes(views.raster(spark, sf_dir, [2024]), kinds, False).filter("code > 0"), views.probability(spark, sf_dir))
    return cells.join(F.broadcast(kinds), "code").groupBy((~F.col("noncrop")).alias("crop"), "field").agg(F.count("*").alias("n"))


@query(_POINTS + ", b AS (SELECT id, (lon - 60e0) * 1000 - 0.3e0 AS v FROM pts) SELECT id, CAST(trunc(v / 30) AS BIGINT) AS truncated, CAST(floor(v / 30) AS BIGINT) AS floored FROM b")
def grid_index(spark, sf_dir):
    v = (F.col("lon") - 60.0) * 1000 - 0.3
    return _points(spark, sf_dir).select("id", geo.raster_cell(v, 0.0, 30).alias("truncated"), F.floor(v / 30).alias("floored"))


@query(_POINTS + " SELECT id, round(greatest(least(lon * 1.2e0, -64.5e0), -127e0), 9) AS lon, round(greatest(least(lat * 1.2e0, 51.8e0), 22e0), 9) AS lat FROM pts")
def camera_clamp(spark, sf_dir):
    w, s, e, n = geo.CONUS
    keep = lambda c, lo, hi: F.round(F.greatest(F.least(F.col(c) * 1.2, F.lit(hi)), F.lit(lo)), 9).alias(c)
    return _points(spark, sf_dir).select("id", keep("lon", w - 2, e + 2), keep("lat", s - 2, n + 2))


@query(", m AS (SELECT event_id AS id, 2008 + event_id % 18 AS year, event_id % 2 = 0 AS dis FROM events) SELECT id, year IN (2024, 2025) AS ftw_ok, dis AND year IN (2024, 2025) AS dis, CASE WHEN year IN (2024, 2025) THEN 10 ELSE 30 END AS base, CASE WHEN year IN (2024, 2025) THEN year ELSE 2024 END AS fyear FROM m")
def mode_resolution(spark, sf_dir):
    year = 2008 + F.col("event_id") % 18
    ok = year.isin(2024, 2025)
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), ok.alias("ftw_ok"), ((F.col("event_id") % 2 == 0) & ok).alias("dis"), F.when(ok, 10).otherwise(30).alias("base"), F.when(ok, year).otherwise(2024).alias("fyear"))


@query(" SELECT o_orderkey AS id, CASE WHEN o_totalprice >= 10000 THEN format('{:.2f} M ac', o_totalprice / 1e6) ELSE format('{:.1f} k ac', o_totalprice / 1e3) END AS amount FROM orders")
def amount_text(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), geo.amount(F.col("o_totalprice")).alias("amount"))


@query(_TILES + " SELECT id FROM tiles WHERE z BETWEEN 3 AND 15 AND x / pow(2, z) * 360 - 180 < -66.5e0 AND (x + 1) / pow(2, z) * 360 - 180 > -125e0 AND degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2, z))))) < 49.8e0 AND degrees(atan(sinh(pi() * (1 - 2 * y / pow(2, z))))) > 24e0")
def request_domain(spark, sf_dir):
    """Zooms 3 to 15 and strict overlap with CONUS on both axes."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    w, s, e, n = geo.CONUS
    across = (geo.tile_edge_lon(x, z) < e) & (geo.tile_edge_lon(x + 1, z) > w)
    return _tiles(spark, sf_dir).filter(z.between(3, 15) & across & (geo.tile_edge_lat(y + 1, z) < n) & (geo.tile_edge_lat(y, z) > s)).select("id")
