"""Queries over outlines, tile ids, packed masks and requests, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nearest, vector
from ..sources import views
from ..sources.objects import working_dir
from ..streaming import requests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""WITH RECURSIVE t AS (SELECT event_id AS id, CAST(event_id % 14 AS BIGINT) AS z, (event_id * 7919) % (1::BIGINT << (event_id % 14)) AS x,
    (event_id * 104729) % (1::BIGINT << (event_id % 14)) AS y FROM events),
h AS (SELECT id, z, z - 1 AS k, x, y, ((1::BIGINT << (2 * z)) - 1) // 3 AS d FROM t UNION ALL
  SELECT id, z, k - 1, CASE WHEN b = 1 THEN u WHEN a = 1 THEN s - 1 - v ELSE v END, CASE WHEN b = 1 THEN v WHEN a = 1 THEN s - 1 - u ELSE u END, d + s * s * xor(3 * a, b)
  FROM (SELECT *, 1::BIGINT << k AS s, (x >> k) & 1 AS a, (y >> k) & 1 AS b, x & ((1::BIGINT << k) - 1) AS u, y & ((1::BIGINT << k) - 1) AS v FROM h WHERE k >= 0))
SELECT id, d AS tile_id FROM h WHERE k = -1""")
def hilbert_tile_id(spark, sf_dir):
    i = F.col("event_id")
    n = F.expr("shiftleft(1L, cast(event_id % 14 as int))")
    tiles = _table(spark, sf_dir, "events").select(i.alias("id"), (i % 14).alias("z"), (i * 7919 % n).alias("x"), (i * 104729 % n).alias("y"))
    return tiles.select("id", vector.hilbert_id("z", "x", "y").alias("tile_id"))


@query("""WITH e AS (SELECT user_id AS dir, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, CASE WHEN event_id % 3 = 0 THEN event_id % 1000 + 1 ELSE 0 END AS v, event_id % 5 * 8 AS len FROM events),
g AS (SELECT *, sum(CASE WHEN v <> 0 OR k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY dir ORDER BY k) AS island FROM e)
SELECT dir, k, CAST(first_value(v) OVER w - 1 + sum(len) OVER w - len AS BIGINT) AS off FROM g WINDOW w AS (PARTITION BY dir, island ORDER BY k ROWS UNBOUNDED PRECEDING)""")
def offset_decode(spark, sf_dir):
    from pyspark.sql import Window

    i = F.col("event_id")
    k = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("dir"), k.alias("k"), F.when(i % 3 == 0, i % 1000 + 1).otherwise(0).alias("v"), (i % 5 * 8).alias("len"))
    return vector.entry_offsets(rows).select("dir", "k", "off")


_RINGS = """WITH d AS (SELECT user_id AS ring, event_id AS seq, (event_id * 7919) % 1601 - 800 AS dx, (event_id * 104729) % 1601 - 800 AS dy FROM events),
p AS (SELECT ring, seq, CAST(sum(dx) OVER w AS BIGINT) AS x, CAST(sum(dy) OVER w AS BIGINT) AS y FROM d WINDOW w AS (PARTITION BY ring ORDER BY seq ROWS UNBOUNDED PRECEDING))"""


def _points(spark, sf_dir):
    i = F.col("event_id")
    return vector.ring_points(_table(spark, sf_dir, "events").select(F.col("user_id").alias("ring"), i.alias("seq"), (i * 7919 % 1601 - 800).alias("dx"), (i * 104729 % 1601 - 800).alias("dy")))


@query(_RINGS + " SELECT ring, seq, x, y FROM p")
def cursor_decode(spark, sf_dir):
    return _points(spark, sf_dir).select("ring", "seq", "x", "y")


@query(_RINGS + """, s AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, row_number() OVER w AS nth FROM p WINDOW w AS (PARTITION BY ring ORDER BY seq)),
q AS (SELECT *, nth - row_number() OVER (PARTITION BY ring ORDER BY seq) AS part FROM s WHERE nx IS NOT NULL AND NOT (x < 0 AND nx < 0) AND NOT (x > 4096 AND nx > 4096) AND NOT (y < 0 AND ny < 0) AND NOT (y > 4096 AND ny > 4096))
SELECT ring, CAST(part AS BIGINT) AS part, count(*) + 1 AS n, CAST(sum(nx) + arg_min(x, seq) AS BIGINT) AS sum_x, arg_max(ny, seq) AS last_y FROM q GROUP BY ring, part""")
def clip_polylines(spark, sf_dir):
    lines = vector.clipped_polylines(_points(spark, sf_dir))
    total = F.aggregate("line", F.lit(0).cast("long"), lambda a, p: a + p["x"])
    return lines.select("ring", F.col("part").cast("long").alias("part"), F.size("line").cast("long").alias("n"), total.alias("sum_x"), F.element_at("line", -1)["y"].alias("last_y"))


_BOXES = """WITH f AS (SELECT s_suppkey AS id, s_suppkey * 37 % 140 + 0.25e0 AS w, s_suppkey * 91 % 90 + 0.25e0 AS s, s_suppkey % 9 + 1.5e0 AS dx, s_suppkey % 7 + 1.5e0 AS dy FROM supplier),
b AS (SELECT id, w, s, w + dx AS e, s + dy AS n FROM f)"""


def _boxes(spark, sf_dir):
    k = F.col("s_suppkey")
    f = _table(spark, sf_dir, "supplier").select(k.alias("id"), (k * 37 % 140 + 0.25).alias("w"), (k * 91 % 90 + 0.25).alias("s"))
    return f.withColumn("e", F.col("w") + F.col("id") % 9 + 1.5).withColumn("n", F.col("s") + F.col("id") % 7 + 1.5)


@query(_BOXES + " SELECT p.id AS a, q.id AS b FROM b p JOIN b q ON p.w < q.e AND p.e > q.w AND p.s < q.n AND p.n > q.s AND p.id < q.id")
def outline_overlaps(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    return vector.box_join(boxes, boxes, 8.0).filter("a < b")


@query(_BOXES + " SELECT o_orderkey AS id, b.id AS field FROM orders JOIN b ON o_orderkey % 150 > w AND o_orderkey % 150 < e AND o_orderkey // 150 > s AND o_orderkey // 150 < n")
def points_in_fields(spark, sf_dir):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("w", "s"), corner("e", "s"), corner("e", "n"), corner("w", "n"), corner("w", "s"))
    fields = _boxes(spark, sf_dir).select(F.col("id").alias("field"), ring.alias("ring"))
    cells = views.cells(spark, sf_dir).select(F.col("key").alias("id"), F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"))
    return vector.points_in_polygons(cells, fields, 8.0)


@query("WITH " + views.SQL + " SELECT CAST(iy // 512 AS BIGINT) AS cy, CAST(ix // 512 AS BIGINT) AS cx, count(*) AS n FROM field WHERE field GROUP BY ALL")
def packed_mask(spark, sf_dir):
    from ..operators import raster as ops

    cells = views.probability(spark, sf_dir).filter(ops.in_field()).select("iy", "ix")
    return vector.pack_mask(cells).groupBy("cy", "cx").agg(F.sum(F.bitmap_count("bits")).alias("n"))


@query("WITH " + views.SQL + " SELECT CAST(iy AS BIGINT) AS iy, CAST(ix AS BIGINT) AS ix FROM field WHERE field")
def unpacked_mask(spark, sf_dir):
    from ..operators import raster as ops

    return vector.unpack_mask(vector.pack_mask(views.probability(spark, sf_dir).filter(ops.in_field()).select("iy", "ix")))


@query("""SELECT event_id AS id, 'set' AS act, 2008 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 18 AS year, CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 AS fields, false AS dis FROM events WHERE event_id % 10 <> 0
UNION ALL SELECT event_id, 'set', 2025, false, false FROM events WHERE event_id % 10 = 0""")
def control_defaults(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    good = F.format_string('{"year": %d, "fields": %s, "n": 1}', 2008 + k % 18, F.when(k % 2 == 0, "true").otherwise("false"))
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 10 != 0, good).otherwise("{no").alias("message"))
    return requests.control(events).select("id", "act", "year", "fields", "dis")


@query("""WITH v AS (SELECT event_id % 9 + 3 AS z, user_id % 3 AS state, event_id % 50 AS x0, event_id % 50 + event_id % 14 AS x1, event_id % 40 AS y0, event_id % 40 + event_id % 11 AS y1 FROM events)
SELECT DISTINCT z, unnest(range(x0, x1 + 1)) AS x, y, state FROM (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM v WHERE (x1 - x0 + 1) * (y1 - y0 + 1) <= 80)""")
def view_prefetch(spark, sf_dir):
    i = F.col("event_id")
    shown = _table(spark, sf_dir, "events").select(
        (i % 9 + 3).alias("z"), (F.col("user_id") % 3).alias("state"), (i % 50).alias("x0"), (i % 50 + i % 14).alias("x1"), (i % 40).alias("y0"), (i % 40 + i % 11).alias("y1"))
    return requests.view_tiles(shown).distinct()


@query("""WITH p AS (
  SELECT c_custkey AS id, -120e0 + c_custkey * 37 % 500 / 10e0 AS lon, 25e0 + c_custkey * 91 % 240 / 10e0 AS lat, c_mktsegment AS kind FROM customer
), a AS (
  SELECT s_suppkey AS q, -100e0 + s_suppkey % 20 AS at_, 30e0 + s_suppkey % 13 AS up, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD'][s_suppkey % 5 + 1] AS kind FROM supplier
), d AS (
  SELECT q, id, (lon - at_) * (lon - at_) + (lat - up) * (lat - up) AS away FROM a JOIN p USING (kind)
)
SELECT q, id FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY away, id) AS rn FROM d) WHERE rn = 1""")
def nearest_place(spark, sf_dir):
    """The first hit of a gazetteer: of the places of a kind the one nearest to the camera."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    names = F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")])
    places = _table(spark, sf_dir, "customer").select(k.alias("id"), (-120.0 + k * 37 % 500 / 10.0).alias("lon"), (25.0 + k * 91 % 240 / 10.0).alias("lat"), F.col("c_mktsegment").alias("kind"))
    asked = _table(spark, sf_dir, "supplier").select(s.alias("q"), (-100.0 + s % 20).alias("lon"), (30.0 + s % 13).alias("lat"), F.element_at(names, (s % 5 + 1).cast("int")).alias("kind"))
    return nearest.nearest_places(asked, places).select("q", "id")


@query("""WITH r AS (SELECT event_id, 3 + event_id % 9 AS z, event_id * 7 % 64 AS x, user_id % 32 AS y, user_id % 3 AS state, event_id // 2500 AS part FROM events),
k AS (SELECT z, x, y, state, min(part) AS part FROM r GROUP BY ALL)
SELECT z, x, y, state, z * 10000 + x * 100 + y AS tile FROM k""")
def served_requests(spark, sf_dir):
    """Requests as a stream of files: each tile is rendered once, whichever batch asks first. A
    batch that fails is recorded, and its tiles come with the next one."""
    e, inbox, out = F.col("event_id"), working_dir(spark), working_dir(spark)
    asked = _table(spark, sf_dir, "events").select((3 + e % 9).alias("z"), (e * 7 % 64).alias("x"), (F.col("user_id") % 32).alias("y"), (F.col("user_id") % 3).alias("state"), F.floor(e / 2500).alias("part"))
    asked.repartitionByRange(4, "part").drop("part").write.parquet(inbox)
    stream = spark.readStream.schema("z long, x long, y long, state long").option("maxFilesPerTrigger", 1).parquet(inbox)
    tries = []

    def render(keys: DataFrame) -> DataFrame:
        tries.append(1)
        if len(tries) == 2:
            raise RuntimeError("the renderer is away")
        return keys.withColumn("tile", F.col("z") * 10000 + F.col("x") * 100 + F.col("y"))

    requests.serve(stream, render, out, "z long, x long, y long, state long, tile long", f"{out}/log").awaitTermination()
    return spark.read.parquet(f"{out}/tiles").drop("batch")


@query("""WITH v AS (SELECT event_id AS id, CAST(event_id * 977 % 400000 + 500 AS BIGINT) AS w, CAST(event_id * 131 % 300000 + 500 AS BIGINT) AS h FROM events), l AS (SELECT CAST(pow(2, i) AS BIGINT) AS k FROM range(0, 9) t(i))
SELECT id, min(k) AS k FROM v JOIN l ON (w // k) * (h // k) <= 3000000 GROUP BY id""")
def budget_level(spark, sf_dir):
    """The finest level whose window has at most 3,000,000 pixels."""
    i = F.col("event_id")
    fits = lambda k: F.floor(F.col("w") / k) * F.floor(F.col("h") / k) <= 3_000_000
    levels = F.filter(F.array(*[F.lit(1 << j).cast("long") for j in range(9)]), fits)
    return _table(spark, sf_dir, "events").select(i.alias("id"), (i * 977 % 400000 + 500).alias("w"), (i * 131 % 300000 + 500).alias("h")).select("id", F.array_min(levels).alias("k")).filter("k is not null")


@query("""WITH v AS (SELECT event_id AS id, event_id * 977 % 90000 + 500e0 AS w, event_id * 131 % 70000 + 500e0 AS h, CASE WHEN event_id % 2 = 0 THEN 10 ELSE 30 END AS base FROM events),
l AS (SELECT CAST(pow(2, i) AS BIGINT) AS k FROM range(0, 9) t(i))
SELECT id, base, min(k) AS k FROM v JOIN l ON ceil(w / (base * k)) * ceil(h / (base * k)) <= 1500000 GROUP BY id, base""")
def join_level(spark, sf_dir):
    """The finest level with at most 1,500,000 pixel centres in the projected box: what fields
    are joined with."""
    i = F.col("event_id")
    boxes = _table(spark, sf_dir, "events").select(i.alias("id"), (i * 977 % 90000 + 500.0).alias("w"), (i * 131 % 70000 + 500.0).alias("h"), F.when(i % 2 == 0, 10).otherwise(30).alias("base"))
    level = vector.finest_level(F.col("w"), F.col("h"), F.col("base"), [1 << j for j in range(9)], 1_500_000)
    return boxes.select("id", "base", level.alias("k")).filter("k is not null")
