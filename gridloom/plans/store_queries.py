"""Queries over stores that they write first from the given tables: sharded arrays, tile
archives, the level store and the mask's chunk table; and the same in DuckDB SQL, which takes
the tables directly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import lattice as lat
from ..operators import raster as ops
from ..operators import vector
from ..sources import archives, levels, mask_chunks, tiles, views, zarr3
from ..sources.objects import working_dir
from .lattice_queries import _VIEW_LATTICE, CAMERA, FACTOR, PIXEL, _albers_sql, _lattice_fields
from .queries import _WITH, _table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, _WITH + sql
        return f

    return register


# Sharded arrays.

_BANDS = """, bands AS (
  SELECT year, band, iy, ix, CAST(CAST((
    (key * CASE WHEN band = 'field' THEN 7919 ELSE 613 END + 104729 + (year - 2024) * 131) % 1000) / 1000e0 AS FLOAT) AS DOUBLE) AS value
  FROM cells, (SELECT unnest([2024, 2025]) AS year), (SELECT unnest(['boundary', 'field']) AS band) WHERE key % 97 <> 0
)"""


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two probabilities of every cell in two years; some cells are unknown."""
    key, axes = F.col("key"), F.array(*[F.struct(F.lit(y).alias("year"), F.lit(b).alias("band")) for y in (2024, 2025) for b in ("boundary", "field")])
    some = views.cells(spark, sf_dir).filter(key % 97 != 0).withColumn("at", F.explode(axes))
    factor = F.when(F.col("at.band") == "field", 7919).otherwise(613)
    value = ((key * factor + 104729 + (F.col("at.year") - 2024) * 131) % 1000) / 1000.0
    return some.select("at.year", "at.band", "iy", "ix", value.cast("float").cast("double").alias("value"))


def _stored_bands(spark: SparkSession, sf_dir: str) -> str:
    """The bands as a sharded array; returns its group."""
    group = f"{working_dir(spark)}/4x"
    height = (views.cells(spark, sf_dir).agg(F.max("iy")).head()[0] or 0) + 1
    zarr3.write_cells(_bands(spark, sf_dir), group, "variables", [2024, 2025], ["boundary", "field"], (height, views.WIDTH), (256, 64), (32, 32))
    return group


@query(_BANDS + " SELECT year, band, iy, ix, value FROM bands WHERE year = 2025 AND band = 'field' AND iy >= 5 AND ix BETWEEN 20 AND 131")
def zarr_window(spark, sf_dir):
    """A window of one band and year of a sharded array, read by byte ranges."""
    group = _stored_bands(spark, sf_dir)
    return zarr3.read_window(spark, f"{group}/variables", (5, 1 << 40), (20, 131), 2025, "field")


@query(_BANDS + """, wanted AS (SELECT DISTINCT event_id // 7 % 40 AS cy, user_id % 6 AS cx FROM events)
SELECT cy, cx, count(value) AS fields FROM wanted
LEFT JOIN (SELECT * FROM bands WHERE year = 2024 AND band = 'field' AND value >= CAST(0.5 AS FLOAT)) ON iy // 32 = cy AND ix // 32 = cx GROUP BY cy, cx""")
def mask_chunk_table(spark, sf_dir):
    """Chunks of the field mask as a table that grows: some are asked for, then all; the
    second time only what is missing is read. Chunks without a field are known, too."""
    group, table = _stored_bands(spark, sf_dir), f"{working_dir(spark)}/mask-chunks"
    asked = _table(spark, sf_dir, "events").select(F.floor(F.floor(F.col("event_id") / 7) % 40).alias("cy"), (F.col("user_id") % 6).alias("cx")).distinct()
    store = mask_chunks.MaskChunks(spark, table, f"{group}/variables", factor=4, year=2024, side=32)
    store.fill(asked.filter("cx < 3"))
    store.fill(asked)
    return store.cells_of(asked).groupBy("cy", "cx").agg(F.count("iy").alias("fields"))


# Tile archives.

_ARCHIVES = """, parts AS (
  SELECT 'US_' || p_size % 3 AS archive, p_partkey * 5 + p_size % 4 AS id, p_partkey, p_size FROM part
), rings AS (
  SELECT archive, id, r AS ring, p_partkey * 7 % 4000 + r * 3 AS x, p_partkey * 13 % 3900 AS y, p_size + 2 AS side FROM parts, (SELECT unnest([0, 1]) AS r) WHERE r = 0 OR p_size % 2 = 0
), points AS (
  SELECT archive, id, ring, 0 AS seq, x, y FROM rings UNION ALL SELECT archive, id, ring, 1, x + side, y FROM rings
  UNION ALL SELECT archive, id, ring, 2, x + side, y + side FROM rings UNION ALL SELECT archive, id, ring, 3, x, y FROM rings
), wanted AS (
  SELECT DISTINCT 'US_' || event_id % 3 AS archive, event_id AS id FROM events
)"""


def _archives(spark: SparkSession, sf_dir: str) -> str:
    """Three archives of tiles with a triangle or two in each; returns their folder."""
    p, size, root = F.col("p_partkey"), F.col("p_size").cast("long"), f"{working_dir(spark)}/archives"
    parts = _table(spark, sf_dir, "part").select(F.concat(F.lit("US_"), size % 3).alias("archive"), (p * 5 + size % 4).alias("id"), p, size.alias("size"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ring"))
    x, y, side = p * 7 % 4000 + F.col("ring") * 3, p * 13 % 3900, F.col("size") + 2
    corners = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + side, y), (x + side, y + side))])
    rings = parts.filter((F.col("ring") == 0) | (F.col("size") % 2 == 0)).select("archive", "id", F.lit("2025").alias("layer"), "ring", corners.alias("points"))
    tiles.write_archives(tiles.vector_tiles(rings), root)
    return root


@query(_ARCHIVES + """ SELECT archive, id, CAST(ring AS BIGINT) AS ring, CAST(seq AS INTEGER) AS seq, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM wanted LEFT JOIN points USING (archive, id)""")
def pmtiles_fetch(spark, sf_dir):
    """Tiles of three archives, fetched by ranges into a table that knows what is absent, and
    their rings, point by point. Tiles that aren't there have one row without a point."""
    root, cache, id_ = _archives(spark, sf_dir), f"{working_dir(spark)}/tile-blobs", F.col("event_id")
    wanted = _table(spark, sf_dir, "events").select(F.concat(F.lit("US_"), id_ % 3).alias("archive"), id_.alias("id")).distinct()
    tiles.cached_tiles(wanted.filter("archive = 'US_1'"), root, cache)  # fetched earlier, so not again
    held = tiles.cached_tiles(wanted, root, cache)
    points = archives.polygon_points(held.select(F.struct("archive", "id").alias("tile"), "blob"), "2025", "archive string, id long")
    found = points.select("tile.archive", "tile.id", "ring", "seq", "x", "y")
    return wanted.join(found, ["archive", "id"], "left")


# Levels.

#: Metres of a cell of the groups' finest rasters; the finer group has two years.
BASES, KS = {10: PIXEL, 30: 3 * PIXEL}, [1, 2, 4]

_LEVELS = """, fine AS (
  SELECT 30 AS grp, year, iy, ix, code FROM raster UNION ALL SELECT 10, year, iy, ix, (code * 3 + 1) % 256 FROM raster WHERE year >= 2024
), levels AS (
  SELECT grp, k, year, iy, ix, arg_max(code, n * 1000 - code) AS code FROM (
    SELECT grp, k, year, iy // k AS iy, ix // k AS ix, code, count(*) AS n FROM fine, (SELECT unnest([1, 2, 4]) AS k) GROUP BY ALL) GROUP BY ALL
)"""


def _level_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level store of both groups, written from the raster."""
    path, raster = f"{working_dir(spark)}/levels", views.raster(spark, sf_dir)
    levels.write_levels(raster, path, 30, KS)
    fine = views.raster(spark, sf_dir, [2024, 2025]).withColumn("code", ((F.col("code") * 3 + 1) % 256).cast("int"))
    levels.write_levels(fine, path, 10, KS)
    return levels.read_levels(spark, path)


@query(_LEVELS + """, asked AS (
  SELECT CASE WHEN year >= 2024 AND event_id % 2 = 0 THEN 10 ELSE 30 END AS grp, year, z, lat FROM (
    SELECT event_id, 2008 + user_id % 18 AS year, event_id % 5 AS z, 25e0 + user_id % 20 AS lat FROM events)
), picked AS (
  SELECT DISTINCT grp, year, CASE WHEN want >= 4 THEN 4 WHEN want >= 2 THEN 2 ELSE 1 END AS k FROM (
    SELECT *, 2 * pi() * 6378137e0 / 256 * cos(radians(lat)) / pow(2e0, z) * 1.4e0 / CASE grp WHEN 10 THEN 30720e0 ELSE 92160e0 END AS want FROM asked)
)
SELECT grp, k, year, code, count(*) AS n FROM levels JOIN picked USING (grp, k, year) GROUP BY ALL""")
def picked_levels(spark, sf_dir):
    """Codes of the levels that requests pick: of the store's folders only these are read."""
    e, user = F.col("event_id"), F.col("user_id")
    asked = _table(spark, sf_dir, "events").select(e, (2008 + user % 18).alias("year"), (e % 5).alias("z"), (25.0 + user % 20).alias("lat"))
    asked = asked.withColumn("grp", F.when((F.col("year") >= 2024) & (e % 2 == 0), 10).otherwise(30))
    base = F.when(F.col("grp") == 10, BASES[10]).otherwise(BASES[30])
    picked = asked.select("grp", levels.pick_level(lat.metres_per_pixel(F.col("lat"), F.col("z")), base, KS).alias("k"), "year")
    return levels.requested(_level_store(spark, sf_dir), picked).groupBy("grp", "k", "year", "code").agg(F.count("*").alias("n"))


@query(_LEVELS + """ SELECT grp, k, year, CASE grp WHEN 10 THEN 30720 ELSE 92160 END * k AS px_m, count(*) AS cells, count(DISTINCT code) AS codes, CAST(sum(code) AS BIGINT) AS total FROM levels GROUP BY grp, k, year""")
def stored_levels(spark, sf_dir):
    """All levels of both groups as the store has them."""
    base = F.when(F.col("grp") == 10, int(BASES[10])).otherwise(int(BASES[30]))
    by = _level_store(spark, sf_dir).groupBy("grp", "k", "year", (base * F.col("k")).alias("px_m"))
    return by.agg(F.count("*").alias("cells"), F.count_distinct("code").alias("codes"), F.sum("code").alias("total"))


#: The view of the stored analysis: samples as wide as a cell of the finer group's second level.
_SAMPLE, _K = 2 * PIXEL, 2
_STORED = _LEVELS + _VIEW_LATTICE.replace("30720e0", f"{_SAMPLE:.0f}e0") + """, placed AS (
  SELECT *, CAST(trunc(({0} + 2417835e0) / 92160e0) AS BIGINT) AS tx, CAST(trunc((3321225e0 - {1}) / 92160e0) AS BIGINT) AS ty FROM c
), inside AS (
  SELECT p.* FROM placed p JOIN field f ON f.iy = p.fy AND f.ix = p.fx AND f.field
), analysed AS (
  SELECT l.code, count(*) AS n, min(acres) AS acres FROM inside JOIN levels l ON l.iy = cy AND l.ix = cx
  WHERE grp = 10 AND k = 2 AND year = 2025 AND l.code NOT IN (0, 81) GROUP BY l.code ORDER BY n DESC, l.code LIMIT 10
)""".format(*_albers_sql("lon", "lat"))


def _view(spark: SparkSession) -> DataFrame:
    box = F.col("box")
    view = spark.range(1).select(lat.view_box(*[F.lit(v) for v in CAMERA]).alias("box"))
    nx, ny = lat.view_size(box, _SAMPLE)
    return view.withColumn("nx", nx).withColumn("ny", ny).withColumn("acres", lat.sample_acres(box, F.col("nx"), F.col("ny")))


def _samples_in_fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The view, and its samples that are fields."""
    view = _view(spark)
    lattice = lat.samples(view, F.col("nx"), F.col("ny")).drop("box")
    fields = lat.within(_lattice_fields(spark, sf_dir), lat.grid_window(view, FACTOR))
    return view, lat.look_up_field(lattice, fields, FACTOR).filter("field")


def _counted(samples: DataFrame, view: DataFrame, store: DataFrame, grp: int, k: int, years: list[int] | range) -> DataFrame:
    """Counts by year and code of the samples' cells in one level of the store."""
    pixel = BASES[grp] * k
    window = lat.raster_window(view, pixel)
    cells = lat.within(levels.window(store, grp, k, years, *window), window, len(years)).select("year", "iy", "ix", "code")
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    placed = samples.withColumn("ix", geo.raster_cell(x, lat.RASTER_EXTENT[0], pixel)).withColumn("iy", geo.raster_cell(lat.RASTER_EXTENT[3] - y, 0.0, pixel))
    return placed.join(cells, ["iy", "ix"]).filter("code > 0").groupBy("year", "code").agg(F.count("*").alias("n"), F.min("acres").alias("acres"))


def _analysed(samples: DataFrame, view: DataFrame, store: DataFrame) -> DataFrame:
    counts = _counted(samples, view, store, 10, _K, [2025]).filter(F.col("code") != ops.CLOUDS)
    return counts.orderBy(F.desc("n"), "code").limit(10)


@query(_STORED + """ SELECT code, name, n, round(n * acres, 1) AS acres, round(100e0 * n / sum(n) OVER (), 6) AS pct
FROM (SELECT * FROM analysed JOIN classes USING (code))""")
def stored_analysis(spark, sf_dir):
    """The view's top classes within fields from the stored level of its own pixel: one
    folder, and of it the window."""
    view, samples = _samples_in_fields(spark, sf_dir)
    named = _analysed(samples, view, _level_store(spark, sf_dir)).join(F.broadcast(views.classes(spark)), "code")
    share = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6)
    return named.select("code", "name", "n", F.round(F.col("n") * F.col("acres"), 1).alias("acres"), share.alias("pct"))


@query(_STORED + """, s AS (
  SELECT year, code, count(*) AS n FROM inside JOIN levels l ON l.iy = ty AND l.ix = tx
  WHERE grp = 30 AND k = 1 AND code IN (SELECT code FROM (SELECT * FROM analysed JOIN classes USING (code) ORDER BY n DESC, code LIMIT 6)) GROUP BY year, code
), g AS (SELECT year, code FROM (SELECT DISTINCT year FROM s), (SELECT DISTINCT code FROM s))
SELECT year, code, coalesce(n, 0) AS n, round(coalesce(n, 0) / CAST((SELECT greatest(max(n), 1) FROM s) AS DOUBLE), 9) AS height FROM g LEFT JOIN s USING (year, code)""")
def stored_timelapse(spark, sf_dir):
    """All years of the six top classes of the analysis (after its drop list), on the same
    samples and mask, from the coarser group's level nearest to the samples."""
    view, samples = _samples_in_fields(spark, sf_dir)
    store = _level_store(spark, sf_dir)
    top = _analysed(samples, view, store).join(F.broadcast(views.classes(spark)), "code").orderBy(F.desc("n"), "code").limit(6)
    k = lat.nearest_level(_SAMPLE / BASES[30], KS)
    counts = _counted(samples, view, store, 30, k, views.YEARS).select("year", "code", "n")
    return lat.timelapse_series(counts, top)
