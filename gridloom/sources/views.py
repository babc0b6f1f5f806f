"""Raster views derived from the star-schema tables by integer formulas.

A raster is ``(year, iy, ix, code)``, a probability grid ``(year, iy, ix, p)``; the same
cells carry both. Filters on iy, ix and year reach the scan as filters on o_orderkey.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, YEARS = 150, range(2008, 2026)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.floor(k / WIDTH).alias("iy"), (k % WIDTH).alias("ix"), F.col("o_custkey").alias("seed"), k.alias("key"))


def code_of(seed: str, year: F.Column | int) -> F.Column:
    y = (year if isinstance(year, F.Column) else F.lit(year)) - 2008
    return ((F.col(seed) * 31 + F.col("iy") * 7 + y * (F.col(seed) % 5)) % 256).cast("int")


def raster(spark: SparkSession, sf_dir: str, years: range | list[int] = YEARS) -> DataFrame:
    """Years are exploded from an array: no join."""
    base = cells(spark, sf_dir).withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    return base.select("year", "iy", "ix", code_of("seed", F.col("year")).alias("code"), "key")


def stored_rows(raster: DataFrame, rows: tuple[int, int]) -> DataFrame:
    """The cells of some rows by their stored keys: this range is pushed down to the scan,
    as a filter on a cell computed from the key can't be."""
    return raster.filter(F.col("key").between(rows[0] * WIDTH, (rows[1] + 1) * WIDTH - 1))


def probability(spark: SparkSession, sf_dir: str, rows: tuple[int, int] | None = None) -> DataFrame:
    """``rows``, bounds included, reach the scan."""
    p = ((F.col("key") * 7919 + 104729) % 1000) / 1000.0
    some = cells(spark, sf_dir)
    some = some if rows is None else stored_rows(some, rows)
    return some.select("iy", "ix", F.when(F.col("key") % 97 == 0, F.lit(float("nan"))).otherwise(p).alias("p"))


def classes(spark: SparkSession) -> DataFrame:
    """256 invented classes: ``code, name, hex, noncrop``."""
    c = F.col("id").cast("int")
    name = F.when(c % 16 == 2, F.concat(F.lit("Developed "), c)).when(c % 16 == 5, F.lit("Water")).when(c % 16 == 9, F.lit("Forest")).otherwise(F.concat(F.lit("Crop "), c))
    hexed = F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex((c * k + o) % 256)), 2, "0") for k, o in ((37, 150), (11, 40), (23, 30))])
    return spark.range(256).select(c.alias("code"), name.alias("name"), hexed.alias("hex"), (name.startswith("Developed") | name.isin("Water", "Forest")).alias("noncrop"))


#: The same views in DuckDB SQL.
SQL = """
cells AS (SELECT o_orderkey // 150 AS iy, o_orderkey % 150 AS ix, o_custkey AS seed, o_orderkey AS key FROM orders),
raster AS (SELECT year, iy, ix, CAST((seed * 31 + iy * 7 + (year - 2008) * (seed % 5)) % 256 AS INTEGER) AS code, key
  FROM cells, (SELECT unnest(range(2008, 2026)) AS year)),
probability AS (SELECT iy, ix, CASE WHEN key % 97 = 0 THEN CAST('nan' AS DOUBLE) ELSE ((key * 7919 + 104729) % 1000) / 1000e0 END AS p FROM cells),
classes AS (SELECT code, name, hex, name LIKE 'Developed%' OR name IN ('Water', 'Forest') AS noncrop FROM (
  SELECT CAST(i AS INTEGER) AS code,
    CASE WHEN i % 16 = 2 THEN 'Developed ' || i WHEN i % 16 = 5 THEN 'Water' WHEN i % 16 = 9 THEN 'Forest' ELSE 'Crop ' || i END AS name,
    '#' || lpad(lower(hex((i * 37 + 150) % 256)), 2, '0') || lpad(lower(hex((i * 11 + 40) % 256)), 2, '0') || lpad(lower(hex((i * 23 + 30) % 256)), 2, '0') AS hex
  FROM range(256) t(i))),
field AS (SELECT iy, ix, NOT isnan(p) AND p >= 0.5e0 AS field FROM probability)
"""
