"""Raster operators: masks, reclassification, histograms, legends, time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

NODATA, CLOUDS, THRESHOLD = 0, 81, 0.5


def window_scan(raster: DataFrame, year: int, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    return raster.filter((F.col("year") == year) & F.col("iy").between(*rows) & F.col("ix").between(*cols))


def drop_codes(raster: DataFrame, classes: DataFrame, crops_only: bool) -> DataFrame:
    """Nodata and clouds become 0; with crops_only every non-crop class too."""
    if not crops_only:
        return raster.withColumn("code", F.when(F.col("code").isin(NODATA, CLOUDS), 0).otherwise(F.col("code")))
    flagged = raster.join(F.broadcast(classes.select("code", "noncrop")), "code", "left")  # 256 classes
    gone = F.col("code").isin(NODATA, CLOUDS) | F.coalesce("noncrop", F.lit(False))
    return flagged.withColumn("code", F.when(gone, 0).otherwise(F.col("code"))).drop("noncrop")


def in_field(p: str = "p") -> Column:
    """NaN is no field (it would compare as large)."""
    return ~F.isnan(p) & (F.col(p) >= THRESHOLD)


def with_field(raster: DataFrame, probability: DataFrame) -> DataFrame:
    """Each cell's mask flag; cells outside the mask grid are no field."""
    mask = probability.filter(in_field()).select("iy", "ix", F.lit(True).alias("hit"))
    return raster.join(mask, ["iy", "ix"], "left").withColumn("field", F.coalesce("hit", F.lit(False))).drop("hit")


def clip(cells: DataFrame) -> DataFrame:
    return cells.withColumn("code", F.when(F.col("field"), F.col("code")).otherwise(0))


def disagreement(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """1: crop in a field; 2: crop outside; 3: non-crop in a field; else 0."""
    both = cells.join(F.broadcast(classes.select("code", "noncrop")), "code", "left")
    crop = (F.col("code") > 0) & ~F.coalesce("noncrop", F.lit(False))
    other = (F.col("code") > 0) & F.coalesce("noncrop", F.lit(False))
    kind = F.when(crop & F.col("field"), 1).when(crop, 2).when(other & F.col("field"), 3).otherwise(0)
    return both.withColumn("kind", kind).drop("noncrop")


def select_classes(cells: DataFrame, picked: DataFrame) -> DataFrame:
    """``cells`` with ``shown``: a pixel's code if ``picked(code)`` has it, else 0. Without any
    picked class all are shown. Counts made of ``code`` stay those of all pixels."""
    if picked.isEmpty():
        return cells.withColumn("shown", F.col("code"))
    marks = picked.select("code", F.lit(True).alias("mark"))
    return cells.join(marks, "code", "left").withColumn("shown", F.when(F.col("mark"), F.col("code")).otherwise(0)).drop("mark")


def histogram(cells: DataFrame, by: str = "code") -> DataFrame:
    return cells.filter(F.col(by) > 0).groupBy(by).agg(F.count("*").alias("n"))


def legend(counts: DataFrame, classes: DataFrame, top: int = 14) -> DataFrame:
    """The top codes with their share of all drawn pixels; known classes are kept after the cut."""
    total = Window.partitionBy()
    shares = counts.withColumn("pct", F.round(100.0 * F.col("n") / F.greatest(F.sum("n").over(total), F.lit(1)), 1))
    return shares.orderBy(F.desc("n"), "code").limit(top).join(F.broadcast(classes), "code").select("code", "name", "hex", "n", "pct")


def top_of_view(counts: DataFrame, classes: DataFrame, acres: float, top: int = 10) -> DataFrame:
    """The top codes with their share of what is listed, and their area."""
    listed = counts.orderBy(F.desc("n"), "code").limit(top).join(F.broadcast(classes), "code")
    return listed.select("code", "name", "n", F.round(F.col("n") * acres, 3).alias("acres"), F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("pct"))


def timelapse(raster: DataFrame, top: DataFrame) -> DataFrame:
    """Counts by year of the top codes: one scan of all years, one aggregation."""
    return raster.join(F.broadcast(top.select("code")), "code", "left_semi").groupBy("year", "code").agg(F.count("*").alias("n"))


def majority_pyramid(raster: DataFrame, k: int) -> DataFrame:
    """The commonest code of each k by k block, ties to the smaller code."""
    blocks = raster.groupBy("year", F.floor(F.col("iy") / k).alias("ry"), F.floor(F.col("ix") / k).alias("rx"), "code").agg(F.count("*").alias("n"))
    return blocks.groupBy("year", "ry", "rx").agg(F.max_by("code", F.struct("n", -F.col("code"))).alias("code"))


def palette_cycle(classes: DataFrame, size: int = 8) -> DataFrame:
    """Red-dominant classes, in code order, get a place in the safe palette (-1: not red)."""
    r, g, b = (geo.hex_channel("hex", i) for i in range(3))
    red = (r >= 170) & (g <= 100) & (b <= 110)
    place = (F.row_number().over(Window.partitionBy(red).orderBy("code")) - 1) % size
    return classes.select("code", "name", "noncrop", r.alias("r"), g.alias("g"), b.alias("b"), F.when(red, place).otherwise(-1).alias("safe"))
