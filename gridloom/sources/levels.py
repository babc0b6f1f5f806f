"""The level store: rasters of several groups, levels and years as one partitioned table.

``(grp, k, year)`` are folders, so a request for one level lists and reads that level alone,
also where the level is only known from a joined table (dynamic partition pruning). Within a
folder rows are sorted along rows and columns and written in small row groups, so that a
window's ranges skip most of them. Levels are made once, from a group's finest raster.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVEL = ["grp", "k", "year"]
SCHEMA = "iy long, ix long, code int, grp int, k int, year int"
#: Bytes of a row group; a level's cells take about six each.
ROW_GROUP = 1 << 20
#: A group's finest pixel is this many of a map's pixels at least.
SHARPNESS = 1.4
#: Stands for a missing code while codes are counted: above all of them.
NO_CODE = 1 << 31


def all_levels(raster: DataFrame, grp: int, ks: list[int]) -> DataFrame:
    """A group's ``raster(year, iy, ix, code)`` and its majority levels: the commonest code of
    each k by k block, ties to the smaller code.

    The raster is dealt once, by ranges of blocks that every k divides: so each block of each
    level lies in one task. The shuffle is read twice: for the raster itself, and for all levels
    made of it.
    """
    side = math.lcm(*ks)
    block = [F.floor(F.col(c) / side).alias(b) for c, b in (("iy", "by"), ("ix", "bx"))]
    cells = raster.select(*block, *[F.col(c).cast(t).alias(c) for c, t in (("year", "int"), ("iy", "long"), ("ix", "long"), ("code", "int"))])
    dealt = cells.repartitionByRange("by", "bx")
    # New names, or the union's first part keeps its casts below the shuffle and deals the raster once more.
    parts = [dealt.select(F.lit(1).alias("k"), *[F.col(c).alias(c) for c in ("year", "iy", "ix", "code")])] if 1 in ks else []
    if coarse := sorted(set(ks) - {1}, reverse=True):
        parts.append(majorities(dealt, side, coarse))
    return reduce(DataFrame.unionByName, parts).select(F.lit(grp).alias("grp"), "k", "year", "iy", "ix", "code")


def majorities(dealt: DataFrame, side: int, ks: list[int]) -> DataFrame:
    """``k, year, iy, ix, code`` of the levels ``ks`` (the coarsest first) of cells whose blocks
    of ``side`` cells, ``(by, bx)``, lie together.

    A block of each level is a window. Windows of levels that divide each other are parts of
    one another and share one sort; the row that is first in a block stands for it.
    """
    at = {k: [f"y{k}", f"x{k}"] if k < side else ["by", "bx"] for k in ks}
    finer = [k for k in ks if k < side]
    cut = [F.floor(F.col(c) / k).alias(name) for k in finer for c, name in zip(("iy", "ix"), at[k], strict=True)]
    made = dealt.select("by", "bx", "year", *cut, "code")
    # The lowest of the commonest; no code counts as a code, too, as the highest.
    commonest = F.mode(F.coalesce(F.col("code").cast("long"), F.lit(NO_CODE)), deterministic=True)
    for k in ks:
        around = [c for j in finer if j > k and j % k == 0 for c in at[j]]
        within = [c for j in finer if j < k for c in at[j]]
        whole = Window.partitionBy("by", "bx", "year", *around, *(at[k] if k < side else [])).orderBy(*within, "code")
        code = commonest.over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        made = made.withColumn(f"first{k}", F.row_number().over(whole) == 1).withColumn(f"code{k}", F.nullif(code, F.lit(NO_CODE)).cast("int"))
    rows = [F.when(F.col(f"first{k}"), F.struct(F.lit(k).alias("k"), "year", *[F.col(c).alias(n) for c, n in zip(at[k], ("iy", "ix"), strict=True)], F.col(f"code{k}").alias("code"))) for k in ks]
    return made.select(F.inline(F.array_compact(F.array(*rows))))


def write_levels(raster: DataFrame, path: str, grp: int, ks: list[int]) -> None:
    """Append a group's levels, in one job; nothing but the store is written."""
    every = all_levels(raster, grp, ks).sortWithinPartitions(*LEVEL, "iy", "ix")
    every.write.mode("append").partitionBy(*LEVEL).option("parquet.block.size", ROW_GROUP).parquet(path)


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """All levels; filter or join on (grp, k, year) to read some."""
    return spark.read.schema(SCHEMA).parquet(path)


def pick_level(metres_per_pixel: Column, base: Column | float, ks: list[int]) -> Column:
    """The coarsest level that still has SHARPNESS pixels of the map to a cell: the largest k up
    to that, the smallest where none is."""
    most = F.greatest(metres_per_pixel * SHARPNESS / base, F.lit(1.0))
    return F.coalesce(F.array_max(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k <= most)), F.lit(min(ks)))


def requested(store: DataFrame, requests: DataFrame) -> DataFrame:
    """The cells of the levels that ``requests(grp, k, year)`` name. There are no more
    different requests than levels and years, so they are broadcast."""
    asked = requests.select(*[F.col(c).cast("int").alias(c) for c in LEVEL]).distinct()
    return store.join(F.broadcast(asked), LEVEL)


def window(store: DataFrame, grp: int, k: int, years: list[int] | range, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """A window of one level in some years: folders by name, row groups by range."""
    level = store.filter((F.col("grp") == grp) & (F.col("k") == k) & F.col("year").isin(*years))
    return level.filter(F.col("iy").between(*rows) & F.col("ix").between(*cols))
