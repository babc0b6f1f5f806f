"""The field mask as a table of chunks that grows by what is asked for.

A chunk is ``side`` by ``side`` cells, its true cells as blocks of bits; a row a block, and
one row without bits for a chunk that has no field, so that it is known. The table is
partitioned by level and year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster as ops
from ..operators import vector
from . import zarr3

SCHEMA = "cy long, cx long, block long, bits binary, f int, year int"
KEY = ["cy", "cx"]


class MaskChunks:
    """Chunks at ``path`` of the array at ``array`` (level ``factor``), one year, band ``field``."""

    def __init__(self, spark: SparkSession, path: str, array: str, factor: int, year: int, side: int = vector.CHUNK, band: str = "field") -> None:
        self.spark, self.path, self.array, self.band, self.side = spark, path, array, band, side
        self.at = {"f": factor, "year": year}
        spark.createDataFrame([], SCHEMA).write.mode("append").partitionBy("f", "year").parquet(path)  # made if it isn't there

    def known(self) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        return rows.filter((F.col("f") == self.at["f"]) & (F.col("year") == self.at["year"])).drop("f", "year")

    def missing(self, asked: DataFrame) -> DataFrame:
        """The distinct chunks ``asked(cy, cx)`` that the table doesn't hold."""
        return asked.select(*KEY).distinct().join(self.known().select(*KEY).distinct(), KEY, "left_anti")

    def fill(self, asked: DataFrame) -> tuple[int, int, int, int] | None:
        """Read what is missing and append it; returns the chunk box ``(cy0, cy1, cx0, cx1)``
        that the read covered, none where nothing was missing. The box is that of the missing
        chunks alone; chunks within it that nobody asked for aren't kept."""
        gone = self.missing(asked)
        box = gone.agg(F.min("cy"), F.max("cy"), F.min("cx"), F.max("cx")).head()
        if box[0] is None:
            return None
        rows, cols = ((low * self.side, (high + 1) * self.side - 1) for low, high in (box[0:2], box[2:4]))
        cells = zarr3.read_window(self.spark, self.array, rows, cols, self.at["year"], self.band)
        true = cells.filter(F.col("value") >= ops.THRESHOLD).select("iy", "ix")
        packed = gone.join(vector.pack_mask(true, self.side), KEY, "left")
        new = packed.select(*KEY, "block", "bits", *[F.lit(v).alias(c) for c, v in self.at.items()])
        new.write.mode("append").partitionBy("f", "year").parquet(self.path)
        return tuple(box)

    def cells_of(self, asked: DataFrame) -> DataFrame:
        """``(cy, cx, iy, ix)`` of the true cells of the chunks asked for; a chunk without any
        has one row without a cell. Chunks that were never filled have none either."""
        held = asked.select(*KEY).distinct().join(self.known(), KEY, "left")
        cells = vector.unpack_mask(held.filter("bits is not null"), self.side)
        keyed = cells.select(F.floor(F.col("iy") / self.side).alias("cy"), F.floor(F.col("ix") / self.side).alias("cx"), "iy", "ix")
        return asked.select(*KEY).distinct().join(keyed, KEY, "left")
