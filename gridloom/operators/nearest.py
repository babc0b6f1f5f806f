"""The nearest place to each camera, by rings of cells.

Cells around a camera are searched small ones first: of nine cells of a width, all places
within that width are sure to be seen. A camera whose nearest place so far lies within it is
done; the others go on with cells four times as wide. So a camera meets the places around it,
not all places of its kind, however many there are. Cameras at one point that ask for one
kind are searched for once, and of a kind's places at one point only the smallest id can win.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.objects import written

#: Degrees of the first cells, and of those whose nine cover the world; bytes of a broadcast.
FIRST, LAST, GROWTH, BROADCAST_BYTES, ROW_BYTES = 0.25, 360.0, 4, 16 << 20, 64


def nearest_places(asked: DataFrame, places: DataFrame, first: float = FIRST) -> DataFrame:
    """``asked(q, lon, lat, kind)`` and ``places(id, lon, lat, kind)`` -> ``(q, id, away)``: the
    place of the kind asked for that is nearest, by squared degrees, ties to the smaller id.
    A camera whose kind has no place has no row, nor has one without a position or kind."""
    point = ["at", "up", "kind"]
    some = asked.select("q", F.col("lon").alias("at"), F.col("lat").alias("up"), "kind").dropna()
    left, found, width = written(some.select(*point).distinct()), [], first
    n = left.count()
    known = written(places.select("id", "lon", "lat", "kind").dropna().groupBy("lon", "lat", "kind").agg(F.min("id").alias("id")))
    while n:
        cell = lambda c, w=width: F.floor(F.col(c) / w)
        around = [F.explode(F.sequence(cell(c) - 1, cell(c) + 1)).alias(name) for c, name in (("at", "cx"), ("up", "cy"))]
        near = left.select("*", around[0]).select("*", around[1])
        near = near.hint("broadcast" if 9 * n * ROW_BYTES <= BROADCAST_BYTES else "merge")
        dealt = known.withColumn("cx", cell("lon")).withColumn("cy", cell("lat"))
        east, north = F.col("lon") - F.col("at"), F.col("lat") - F.col("up")
        pairs = dealt.join(near, ["kind", "cx", "cy"]).select(*point, "id", (east * east + north * north).alias("away"))
        best = pairs.groupBy(*point).agg(F.min(F.struct("away", "id")).alias("b")).select(*point, "b.id", "b.away")
        sure = written(best.filter(F.col("away") <= width * width) if width < LAST else best)
        found.append(sure)
        if width >= LAST:
            break
        left = written(left.hint("merge").join(sure.select(*point), point, "left_anti"))
        n, width = left.count(), width * GROWTH
    if not found:
        return left.select(F.lit(None).cast(some.schema["q"].dataType).alias("q"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("away"))
    return some.hint("merge").join(reduce(DataFrame.unionByName, found), point).select("q", "id", "away")
