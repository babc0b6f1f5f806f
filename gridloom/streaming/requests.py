"""Tile requests as a stream: micro-batches that serve what no earlier batch has.

Requests are ``(z, x, y, state)``; a served tile is a row of a Parquet table, which is the
cache; which keys it holds is Spark's streaming state. A trigger's interval stands for the
time that a batch stays open.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

KEY = ["z", "x", "y", "state"]
VIEW_TILES = 80
#: How often a tile whose batch fails is tried in all.
TRIES = 3

CONTROL = "act string, year int, fields boolean, dis boolean, crops boolean, sel array<int>, q string, n long"


def control(messages: DataFrame, message: str = "message") -> DataFrame:
    """Control messages with defaults for what is missing, null or unreadable."""
    c = F.from_json(message, CONTROL)
    flag = lambda name: F.coalesce(c[name], F.lit(False)).alias(name)
    sel = F.array_sort(F.array_distinct(F.coalesce(c["sel"], F.array().cast("array<int>"))))
    return messages.select(
        "*", F.coalesce(c["act"], F.lit("set")).alias("act"), F.coalesce(c["year"], F.lit(2025)).alias("year"), flag("fields"), flag("dis"), flag("crops"),
        sel.alias("sel"), F.coalesce(c["q"], F.lit("")).alias("q"), F.coalesce(c["n"], F.lit(0)).alias("n"),
    )


def view_tiles(views: DataFrame) -> DataFrame:
    """``(z, state, x0, x1, y0, y1)`` -> the views' tile keys; a view over more than
    VIEW_TILES tiles isn't fetched ahead."""
    tiles = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    some = views.filter(tiles.between(1, VIEW_TILES)).withColumn("x", F.explode(F.sequence("x0", "x1")))
    return some.withColumn("y", F.explode(F.sequence("y0", "y1"))).select(*KEY)


def missing(requests: DataFrame, served: DataFrame | None, views: DataFrame | None = None) -> DataFrame:
    """Distinct keys of requests and views that aren't served yet."""
    keys = requests.select(*KEY)
    if views is not None:
        keys = keys.unionByName(view_tiles(views))
    keys = keys.distinct()
    return keys if served is None else keys.join(served.select(*KEY), KEY, "left_anti")


def last_by_state(lines: DataFrame) -> DataFrame:
    """``(state, id, line, legend)`` as a stream or table -> the newest line and legend of every
    state. As a stream (output mode ``complete`` or ``update``) only these are state."""
    newest = F.max_by(F.struct("line", "legend"), "id")
    return lines.groupBy("state").agg(F.max("id").alias("id"), newest.alias("n")).select("state", "id", "n.line", "n.legend")


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def failures(spark: SparkSession, path: str, key: StructType) -> DataFrame:
    """Keys whose rendering failed and hasn't succeeded since: ``KEY, tries, error, batch``, and
    whether they were given up."""
    schema = StructType([*key.fields, *StructType.fromDDL("tries int, error string, batch long").fields])
    found = [
        spark.read.schema(schema).parquet(f"{path}/{kind}").withColumn("given_up", F.lit(kind == "given-up"))
        for kind in ("failed", "given-up") if _there(spark, f"{path}/{kind}")
    ]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], StructType([*schema.fields, *StructType.fromDDL("given_up boolean").fields]))


def serve(requests: DataFrame, render: Callable[[DataFrame], DataFrame], path: str, schema: str, checkpoint: str, interval: str | None = None, views: DataFrame | None = None, tries: int = TRIES) -> StreamingQuery:
    """Start serving the streams ``requests`` and, if given, ``views`` (fetched ahead).

    Keys that came before are known to Spark's state store, so no batch reads what others
    wrote. A batch first writes the keys that it has to render, then renders them at once
    (``render(keys)`` gives rows of ``schema``, keys included) into a folder of its own. If that
    fails, the keys and the error are recorded below ``failed`` and the stream goes on: the next
    batches render them as well, ``tries`` times in all. A batch that Spark runs again, after
    the driver was lost, finds its keys and overwrites its folder: nothing is lost or doubled.
    """
    spark = requests.sparkSession
    keys = requests.select(*KEY)
    if views is not None:
        keys = keys.unionByName(view_tiles(views))

    def batch(rows: DataFrame, number: int) -> None:
        asked = f"{path}/asked/batch={number}"
        with_tries = StructType([*rows.schema.fields, *StructType.fromDDL("tries int, from long").fields])
        if not _there(spark, f"{asked}/_SUCCESS"):
            again = failures(spark, path, rows.schema).filter((F.col("batch") < number) & ~F.col("given_up"))
            new = rows.select("*", F.lit(0).alias("tries"), F.lit(None).cast("long").alias("from"))
            new.unionByName(again.select(*KEY, "tries", F.col("batch").alias("from"))).write.mode("overwrite").parquet(asked)
        else:  # a batch that runs again; its rows have to pass all the same, for the state's sake
            rows.write.format("noop").mode("overwrite").save()
        todo = spark.read.schema(with_tries).parquet(asked)
        earlier = [r["from"] for r in todo.filter(F.col("from").isNotNull()).select("from").distinct().collect()]  # batches that failed
        try:
            render(todo.select(*KEY)).write.mode("overwrite").parquet(f"{path}/tiles/batch={number}")
        except Exception as error:  # whatever a renderer raises: it's recorded, and others' requests go on
            told = todo.select(*KEY, (F.col("tries") + 1).alias("tries"), F.lit(f"{type(error).__name__}: {error}"[:1000]).alias("error"))
            for kind, some in (("failed", F.col("tries") < tries), ("given-up", F.col("tries") >= tries)):
                told.filter(some).write.mode("overwrite").parquet(f"{path}/{kind}/batch={number}")
        for n in earlier:
            _remove(spark, f"{path}/failed/batch={n}")

    writer = keys.dropDuplicates(KEY).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
