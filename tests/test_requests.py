from pyspark.sql import functions as F

from gridloom.streaming import requests

SCHEMA = "z int, x long, y long, state int, png string"


def test_control_defaults(spark):
    rows = [("",), (None,), ("{no",), ('{"year": 2012, "sel": [5, 1, 5], "dis": true}',)]
    found = requests.control(spark.createDataFrame(rows, "message string")).collect()
    assert [(r.act, r.year, r.dis, r.sel) for r in found] == [("set", 2025, False, [])] * 3 + [("set", 2012, True, [1, 5])]


def test_prefetch_skips_wide_views(spark):
    views = spark.createDataFrame([(5, 0, 0, 7, 0, 9), (5, 1, 0, 8, 0, 8)], "z int, state int, x0 long, x1 long, y0 long, y1 long")
    assert requests.view_tiles(views).groupBy("state").count().collect() == [(0, 80)]


def test_served_tiles_are_not_served_again(spark, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"

    def ask(keys):
        spark.createDataFrame(keys, "z int, x long, y long, state int").coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema("z int, x long, y long, state int").parquet(str(inbox))
        requests.serve(stream, lambda k: k.withColumn("png", F.lit("tile")), str(out), SCHEMA, str(tmp_path / "log")).awaitTermination(60)

    ask([(4, 1, 1, 0), (4, 1, 1, 0), (4, 2, 1, 0)])
    ask([(4, 1, 1, 0), (4, 1, 1, 1)])
    served = spark.read.parquet(str(out / "tiles"))
    assert sorted((r.x, r.state, r.batch) for r in served.collect()) == [(1, 0, 0), (1, 1, 1), (2, 0, 0)]


KEYS = "z int, x long, y long, state int"


def _ask(spark, inbox, keys):
    spark.createDataFrame(keys, KEYS).coalesce(1).write.mode("append").parquet(str(inbox))


def test_a_failing_batch_is_recorded_and_tried_again(spark, tmp_path):
    inbox, out, calls = tmp_path / "in", str(tmp_path / "out"), []

    def render(keys):
        calls.append(keys.count())
        if len(calls) in (1, 3):
            raise ValueError("no tiles today")
        return keys.withColumn("png", F.lit("tile"))

    def run():
        stream = spark.readStream.schema(KEYS).parquet(str(inbox))
        requests.serve(stream, render, out, SCHEMA, str(tmp_path / "log")).awaitTermination(60)
        key = spark.createDataFrame([], KEYS).schema
        return sorted((r.x, r.tries, r.batch, "no tiles" in r.error) for r in requests.failures(spark, out, key).collect())

    _ask(spark, inbox, [(4, 1, 1, 0), (4, 2, 1, 0)])
    assert run() == [(1, 1, 0, True), (2, 1, 0, True)]
    _ask(spark, inbox, [(4, 2, 1, 0), (4, 3, 1, 0)])  # 2 was asked for before, and has failed
    assert run() == []
    _ask(spark, inbox, [(4, 9, 1, 0)])
    assert run() == [(9, 1, 2, True)]
    _ask(spark, inbox, [(4, 3, 1, 0), (4, 4, 1, 1)])
    assert run() == []
    assert calls == [2, 3, 1, 2]
    served = spark.read.parquet(f"{out}/tiles")
    assert sorted((r.x, r.batch) for r in served.collect()) == [(1, 1), (2, 1), (3, 1), (4, 3), (9, 3)]


def test_tiles_that_always_fail_are_given_up(spark, tmp_path):
    inbox, out, seen = tmp_path / "in", str(tmp_path / "out"), []

    def render(keys):
        xs = sorted(r.x for r in keys.collect())
        seen.append(xs)
        if 1 in xs:
            raise ValueError("tile 1")
        return keys.withColumn("png", F.lit("tile"))

    for x in (1, 5, 6):
        _ask(spark, inbox, [(4, x, 1, 0)])
        stream = spark.readStream.schema(KEYS).parquet(str(inbox))
        requests.serve(stream, render, out, SCHEMA, str(tmp_path / "log"), tries=2).awaitTermination(60)
    assert seen == [[1], [1, 5], [5, 6]]
    left = requests.failures(spark, out, spark.createDataFrame([], KEYS).schema)
    assert [(r.x, r.tries, r.given_up) for r in left.collect()] == [(1, 2, True)]
    assert sorted(r.x for r in spark.read.parquet(f"{out}/tiles").collect()) == [5, 6]


def test_a_batch_that_runs_again_does_not_double(spark, tmp_path):
    """The log of the last batch's end is lost, as when the driver is: Spark runs it again."""
    inbox, out, log = tmp_path / "in", str(tmp_path / "out"), tmp_path / "log"

    def run():
        stream = spark.readStream.schema(KEYS).parquet(str(inbox))
        requests.serve(stream, lambda k: k.withColumn("png", F.lit("tile")), out, SCHEMA, str(log)).awaitTermination(60)

    _ask(spark, inbox, [(4, 1, 1, 0)])
    run()
    _ask(spark, inbox, [(4, 2, 1, 0)])
    run()
    for name in ("1", ".1.crc"):
        (log / "commits" / name).unlink(missing_ok=True)
    run()
    assert sorted((r.x, r.batch) for r in spark.read.parquet(f"{out}/tiles").collect()) == [(1, 0), (2, 1)]


def test_views_are_fetched_ahead_as_a_stream(spark, tmp_path):
    inbox, seen = tmp_path / "in", tmp_path / "views"
    _ask(spark, inbox, [(5, 1, 1, 0)])
    spark.createDataFrame([(5, 0, 0, 2, 0, 1)], "z int, state int, x0 long, x1 long, y0 long, y1 long").write.parquet(str(seen))
    views = spark.readStream.schema("z int, state int, x0 long, x1 long, y0 long, y1 long").parquet(str(seen))
    stream = spark.readStream.schema(KEYS).parquet(str(inbox))
    requests.serve(stream, lambda k: k.withColumn("png", F.lit("tile")), str(tmp_path / "out"), SCHEMA, str(tmp_path / "log"), views=views).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out/tiles")).count() == 6


def test_last_status_of_a_stream(spark, tmp_path):
    schema = "state int, id long, line string, legend string"
    rows = [(0, 1, "a", "x"), (1, 2, "b", "y"), (0, 3, "c", "z")]
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = requests.last_by_state(stream).writeStream.format("memory").queryName("last_lines").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("last_lines").collect())) == [(0, 3, "c", "z"), (1, 2, "b", "y")]
