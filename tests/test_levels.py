"""The level store, windows of look-ups, the mask's chunk table and texts for the client."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.operators import lattice, raster
from gridloom.sources import levels, mask_chunks, zarr3


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("levels") / "store")
    cells = spark.range(60 * 60).select(F.expr("id div 60").alias("iy"), (F.col("id") % 60).alias("ix"))
    fine = cells.withColumn("year", F.explode(F.array(F.lit(2024), F.lit(2025)))).withColumn("code", ((F.col("iy") * 7 + F.col("ix") * 3 + F.col("year")) % 5 + 1).cast("int"))
    levels.write_levels(fine, path, 30, [1, 2, 4])
    levels.write_levels(fine.filter("year = 2025"), path, 10, [1, 2])
    return path


def test_levels_are_folders_of_majorities(spark, store):
    found = levels.read_levels(spark, store)
    sizes = {(r.grp, r.k, r.year): r["count"] for r in found.groupBy("grp", "k", "year").count().collect()}
    assert sizes == {**{(30, k, y): (60 // k) ** 2 for k in (1, 2, 4) for y in (2024, 2025)}, **{(10, k, 2025): (60 // k) ** 2 for k in (1, 2)}}
    block = [(y * 7 + x * 3 + 2024) % 5 + 1 for y in range(8, 12) for x in range(4, 8)]
    best = max(set(block), key=lambda c: (block.count(c), -c))
    assert found.filter("grp = 30 and k = 4 and year = 2024 and iy = 2 and ix = 1").head().code == best


def test_levels_that_do_not_divide_each_other(spark, tmp_path):
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 4, (13, 17))
    rows = [(2024, y, x, int(codes[y, x])) for y in range(13) for x in range(17)]
    levels.write_levels(spark.createDataFrame(rows, "year int, iy long, ix long, code int"), str(tmp_path / "s"), 30, [1, 2, 3, 6])
    for k in (1, 2, 3, 6):
        found = {(r.iy, r.ix): r.code for r in levels.read_levels(spark, str(tmp_path / "s")).filter(F.col("k") == k).collect()}
        want = {}
        for y in range(0, 13, k):
            for x in range(0, 17, k):
                n = np.bincount(codes[y : y + k, x : x + k].ravel(), minlength=4)
                want[y // k, x // k] = int(n.argmax())
        assert found == want


def test_levels_shuffle_the_raster_once(spark, tmp_path):
    tracker = spark.sparkContext.statusTracker()
    cells = spark.range(40_000).select(F.lit(2025).alias("year"), F.expr("id div 200").alias("iy"), (F.col("id") % 200).alias("ix"), (F.col("id") % 7 + 1).cast("int").alias("code"))
    spark.sparkContext.setJobGroup("once", "levels")
    try:
        levels.write_levels(cells, str(tmp_path / "s"), 30, [1, 2, 4])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    seen = {s for j in tracker.getJobIdsForGroup("once") for s in tracker.getJobInfo(j).stageIds}
    assert len(seen) <= 7  # bounds and shuffles of the raster and of what is counted, and one write; it was a few for each level
    sizes = {r.k: r["count"] for r in levels.read_levels(spark, str(tmp_path / "s")).groupBy("k").count().collect()}
    assert sizes == {1: 40_000, 2: 10_000, 4: 2_500}


def final_plan(df):
    """The plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("ks", [[1, 2, 4], [2, 4], [1]])
def test_levels_read_one_shuffle(spark, ks):
    cells = spark.range(3600).select(F.lit(2025).alias("year"), F.expr("id div 60").alias("iy"), (F.col("id") % 60).alias("ix"), (F.col("id") % 7).cast("int").alias("code"))
    shuffles = [x for x in final_plan(levels.all_levels(cells, 30, ks)).splitlines() if "Exchange" in x and "ReusedExchange" not in x]
    assert len(shuffles) == 1 and "rangepartitioning" in shuffles[0]


def test_made_levels_share_one_read_and_one_sort(spark):
    cells = spark.range(3600).select(F.lit(2025).alias("year"), F.expr("id div 60").alias("iy"), (F.col("id") % 60).alias("ix"), (F.col("id") % 7).cast("int").alias("code"))
    plan = final_plan(levels.all_levels(cells, 30, [1, 2, 4, 8])).splitlines()
    assert len([x for x in plan if "ShuffleQueryStage" in x]) == 2  # the raster and the levels made of it; it was one for each level
    assert len([x for x in plan if " Sort [" in x]) == 1


def test_odd_cells_keep_their_levels(spark):
    rows = [(2025, 0, 0, None), (2025, 0, 1, None), (2025, 1, 0, 5), (2025, 1, 1, 9)]  # no code is a code: the commonest here
    rows += [(2025, 0, 2, None), (2025, 0, 3, 8), (2025, 1, 2, 7)]  # but the last among as many
    rows += [(2025, 2, 0, 3), (2025, 2, 0, 3), (2025, 3, 1, 2)]  # a cell that comes twice counts twice
    rows += [(2025, None, 0, 4), (2025, None, 1, 4), (2025, -1, -1, 6), (None, 0, 0, 1)]
    made = levels.all_levels(spark.createDataFrame(rows, "year int, iy long, ix long, code int"), 30, [1, 2, 4])
    found = sorted(((r.k, r.year, r.iy, r.ix, r.code) for r in made.collect()), key=str)
    want = [(1, *r) for r in rows]
    want += [(2, 2025, 0, 0, None), (2, 2025, 0, 1, 7), (2, 2025, 1, 0, 3), (2, 2025, None, 0, 4), (2, 2025, -1, -1, 6), (2, None, 0, 0, 1)]
    want += [(4, 2025, 0, 0, None), (4, 2025, None, 0, 4), (4, 2025, -1, -1, 6), (4, None, 0, 0, 1)]
    assert found == sorted(want, key=str)


def test_requests_prune_folders(spark, store, tmp_path):
    spark.createDataFrame([(30, 2, 2025, "x"), (30, 2, 2025, "y")], "grp int, k int, year int, who string").write.parquet(str(tmp_path / "asked"))
    asked = spark.read.parquet(str(tmp_path / "asked"))
    found = levels.requested(levels.read_levels(spark, store), asked.filter("who > 'a'"))
    found.collect()
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    assert found.count() == 900 and found.select("k", "year").distinct().count() == 1


def test_windows_reach_the_scan(spark, store):
    found = levels.window(levels.read_levels(spark, store), 30, 1, [2025], (10, 19), (5, 8))
    plan = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(iy,10)" in plan and "LessThanOrEqual(ix,8)" in plan
    assert "PartitionFilters" in plan and "year" in plan.split("PartitionFilters")[1].split("]")[0]
    assert found.count() == 40


def test_pick_level(spark):
    rows = spark.createDataFrame([(m,) for m in (5.0, 30.0, 60.0, 90.0, 900.0)], "m double")
    assert [r.k for r in rows.select(levels.pick_level(F.col("m"), 30.0, [1, 2, 4]).alias("k")).collect()] == [1, 1, 2, 4, 4]


@pytest.mark.parametrize("box", [(-125.0, 24.0, -66.0, 50.0), (-96.5, 30.0, -95.5, 31.0), (-120.0, 35.0, -119.0, 36.0), (-80.0, 40.0, -70.0, 45.0)])
def test_projected_bounds_hold_every_point(spark, box):
    w, s, e, n = box
    made = spark.range(1).select(F.struct(*[F.lit(v).alias(k) for k, v in zip("wsen", box, strict=True)]).alias("box"))
    b = made.select(lattice.projected_bounds(F.col("box")).alias("b")).head().b
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    grid = spark.range(41 * 41).select((w + (e - w) * (F.col("id") % 41) / 40).alias("lon"), (s + (n - s) * F.floor(F.col("id") / 41) / 40).alias("lat")).select(x.alias("x"), y.alias("y"))
    r = grid.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).head()
    assert b.x0 <= r[0] + 1e-6 and b.y0 <= r[1] + 1e-6 and b.x1 >= r[2] - 1e-6 and b.y1 >= r[3] - 1e-6
    rows, cols = lattice.raster_window(made, 30.0)
    x0, _, _, y1 = lattice.RASTER_EXTENT
    assert rows[0] <= (y1 - r[3]) / 30 and rows[1] >= (y1 - r[1]) / 30 and cols[0] <= (r[0] - x0) / 30 and cols[1] >= (r[2] - x0) / 30
    assert rows[1] - rows[0] <= (r[3] - r[1]) / 30 * 1.2 + 60  # and not much more


def test_windows_without_boxes_are_empty(spark):
    none = spark.createDataFrame([], "box struct<w:double,s:double,e:double,n:double>")
    assert lattice.raster_window(none, 30.0) == lattice.grid_window(none, 4) == ((0, -1), (0, -1))


def test_small_windows_are_broadcast_and_large_ones_are_not(spark):
    cells = spark.range(10).select(F.col("id").alias("iy"), F.col("id").alias("ix"))
    hint = lambda w, n=1: "broadcast" in lattice.within(cells, w, n)._jdf.queryExecution().analyzed().toString().lower()
    assert hint(((0, 99), (0, 99))) and not hint(((0, 999), (0, 999))) and not hint(((0, 99), (0, 99)), 1000)
    assert lattice.within(cells, ((3, 5), (4, 9))).count() == 2


def test_nearest_level():
    assert [lattice.nearest_level(r, [1, 2, 4, 8]) for r in (0.3, 1.0, 1.4, 1.5, 3.0, 100.0)] == [1, 1, 1, 2, 4, 8]


def test_the_chunk_table_reads_only_what_is_missing(spark, tmp_path):
    cells = spark.range(64 * 64).select(F.lit(2024).alias("year"), F.lit("field").alias("band"), F.expr("id div 64").alias("iy"), (F.col("id") % 64).alias("ix"))
    cells = cells.withColumn("value", F.when((F.col("iy") < 16) & (F.col("ix") < 16), 0.1).otherwise((F.col("iy") + F.col("ix")) % 10 / 10.0))
    zarr3.write_cells(cells, str(tmp_path / "g"), "v", [2024], ["field"], (64, 64), (32, 32), (16, 16))
    table = mask_chunks.MaskChunks(spark, str(tmp_path / "chunks"), str(tmp_path / "g/v"), 4, 2024, side=16)
    ask = lambda *c: spark.createDataFrame(list(c), "cy long, cx long")
    assert table.fill(ask((0, 0), (0, 1), (0, 1))) == (0, 0, 0, 1)
    assert table.fill(ask((0, 0), (0, 1))) is None  # the first has no field, and is known all the same
    assert table.fill(ask((0, 1), (2, 3), (3, 2))) == (2, 3, 2, 3)
    assert {(r.cy, r.cx) for r in table.known().collect()} == {(0, 0), (0, 1), (2, 3), (3, 2)}  # (2, 2) wasn't asked for
    found = table.cells_of(ask((0, 0), (0, 1), (3, 2))).collect()
    assert {(r.iy, r.ix) for r in found if r.iy is not None} == {(y, x) for y, x in [*[(y, x) for y in range(16) for x in range(16, 32)], *[(y, x) for y in range(48, 64) for x in range(32, 48)]] if (y + x) % 10 >= 5}
    assert [(r.cy, r.cx) for r in found if r.iy is None] == [(0, 0)]


def test_legends_go_by_count(spark):
    rows = spark.createDataFrame([(1, "a", "#1", 10.0, 100), (2, "b", "#2", 10.0, 101), (3, "c", "#3", 80.0, 900)], "code int, name string, hex string, pct double, n long")
    assert [r["code"] for r in json.loads(lattice.legend_json(rows).head().legend)] == [3, 2, 1]


def test_selected_classes_do_not_change_the_counts(spark):
    cells = spark.createDataFrame([(1,), (1,), (2,), (3,)], "code int")
    picked = raster.select_classes(cells, spark.createDataFrame([(1,), (9,)], "code int"))
    assert sorted((r.code, r.shown) for r in picked.collect()) == [(1, 1), (1, 1), (2, 0), (3, 0)]
    assert {r.code == r.shown for r in raster.select_classes(cells, spark.createDataFrame([], "code int")).collect()} == {True}
