"""Lattices and boxes against plain arithmetic."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.operators import lattice


def test_projected_box_bows_beyond_the_corners(spark):
    box = F.struct(F.lit(-110.0).alias("w"), F.lit(35.0).alias("s"), F.lit(-82.0).alias("e"), F.lit(40.0).alias("n"))
    corners = [geo.albers(F.lit(x), F.lit(y)) for x in (-110.0, -82.0) for y in (35.0, 40.0)]
    row = spark.range(1).select(lattice.albers_box(box).alias("b"), *[F.struct(x.alias("x"), y.alias("y")).alias(f"c{i}") for i, (x, y) in enumerate(corners)]).head()
    south = min(row[f"c{i}"].y for i in range(4))
    assert row.b.y0 < south - 10_000 and row.b.x0 == pytest.approx(min(row[f"c{i}"].x for i in range(4)))
    world = F.struct(F.lit(-130.0).alias("w"), F.lit(20.0).alias("s"), F.lit(-60.0).alias("e"), F.lit(52.0).alias("n"))
    clamped = spark.range(1).select(lattice.albers_box(world).alias("b")).head().b
    assert (clamped.x0, clamped.y0, clamped.x1, clamped.y1) == lattice.RASTER_EXTENT


def test_samples_are_centres_from_the_north(spark):
    box = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s"), F.lit(4.0).alias("e"), F.lit(2.0).alias("n"))
    rows = lattice.samples(spark.range(1).select(box.alias("box")), F.lit(4), F.lit(2)).collect()
    assert sorted((r.i, r.j, r.lat, r.lon) for r in rows) == [(i, j, 1.5 - i, j + 0.5) for i in range(2) for j in range(4)]


def test_view_sizes_stay_within_bounds(spark):
    zooms = spark.createDataFrame([(1.0,), (9.0,), (22.0,)], "zoom double").withColumn("box", lattice.view_box(F.lit(-96.0), F.lit(40.0), F.col("zoom")))
    nx, ny = lattice.view_size(F.col("box"), 30.0)
    rows = zooms.select("zoom", nx.alias("nx"), ny.alias("ny"), "box").orderBy("zoom").collect()
    assert (rows[0].nx, rows[0].ny) == (2000, 2000) and (rows[2].nx, rows[2].ny) == (8, 8)
    span = 360 / (512 * 2**9)
    assert rows[1].box.e - rows[1].box.w == pytest.approx(1400 * span * 1.35)
    assert rows[1].box.n - rows[1].box.s == pytest.approx(700 * span * math.cos(math.radians(40)) * 1.35)


def test_positions_are_truncated_in_the_raster_and_floored_in_the_mask(spark):
    x0, _, _, y1 = lattice.RASTER_EXTENT
    cells = spark.createDataFrame([(0, 0, 7), (0, 1, 9)], "iy int, ix int, code int")
    rows = spark.createDataFrame([(x0 - 10, y1 - 1), (x0 + 35, y1 + 29), (x0 - 31, y1 - 1)], "x double, y double")
    found = rows.select("x", geo.raster_cell(F.col("x"), x0, 30).alias("ix"), geo.raster_cell(y1 - F.col("y"), 0.0, 30).alias("iy")).join(cells, ["iy", "ix"], "left")
    assert {round(r.x - x0): r.code for r in found.collect()} == {-10: 7, 35: 9, -31: None}
    iy, ix = geo.grid_cell(F.lit(-180.00001), F.lit(geo.GRID_TOP + 0.00001), 4)
    assert spark.range(1).select(iy.alias("a"), ix.alias("b")).head() == (-1, -1)


def test_series_is_filled_and_drops_years_without_any(spark):
    counts = spark.createDataFrame([(2020, 1, 4), (2021, 2, 8), (2022, 5, 3)], "year int, code int, n long")
    top = spark.createDataFrame([(1,), (2,)], "code int")
    rows = lattice.timelapse_series(counts, top).collect()
    assert sorted(map(tuple, rows)) == [(2020, 1, 4, 0.5), (2020, 2, 0, 0.0), (2021, 1, 0, 0.0), (2021, 2, 8, 1.0)]
    assert lattice.timelapse_series(counts.filter("false"), top).collect() == []


def test_zoom_and_label(spark):
    row = spark.range(1).select(
        geo.span_zoom(F.lit(0.0), F.lit(0.001), F.lit(0.001), F.lit(0.0)).alias("near"), geo.span_zoom(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(0.0)).alias("none"),
        geo.span_zoom(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0)).alias("wide"), geo.place_label(F.lit("A"), F.lit(None).cast("string"), F.lit("C"), F.lit("q")).alias("label"),
        geo.place_label(F.lit(""), F.lit(None).cast("string"), F.lit(""), F.lit("q")).alias("empty"),
    ).head()
    assert (row.near, row.none, row.label, row.empty) == (13.5, 10.0, "A, C", "q")
    assert row.wide == pytest.approx(math.log2(360 * 1400 / 512 / 10) - 0.3)
