"""Polygons, lines and places against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import fields as fld
from gridloom.operators import nearest, polylines
from gridloom.plans import field_queries

OUTLINE = [(0.0, 0.0), (9.0, 0.5), (9.0, 8.0), (5.0, 3.25), (0.5, 8.0), (0.0, 0.0)]
HOLE = [(2.0, 1.0), (3.0, 2.5), (4.0, 1.25), (2.0, 1.0)]
PART = [(10.0, 0.0), (12.0, 0.25), (11.0, 4.0), (10.0, 0.0)]
RINGS = "field long, rings array<array<struct<x:double,y:double>>>"


def _inside(rings, x, y):
    hit = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
    return hit


def _shifted(rings, dx, dy):
    return [[(x + dx, y + dy) for x, y in r] for r in rings]


def test_pixels_of_polygons_with_holes_and_parts(spark):
    rng = np.random.default_rng(2)
    blob = [(10 + (4 + 3 * rng.random()) * math.cos(a), 10 + (4 + 3 * rng.random()) * math.sin(a)) for a in np.linspace(0, 2 * math.pi, 30, endpoint=False)]
    shapes = [[OUTLINE], [OUTLINE, HOLE], [OUTLINE, HOLE, PART], _shifted([HOLE[::-1], OUTLINE[::-1]], -20.25, 3.5), [blob + blob[:1]], [[(0.2, 0.2), (0.4, 0.2), (0.3, 0.4), (0.2, 0.2)]], [], None, [[]], [[(1.0, 1.0)]]]
    found = fld.pixels_of(spark.createDataFrame(list(enumerate(shapes)), RINGS)).collect()
    want = {(i, y, x) for i, s in enumerate(shapes) if s for y in range(-5, 30) for x in range(-30, 30) if _inside(s, x + 0.5, y + 0.5)}
    assert len(found) == len(want)
    assert {(r.field, r.iy, r.ix) for r in found} == want
    assert {i for i, _, _ in want} == {0, 1, 2, 3, 4}


def test_area_takes_holes_off(spark):
    made = spark.createDataFrame([(1, [OUTLINE]), (2, [OUTLINE, HOLE]), (3, [HOLE]), (4, []), (5, [[(0.0, 0.0)]])], RINGS)
    found = {r.field: r.area for r in made.select("field", fld.area().alias("area")).collect()}
    assert found[2] == pytest.approx(found[1] - found[3])
    assert (found[4], found[5]) == (0, 0)


def test_matches_of_two_years(spark):
    cells = lambda name, x0, n: [(name, 0, x) for x in range(x0, x0 + n)]
    a = spark.createDataFrame([*cells(1, 0, 10), *cells(2, 20, 10), *cells(3, 40, 10)], "field long, iy long, ix long")
    b = spark.createDataFrame([*cells(101, 2, 10), *cells(102, 20, 3), *cells(104, 60, 5)], "field long, iy long, ix long")
    found = {(r.field, r.other, r.shared) for r in fld.matches(a, b).collect()}
    assert found == {(1, 101, 8), (2, None, 0), (3, None, 0), (None, 102, 0), (None, 104, 0)}
    years = lambda rows: spark.createDataFrame(rows, "field long, code int")
    changes = fld.field_changes(fld.matches(a, b), years([(1, 5), (2, 6)]), years([(101, 7), (104, 8)]))
    assert {(r.field, r.other, r.before, r.after, r.change) for r in changes.collect()} == {(1, 101, 5, 7, "changed"), (2, None, 6, None, "disappeared"), (3, None, None, None, "disappeared"), (None, 102, None, None, "appeared"), (None, 104, None, 8, "appeared")}


def test_sequences_and_pairs(spark):
    counts = spark.createDataFrame([(1, 2023, 5, 3), (1, 2024, 5, 2), (1, 2024, 4, 2), (2, 2024, 9, 1), (2, 2025, 8, 4), (2, 2025, 7, 3)], "field long, year int, code int, n long")
    years = fld.field_years(counts)
    assert {(r.field, r.year, r.code, r.most, r.total) for r in years.collect()} == {(1, 2023, 5, 3, 3), (1, 2024, 4, 2, 4), (2, 2024, 9, 1, 1), (2, 2025, 8, 4, 7)}
    assert {(r.field, r.seq, r.codes) for r in fld.sequences(years).collect()} == {(1, "5-4", 2), (2, "9-8", 2)}
    assert [(r.field, r.first, r.second) for r in fld.merged_pairs(counts, 2024, 5).collect()] == [(1, 4, 5), (2, 9, None)]


def test_a_box_reaches_the_scan_and_skips_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    shapes = [(i, _shifted([OUTLINE, HOLE], 20.0 * (i % 40), 20.0 * (i // 40))) for i in range(1600)]
    path = str(tmp_path / "fields")
    fld.write_polygons(spark.createDataFrame(shapes, RINGS).repartition(5), path, (0.0, 0.0, 800.0, 800.0), row_group=1 << 14)
    box = (105.0, 203.0, 131.0, 262.0)
    some = fld.read_polygons(spark, path, box)
    assert "bbox.xmin" in some._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    want = {i for i, s in shapes if min(x for x, _ in s[0]) < box[2] and max(x for x, _ in s[0]) > box[0] and min(y for _, y in s[0]) < box[3] and max(y for _, y in s[0]) > box[1]}
    assert {r.field for r in some.collect()} == want and want
    groups = met = 0
    for file in (tmp_path / "fields").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            stats = {c.path_in_schema: c.statistics for c in (meta.row_group(g).column(k) for k in range(meta.num_columns)) if c.path_in_schema.startswith("bbox")}
            groups += 1
            met += stats["bbox.xmin"].min < box[2] and stats["bbox.xmax"].max > box[0] and stats["bbox.ymin"].min < box[3] and stats["bbox.ymax"].max > box[1]
    assert groups >= 4 and met <= groups / 2


def _distance(p, line):
    best = math.inf
    for a, b in zip(line, line[1:]):
        d = np.subtract(b, a)
        t = min(1, max(0, np.subtract(p, a) @ d / (d @ d))) if d @ d else 0
        best = min(best, float(np.hypot(*(np.subtract(p, a) - t * d))))
    return best


def test_simplified_lines_stay_near(spark):
    rng = np.random.default_rng(3)
    walk = [tuple(p) for p in np.cumsum(rng.normal(0, 1, (2000, 2)), axis=0).tolist()]
    ring = [(math.cos(a) * 50, math.sin(a) * 50) for a in np.linspace(0, 2 * math.pi, 400)]
    ring[-1] = ring[0]
    lines = [walk, ring, [(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0)], [], None, [(1.0, 1.0)] * 4, [(float(x), 0.0) for x in range(500)]]
    made = spark.createDataFrame(list(enumerate(lines)), "id long, line array<struct<x:double,y:double>>")
    found = {r.id: None if r.less is None else [tuple(p) for p in r.less] for r in made.select("id", fld.simplified("line", 0.8).alias("less")).collect()}
    for i in (0, 1, 7):
        less = found[i]
        assert less[0] == lines[i][0] and less[-1] == lines[i][-1] and set(less) <= set(lines[i])
        assert max(_distance(p, less) for p in lines[i]) <= 0.8 + 1e-9
    assert len(found[0]) < 1500 and 8 < len(found[1]) < 60 and len(found[7]) == 2
    assert found[2] == lines[2] and found[3] == lines[3] and found[4] == [] and found[5] is None
    assert found[6] == [(1.0, 1.0)] * 2


def test_lines_are_cut_at_the_tiles_they_enter(spark):
    rng = np.random.default_rng(4)
    lines = [(i, [tuple(p) for p in rng.uniform(0, 6, (12, 2)).tolist()]) for i in range(20)] + [(50, [(0.5, 0.5), (0.6, 0.6)]), (51, [(0.5, 0.5), (3.5, 0.5), (0.5, 0.5)]), (52, [(1.0, 1.0)]), (53, []), (54, [(1.0, 1.0), (1.0, 3.0)])]
    made = spark.createDataFrame(lines, "id long, line array<struct<x:double,y:double>>")
    cut = polylines.cut_at_tiles(made).collect()
    for i, line in lines:
        own = [r for r in cut if r.id == i]
        length = sum(math.dist(a, b) for a, b in zip(line, line[1:]))
        assert sum(math.dist(a, b) for r in own for a, b in zip(r.line, r.line[1:])) == pytest.approx(length)
        assert all(-1e-9 <= v <= 1 + 1e-9 for r in own for p in r.line for v in p)
        steps = np.linspace(0, 1, 4001)[:, None]
        passed = {tuple(np.floor(p).astype(int)) for a, b in zip(line, line[1:]) for p in np.array(a) + steps * (np.array(b) - np.array(a)) if (np.abs(p - np.round(p)) > 1e-3).all()}
        assert passed <= {(r.tx, r.ty) for r in own}
    assert {(r.tx, r.ty, r.part) for r in cut if r.id == 51} == {(0, 0, 0), (0, 0, 1), (1, 0, 0), (1, 0, 1), (2, 0, 0), (2, 0, 1), (3, 0, 0)}
    cover = {(r.id, r.tx, r.ty) for r in polylines.tile_cover(made).collect()}
    assert cover == {(r.id, r.tx, r.ty) for r in cut}
    assert len({(x, y) for i, x, y in cover if i == 0}) < 36


def test_lines_of_states_and_tiles_are_one_list(spark):
    jobs = spark.createDataFrame([(1, s, 5, x, 0) for s in (0, 1) for x in (3, 4)] + [(2, 1, 5, 3, 0)], "request long, state long, z int, x long, y long")
    lines = spark.createDataFrame([(0, 5, 3, 0, 7, "a"), (1, 5, 3, 0, 8, "b"), (1, 5, 4, 0, 8, "c"), (1, 6, 3, 0, 9, "d")], "state long, z int, x long, y long, ring long, line string")
    assert sorted((r.request, r.line) for r in polylines.lines_of_tiles(jobs, lines).collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "b")]


def test_tile_units(spark):
    x, y = polylines.tile_units(F.lit(-98.0), F.lit(39.0), 7)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).head()
    n, rad = 128, math.radians(39)
    assert (r.x, r.y) == pytest.approx((82 / 360 * n, (1 - math.log(math.tan(rad) + 1 / math.cos(rad)) / math.pi) / 2 * n))


def test_nearest_places_by_rings_of_cells(spark):
    rng = np.random.default_rng(5)
    places = [(i, float(x), float(y), "ab"[i % 2]) for i, (x, y) in enumerate(rng.normal((-100, 40), (15, 4), (400, 2)))] + [(900, 170.0, -60.0, "far"), (901, 5.0, 5.0, None), (902, None, 5.0, "a")]
    asked = [(q, float(x), float(y), "ab"[q % 2]) for q, (x, y) in enumerate(rng.normal((-100, 40), (25, 8), (60, 2)))] + [(70, -170.0, 60.0, "far"), (71, 0.0, 0.0, "none"), (72, None, 1.0, "a"), (73, 0.0, 0.0, None)]
    asked += [(80, places[7][1], places[7][2], places[7][3])]
    found = nearest.nearest_places(spark.createDataFrame(asked, "q long, lon double, lat double, kind string"), spark.createDataFrame(places, "id long, lon double, lat double, kind string"), first=0.5).collect()
    want = {}
    for q, x, y, kind in asked:
        near = [((a - x) ** 2 + (b - y) ** 2, i) for i, a, b, k in places if kind is not None and k == kind and None not in (a, x)]
        if near:
            want[q] = min(near)[1]
    assert {r.q: r.id for r in found} == want and len(found) == len(want)
    none = spark.createDataFrame([], "q long, lon double, lat double, kind string")
    assert nearest.nearest_places(none, spark.createDataFrame(places, "id long, lon double, lat double, kind string")).collect() == []


def test_copies_of_a_shape_are_one_shape(spark):
    many = [(i, _shifted([OUTLINE], 20.0 * (i % 2), 0.0)) for i in range(10)]
    polygons = spark.createDataFrame(many, RINGS)
    shapes, members = fld.shapes_of(polygons)
    assert sorted(r.field for r in shapes.collect()) == [0, 1]
    assert sorted((r.field, r.shape) for r in members.collect()) == [(i, i % 2) for i in range(10)]
    (y0, y1), (x0, x1) = fld.cell_window(polygons)
    assert y0 <= 0 and y1 >= 7 and x0 <= 0 and x1 >= 28
    later = spark.createDataFrame([(100 + i, _shifted([OUTLINE], 20.0 * (i % 3), 0.0)) for i in range(6)], RINGS)
    after, others = fld.shapes_of(later)
    key = lambda df: sorted((r.field is None, r.field or 0, r.other or 0, r.shared) for r in df.collect())
    want = fld.matches(fld.pixels_of(polygons), fld.pixels_of(later))
    assert key(fld.with_copies(fld.matches(fld.pixels_of(shapes), fld.pixels_of(after)), members, others)) == key(want)


def test_pixels_are_never_broadcast(spark):
    # a small table of polygons may have very many pixels
    pixels = fld.pixels_of(spark.createDataFrame([(1, [OUTLINE])], RINGS))
    raster = spark.range(100).select(F.lit(2025).alias("year"), F.floor(F.col("id") / 10).alias("iy"), (F.col("id") % 10).alias("ix"), F.lit(3).alias("code"))
    for df in (fld.field_counts(pixels, raster), fld.matches(pixels, pixels), fld.of_members(pixels, spark.createDataFrame([(1, 1)], "field long, shape long"))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["polygon_majority", "polygon_merged", "polygon_purity", "polygon_size_by_crop", "polygon_sequences", "field_pixels"])
def test_rasters_are_never_broadcast(spark, name):
    # a window's area doesn't bound its rows: a raster may hold a cell more than once
    plan = field_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_places_and_cameras_at_one_point_meet_once(spark):
    places = spark.range(4000).select("id", (F.col("id") % 4 / 8).alias("lon"), F.lit(0.5).alias("lat"), F.lit("a").alias("kind"))
    asked = spark.range(3000).select(F.col("id").alias("q"), (F.col("id") % 2 / 10).alias("lon"), F.lit(0.5).alias("lat"), F.lit("a").alias("kind"))
    found = nearest.nearest_places(asked, places)
    assert {(r.q % 2, r.id) for r in found.collect()} == {(0, 0), (1, 1)} and found.count() == 3000
    files = [f for f in found.inputFiles() if "/part-" in f]
    assert spark.read.parquet(*files).count() < 100  # the points' answers, not a row for each camera


def test_request_totals_join_counts_of_tiles(spark):
    jobs = spark.createDataFrame([(1, s, 5, x, 0) for s in (0, 1) for x in (3, 4)] + [(2, 1, 5, 3, 0), (3, 9, 9, 9, 9)], "request long, state long, z int, x long, y long")
    lines = spark.createDataFrame([(0, 5, 3, 0, 7, [1, 2]), (1, 5, 3, 0, 8, [1, 2, 3]), (1, 5, 3, 0, 9, [1]), (1, 5, 4, 0, 8, [4] * 5), (1, 6, 3, 0, 9, [1])], "state long, z int, x long, y long, ring long, line array<int>")
    totals = polylines.tile_totals(jobs, lines)
    assert sorted(tuple(r) for r in totals.select("request", "states", "lines", "points").collect()) == [(1, 2, 4, 11), (2, 1, 2, 4)]
    assert "Broadcast" not in totals._jdf.queryExecution().executedPlan().toString()


def test_cutting_lines_shuffles_nothing(spark):
    made = spark.createDataFrame([(1, [(0.5, 0.5), (2.5, 0.5), (0.5, 0.5)]), (2, None), (3, [(0.5, 0.5), (float("nan"), 1.0), (0.6, 0.5), (0.7, 0.5)])], "id long, line array<struct<x:double,y:double>>")
    cut = polylines.cut_at_tiles(made)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert sorted((r.id, r.tx, r.part, len(r.line)) for r in cut.collect()) == [(1, 0, 0, 2), (1, 0, 1, 2), (1, 1, 0, 2), (1, 1, 1, 2), (1, 2, 0, 3), (3, 0, 0, 2)]
