import math
import struct
import zlib

import numpy as np

from gridloom.operators import render, vector
from gridloom.plans import queries
from gridloom.sources import views


def test_hilbert_ids_cover_a_zoom_and_neighbours_touch(spark):
    tiles = spark.range(64).selectExpr("3 as z", "id % 8 as x", "id div 8 as y")
    path = sorted((r.t, r.x, r.y) for r in tiles.select(vector.hilbert_id("z", "x", "y").alias("t"), "x", "y").collect())
    assert [p[0] for p in path] == list(range(21, 85))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(path, path[1:]))
    few = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0)], "z int, x int, y int")
    assert [r[0] for r in few.select(vector.hilbert_id("z", "x", "y")).collect()] == [0, 1, 2, 3, 4]


def test_points_in_a_concave_polygon(spark):
    ring = [(0.5, 0.5), (9.5, 0.5), (9.5, 9.5), (5.0, 2.0), (0.5, 9.5), (0.5, 0.5)]
    fields = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring]), (2, [])], "field int, ring array<struct<x double, y double>>")
    points = spark.createDataFrame([(1, 1.0, 6.0), (2, 5.0, 6.0), (3, 9.0, 6.0), (4, 11.0, 1.0)], "id int, x double, y double")
    assert {r.id for r in vector.points_in_polygons(points, fields, 3.0).collect()} == {1, 3}


def test_masks_round_trip_over_chunk_edges(spark):
    cells = {(int(y), int(x)) for y, x in np.random.default_rng(2).integers(-600, 1100, (300, 2))} | {(511, 512), (0, 0), (-1, -1)}
    df = spark.createDataFrame([(y, x) for y, x in cells], "iy long, ix long")
    assert {(r.iy, r.ix) for r in vector.unpack_mask(vector.pack_mask(df)).collect()} == cells


def test_box_join_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    boxes = [(i, float(w), float(s), float(w + a), float(s + b)) for i, (w, s, a, b) in enumerate(rng.integers(-20, 20, (40, 4)) * [1, 1, 0.2, 0.2] + [0, 0, 5, 5])]
    df = spark.createDataFrame(boxes, "id int, w double, s double, e double, n double")
    brute = {(p[0], q[0]) for p in boxes for q in boxes if p[1] < q[3] and p[3] > q[1] and p[2] < q[4] and p[4] > q[2]}
    found = [(r.a, r.b) for r in vector.box_join(df, df, 3.0).collect()]
    assert set(found) == brute and len(found) == len(brute)


def test_bounds(spark):
    df = spark.sql("select array(named_struct('lon', 3.0D, 'lat', 1.0D), named_struct('lon', -2.0D, 'lat', 5.0D)) as line")
    assert tuple(df.select(*vector.bounds("line")).head()) == (-2.0, 1.0, 3.0, 5.0)


def _pixels(png):
    assert png[:8] == b"\x89PNG\r\n\x1a\n"
    at, data = 8, b""
    while at < len(png):
        size, kind = struct.unpack_from(">I4s", png, at)
        body = png[at + 8 : at + 8 + size]
        assert struct.unpack_from(">I", png, at + 8 + size)[0] == zlib.crc32(kind + body)
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(256, 1025)[:, 1:].reshape(256, 256, 4)


def test_tiles_are_drawn(spark):
    kinds = views.classes(spark)
    pixels = spark.createDataFrame([(7, 0, 0, 3), (7, 255, 1, 0), (7, 5, 5, 4), (8, 1, 1, 0)], "tile long, px int, py int, code int")
    lines = spark.createDataFrame([(7, [{"x": 5.0, "y": 5.0}, {"x": 5.0, "y": 8.0}, {"x": 900.0, "y": 8.0}])], "tile long, line array<struct<x double, y double>>")
    found = {r.tile: r for r in render.render_tiles(pixels, kinds, lines).collect()}
    image = _pixels(bytes(found[7].png))
    colour = kinds.filter("code = 3").head().hex
    assert image[0, 0].tolist() == [int(colour[i : i + 2], 16) for i in (1, 3, 5)] + [255]
    assert image[5, 5].tolist() == [40, 40, 40, 210] and image[8, 255].tolist() == [40, 40, 40, 210] and image[1, 255, 3] == 0
    assert found[8].drawn == 0 and found[7].drawn == 1 + 4 + 250


def test_overlap_of_all_tiles_on_both_axes(spark, tmp_path):
    spark.range(4000).selectExpr("id as event_id", "id % 7 as user_id", "timestamp_seconds(id) as ts").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(80).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    boxes = {}
    for i in range(4000):
        side = 2 ** (3 + i % 13)
        x, y = i * 7919 % side, i * 104729 % side
        north, south = (math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v / side)))) for v in (y, y + 1))
        boxes[i] = (x / side * 360 - 180, south, (x + 1) / side * 360 - 180, north)
    meet = lambda a, b: a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1]
    states = {k: (-125.0 + k % 50, 25 + k * 91 % 2400 / 100, -123.0 + k % 50, 27 + k * 91 % 2400 / 100) for k in range(60)}
    found = [tuple(r) for r in queries.state_overlap(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted((i, k) for i, b in boxes.items() for k, state in states.items() if meet(b, state))
    assert max(found)[0] >= 2000
    assert sorted(r.id for r in queries.request_domain(spark, str(tmp_path)).collect()) == [i for i, b in boxes.items() if meet(b, (-125.0, 24.0, -66.5, 49.8))]
