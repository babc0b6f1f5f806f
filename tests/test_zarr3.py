"""Sharded arrays: written, read by ranges, and read where another writer's layout differs."""

import gzip
import json
import math

import numpy as np
import pytest

from gridloom.sources import objects, zarr3

SIZE, SHARD, CHUNK = (50, 70), (16, 24), (8, 8)


@pytest.fixture(scope="module")
def group(spark, tmp_path_factory):
    """Two years and two bands; nothing in the shard of rows 16-31 and columns 24-47 of
    2025, and a chunk of another shard is missing too."""
    path = str(tmp_path_factory.mktemp("grid"))
    rows = [
        (year, band, y, x, float(year - 2000 + y * 100 + x) + (0.5 if band == "field" else 0))
        for year in (2024, 2025) for band in ("edge", "field") for y in range(50) for x in range(70)
        if (y * 7 + x) % 11 and not (year == 2025 and 16 <= y < 32 and 24 <= x < 48) and not (y < 8 and x < 8)
    ]
    cells = spark.createDataFrame(rows, "year int, band string, iy long, ix long, value double")
    axes = {"y": 40.0 - 0.5 * np.arange(50), "x": -100 + 0.25 * np.arange(70)}
    zarr3.write_cells(cells, path, "variables", [2024, 2025], ["edge", "field"], SIZE, SHARD, CHUNK, axes)
    return path, rows


def _in(rows, y, x, year=None, band=None):
    return sorted(r for r in rows if y[0] <= r[2] <= y[1] and x[0] <= r[3] <= x[1] and year in (None, r[0]) and band in (None, r[1]))


@pytest.mark.parametrize(("y", "x", "year", "band"), [((0, 49), (0, 69), None, None), ((10, 40), (20, 50), 2025, "field"), ((-5, 3), (0, 500), 2024, None), ((17, 17), (47, 48), None, "edge"), ((60, 70), (0, 9), None, None), ((5, 4), (0, 9), None, None), ((0, 9), (0, 9), 1999, None)])
def test_windows(spark, group, y, x, year, band):
    path, rows = group
    found = zarr3.read_window(spark, f"{path}/variables", y, x, year, band).collect()
    assert sorted(map(tuple, found)) == _in(rows, y, x, year, band)


def test_only_the_windows_ranges_are_read(spark, group):
    path, rows = group
    read = lambda *a: [tuple(r) for r in zarr3.read_window(spark, f"{path}/variables", *a, show="ranges").collect()]
    index = 16 * math.prod((2, 3)) + 4
    one = read((9, 14), (25, 30), 2024, "field")
    assert {name for name, _, _ in one} == {"variables/c/0/1/0/1"}
    assert [size for _, _, size in one].count(index) == 1 and len(one) == 2  # the index, then one chunk
    assert sum(size for _, _, size in one) < objects.Store(path).size("variables/c/0/1/0/1") / 2
    assert len({name for name, _, _ in read((0, 49), (0, 69), 2024, "field")}) == 4 * 3
    assert read((17, 30), (25, 46), 2025, "field") == []  # that shard isn't stored
    assert [size for _, _, size in read((0, 7), (0, 7), 2024, "edge")] == [index]  # a chunk that isn't


def test_parts_of_a_shard_are_partitions(spark, group):
    path, rows = group
    spark.dataSource.register(zarr3.ArraySource)
    window = spark.read.format("zarr3").option("rows", "3:45").option("cols", "3:60").option("year", 2024).option("band", "field")
    found = window.option("partition_cells", 8 * 24).load(f"{path}/variables")
    assert found.rdd.getNumPartitions() > 4 * 3
    assert sorted(map(tuple, found.collect())) == _in(rows, (3, 45), (3, 60), 2024, "field")


def test_windows_by_labels(spark, group):
    path, _ = group
    assert zarr3.label_window(spark, path, (-99.0, -98.0), (30.0, 32.2)) == ((16, 20), (4, 8))
    assert zarr3.label_window(spark, path, (5.0, 6.0), (30.0, 32.0)) == ((16, 20), (0, -1))


def test_a_layout_of_another_writer(spark, tmp_path):
    """No shards, gzip, big-endian integers, no fill value's cells, dots in names."""
    values = np.arange(7 * 9, dtype=">i2").reshape(7, 9)
    meta = {"shape": [7, 9], "data_type": "int16", "fill_value": 0, "chunk_grid": {"configuration": {"chunk_shape": [4, 4]}}, "chunk_key_encoding": {"configuration": {"separator": "."}}, "codecs": [{"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip"}]}
    (tmp_path / "a").mkdir()
    (tmp_path / "a/zarr.json").write_text(json.dumps(meta))
    padded = np.pad(values, ((0, 1), (0, 3)))
    for cy in range(2):
        for cx in range(3):
            (tmp_path / f"a/c.{cy}.{cx}").write_bytes(gzip.compress(padded[4 * cy : 4 * cy + 4, 4 * cx : 4 * cx + 4].tobytes()))
    found = zarr3.read_window(spark, f"file:{tmp_path}/a", (0, 5), (2, 8)).collect()
    assert {(r.iy, r.ix): r.value for r in found} == {(y, x): float(values[y, x]) for y in range(6) for x in range(2, 9)}
    assert {(r.year, r.band) for r in found} == {(None, None)}


def test_malformed_arrays(spark, group, tmp_path):
    path, _ = group
    store = objects.Store(path)
    name = "variables/c/0/1/0/1"
    data = bytearray(store.read(name))
    data[-10] ^= 1
    objects.Store(str(tmp_path)).write(name, bytes(data))
    own = zarr3.layout(store, "variables")
    with pytest.raises(ValueError, match="checksum"):
        own.chunk_ranges(objects.Store(str(tmp_path)), name, [(0, 0, 0, 0)])
    meta = json.loads(store.read("variables/zarr.json"))
    meta["codecs"][0]["configuration"]["codecs"].append({"name": "blosc"})
    with pytest.raises(ValueError, match="blosc"):
        zarr3.Layout.of(meta)
    with pytest.raises(ValueError, match="asked for"):
        store.read(name, len(data) - 3, 10)
    assert zarr3.crc32c(b"123456789") == 0xE3069283


def test_a_cell_given_twice_is_an_error(spark, tmp_path):
    cells = spark.createDataFrame([(2024, "a", 1, 1, 2.0)] * 2, "year int, band string, iy long, ix long, value double")
    with pytest.raises(Exception, match="given twice"):
        zarr3.write_cells(cells, str(tmp_path), "v", [2024], ["a"], (8, 8), (8, 8), (4, 4))


def test_ranges_are_joined(tmp_path):
    assert objects.merged([(50, 5), (0, 10), (12, 3), (14, 30)], gap=2) == [(0, 44), (50, 5)]
    store = objects.Store(str(tmp_path))
    store.write("a/b", bytes(range(100)))
    assert store.ranges("a/b", [(90, 10), (3, 2), (4, 4), (3, 2)], gap=0) == {(90, 10): bytes(range(90, 100)), (3, 2): b"\3\4", (4, 4): b"\4\5\6\7"}
    assert store.reads == [("a/b", 3, 5), ("a/b", 90, 10)]
    assert store.size("a/c") is None
