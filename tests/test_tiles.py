"""Tile archives: written, found level by level, read by ranges, and kept in a table."""

import numpy as np
import pytest

from gridloom.sources import archives, tiles
from gridloom.sources.objects import Store

TILE = "archive string, id long, blob binary"


def _blob(i):
    return f"tile {i // 3}".encode() * (1 + i % 4 // 3)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """Two archives: of 30,000 tiles (with leaf directories) and of a few."""
    path = str(tmp_path_factory.mktemp("archives"))
    rng = np.random.default_rng(2)
    ids = {"big": sorted({int(i) for i in rng.integers(0, 90_000, 40_000)}), "few": [5, 9, 10, 900]}
    rows = [(name, i, _blob(i)) for name, some in ids.items() for i in some]
    made = tiles.write_archives(spark.createDataFrame(rows, TILE).repartition(7), path)
    assert {r.archive: r.tiles for r in made.collect()} == {k: len(v) for k, v in ids.items()}
    return path, {(a, i): b for a, i, b in rows}


def test_every_wanted_tile_is_found_or_known_to_be_absent(spark, written):
    path, there = written
    wanted = [("big", i) for i in range(0, 90_100, 7)] + [("few", i) for i in range(0, 1000)] + [("few", 5)] * 3
    found = tiles.fetch_tiles(spark.createDataFrame(wanted, "archive string, id long"), path).collect()
    assert {(r.archive, r.id): r.blob and bytes(r.blob) for r in found} == {w: there.get(w) for w in wanted}
    assert len(found) == len(set(wanted))


def test_one_tile_reads_the_header_the_root_a_leaf_and_the_tile(written):
    path, there = written
    store = Store(path)
    archive = tiles.Archive(store, "big.pmtiles")
    tile = next(i for a, i in there if a == "big" and i > 50_000)
    (off, size), (gone, _) = archive.locate(np.array([tile, 10**9]))
    assert store.read("big.pmtiles", int(off), int(size)) == there["big", tile]
    assert gone == -1
    assert len(store.reads) == 4 + 1  # the last leaf, where the id beyond the end would be
    assert sum(n for _, _, n in store.reads) < store.size("big.pmtiles") / 4
    before = len(store.reads)
    archive.locate(np.array([tile, tile + 1, tile + 2]))
    assert len(store.reads) == before  # leaves are kept


def test_near_tiles_are_one_read(written):
    path, there = written
    store = Store(path)
    archive = tiles.Archive(store, "few.pmtiles")
    where = archive.locate(np.array([5, 9, 10, 900]))
    before = len(store.reads)
    store.ranges("few.pmtiles", [(int(o), int(n)) for o, n in where])
    assert len(store.reads) == before + 1
    assert archive.root["run"].max() == 2 and len(set(where[:, 0])) == 3 == len(archive.root)  # 9 and 10 share a run


def test_directories_deeper_than_the_limit_have_no_tiles(tmp_path):
    """A directory whose entry leads to itself, as a broken archive may have."""
    leaf = tiles.encode_directory([(0, 0, 0, 0)])
    while (again := tiles.encode_directory([(0, 0, len(leaf), 0)])) != leaf:
        leaf = again
    import struct

    root = tiles.encode_directory([(0, 0, len(leaf), 0)])
    head = b"PMTiles\x03" + struct.pack("<8Q", 127, len(root), 0, 0, 127 + len(root), len(leaf), 0, 0)
    (tmp_path / "a.pmtiles").write_bytes(head.ljust(127, b"\0") + root + leaf)
    assert tiles.Archive(Store(str(tmp_path)), "a.pmtiles").locate(np.array([3])).tolist() == [[-1, 0]]


def test_the_table_grows_by_what_it_does_not_know(spark, written, tmp_path):
    path, there = written
    cache = str(tmp_path / "cache")
    ask = lambda ids: spark.createDataFrame([("few", i, "x") for i in ids], "archive string, id long, more string")
    first = {r.id: r.blob and bytes(r.blob) for r in tiles.cached_tiles(ask([5, 9, 8, 8]), path, cache).collect()}
    assert first == {5: there["few", 5], 9: there["few", 9], 8: None}
    again = tiles.cached_tiles(ask([9, 10, 8]), path, cache)
    assert again.columns == ["archive", "id", "more", "blob"]
    assert {r.id for r in again.filter("blob is null").collect()} == {8}
    assert sorted(r.id for r in spark.read.parquet(cache).collect()) == [5, 8, 9, 10]
    tiles.cached_tiles(ask([5, 8]), str(tmp_path / "no archives here"), cache).count()  # nothing is missing: nothing is opened


def test_malformed_archives(spark, written, tmp_path):
    path, _ = written
    with pytest.raises(Exception, match="given twice"):
        tiles.write_archives(spark.createDataFrame([("a", 1, b"x"), ("a", 1, b"y")], TILE), str(tmp_path))
    with pytest.raises(Exception, match="(?i)no such file|does not exist|not found"):
        tiles.fetch_tiles(spark.createDataFrame([("gone", 1)], "archive string, id long"), path).collect()


def test_vector_tiles_round_trip(spark):
    ring, hole = [(1, 2), (30, 2), (30, 4000), (-5, 400)], [(7, 7), (9, 7), (9, 9)]
    rows = [("a", 3, "2024", 1, hole), ("a", 3, "2024", 0, ring), ("a", 3, "2025", 0, hole), ("a", 4, "2025", 0, ring)]
    given = spark.createDataFrame(rows, "archive string, id long, layer string, ring int, points array<struct<x:long,y:long>>")
    made = tiles.vector_tiles(given).selectExpr("id AS tile", "blob").collect()
    assert [r for r in archives.tile_rings(bytes(next(m.blob for m in made if m.tile == 4)), "2024")[1]] == []
    extent, rings = archives.tile_rings(bytes(next(m.blob for m in made if m.tile == 3)), "2024")
    assert extent == 4096 and [[tuple(p) for p in r] for r in rings] == [[*ring, ring[0]], [*hole, hole[0]]]
