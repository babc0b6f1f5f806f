"""Archives are written here byte by byte and read back."""

import gzip
import json
import struct

import numpy as np
import pandas as pd
import pytest

from gridloom.sources import archives, tiles


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _directory(rows):
    """rows: (id, off, len, run); an offset that goes on is coded as 0."""
    ids, coded, end = [], [], None
    for i, (tile, off, size, _) in enumerate(rows):
        ids.append(tile - (rows[i - 1][0] if i else 0))
        coded.append(0 if off == end else off + 1)
        end = off + size
    columns = [ids, [r[3] for r in rows], [r[2] for r in rows], coded]
    return gzip.compress(_varint(len(rows)) + b"".join(_varint(v) for c in columns for v in c))


def _archive(root, leaf, tiles):
    sizes = np.cumsum([127, len(root), 0, len(leaf)])
    head = b"PMTiles\x03" + struct.pack("<8Q", 127, len(root), int(sizes[1]), 0, int(sizes[2]), len(leaf), int(sizes[3]), len(tiles))
    return head.ljust(127, b"\0") + root + leaf + tiles


def _field(number, value):
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def _zigzag(v):
    return (v << 1) ^ (v >> 63)


def _tile(layer, rings):
    body = b""
    at = (0, 0)
    for ring in rings:
        for k, (x, y) in enumerate(ring):
            if k < 2:
                body += _varint((1 if k == 0 else 2) | (1 if k == 0 else len(ring) - 1) << 3)
            body += _varint(_zigzag(x - at[0])) + _varint(_zigzag(y - at[1]))
            at = (x, y)
        body += _varint(7 | 1 << 3)
    feature = _field(3, 3) + _field(4, body)
    return _field(3, _field(1, layer.encode()) + _field(2, feature) + _field(5, 512) + _field(15, 2))


RING = [(1, 2), (30, 2), (30, 400), (-5, 400)]


@pytest.fixture
def archive(tmp_path):
    tile = gzip.compress(_tile("2024", [RING, [(7, 7), (9, 7), (9, 9)]]))
    leaf = _directory([(40, len(tile), 3, 1), (41, len(tile) + 3, 2, 5)])
    root = _directory([(3, 0, len(tile), 2), (40, 0, len(leaf), 0)])
    (tmp_path / "xx.pmtiles").write_bytes(_archive(root, leaf, tile + b"abcde"))
    return tmp_path, tile


def test_tile_archive(spark, archive):
    path, tile = archive
    wanted = spark.createDataFrame([("xx", i) for i in (2, 3, 4, 5, 40, 41, 45, 46)], "archive string, id long")
    found = {r.id: r.blob and bytes(r.blob) for r in tiles.fetch_tiles(wanted, str(path)).collect()}
    assert found == {2: None, 3: tile, 4: tile, 5: None, 40: b"abc", 41: b"de", 45: b"de", 46: None}


def test_polygons_of_a_layer(spark, archive):
    blobs = spark.createDataFrame([(3, archive[1]), (4, b""), (5, None)], "tile long, blob binary")
    points = archives.polygon_points(blobs, "2024").orderBy("ring", "seq").collect()
    assert [(p.x, p.y) for p in points if p.ring == 0] == [*RING, RING[0]]
    assert {p.extent for p in points} == {512} and {p.tile for p in points} == {3} and len(points) == 9
    assert not archives.polygon_points(blobs, "2025").count()


def test_malformed_input():
    with pytest.raises(ValueError, match="version 3"):
        archives.header(b"PMTiles\x02".ljust(127, b"\0"))
    with pytest.raises(ValueError, match="wire type"):
        list(archives.wire_fields(bytes([3 << 3 | 3, 1])))
    with pytest.raises(ValueError, match="command"):
        archives.ring_steps(np.array([3 | 1 << 3, 2, 2]))
    assert archives.directory(gzip.compress(_varint(0))).empty and not len(archives.varints(b""))


def test_varints_and_directories_round_trip():
    rng = np.random.default_rng(1)
    values = [int(v) for v in rng.integers(0, 1 << 50, 300)] + [0, 127, 128]
    assert archives.varints(b"".join(map(_varint, values))).tolist() == values
    rows, at = [], 0
    for i in range(100):
        size, jump = int(rng.integers(1, 500)), int(rng.integers(0, 2)) * 1000
        rows.append((i * 3, at + jump, size, 1 + i % 3))
        at += jump + size
    pd.testing.assert_frame_equal(archives.directory(_directory(rows))[["id", "off", "len", "run"]], pd.DataFrame(rows, columns=["id", "off", "len", "run"]))


@pytest.mark.parametrize("codec", ["gzip", None])
def test_grid_window(spark, tmp_path, codec):
    values = np.arange(2 * 7 * 9, dtype="<f4").reshape(2, 7, 9)
    meta = {"shape": [2, 7, 9], "data_type": "float32", "chunk_grid": {"configuration": {"chunk_shape": [1, 4, 4]}}, "codecs": [{"name": "bytes"}] + ([{"name": codec}] if codec else [])}
    (tmp_path / "zarr.json").write_text(json.dumps(meta))
    padded = np.pad(values, ((0, 0), (0, 1), (0, 3)))
    for z in range(2):
        for cy in range(2):
            for cx in range(3):
                data = padded[z, 4 * cy : 4 * cy + 4, 4 * cx : 4 * cx + 4].tobytes()
                target = tmp_path / "c" / str(z) / str(cy) / str(cx)
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_bytes(gzip.compress(data) if codec else data)
    found = {(r.iy, r.ix): r.value for r in archives.read_grid(spark, str(tmp_path), (2, 6), (3, 8), layer=1).collect()}
    assert found == {(y, x): float(values[1, y, x]) for y in range(2, 7) for x in range(3, 9)}
    assert archives.read_grid(spark, str(tmp_path), (0, 99), (0, 99)).count() == values.size
    assert archives.read_grid(spark, str(tmp_path), (50, 99), (0, 99)).count() == 0
