import math

from pyspark.sql import functions as F

from gridloom.functions import geo


def _row(spark, *columns):
    return spark.range(1).select(*columns).head()


def test_albers_origin_maps_to_zero(spark):
    x, y = geo.albers(F.lit(-96.0), F.lit(23.0))
    row = _row(spark, x, y)
    assert abs(row[0]) < 1e-6 and abs(row[1]) < 1e-6


def test_albers_preserves_area(spark):
    """A small cell's projected area equals its area on the ellipsoid, anywhere."""
    lon, lat, d = -120.0, 38.0, 0.001
    corners = [geo.albers(F.lit(lon + a * d), F.lit(lat + b * d)) for a, b in ((0, 0), (1, 0), (0, 1))]
    v = _row(spark, *[c for pair in corners for c in pair])
    area = (v[2] - v[0]) * (v[5] - v[1]) - (v[3] - v[1]) * (v[4] - v[0])
    s = math.sin(math.radians(lat + d / 2))
    w = 1 - geo.ECC2 * s * s
    meridian, prime = geo.SEMI_MAJOR * (1 - geo.ECC2) / w**1.5, geo.SEMI_MAJOR / math.sqrt(w)
    true = meridian * prime * math.cos(math.radians(lat + d / 2)) * math.radians(d) ** 2
    assert abs(area / true - 1) < 1e-4


def test_tile_round_trip(spark):
    z, x, y = F.lit(12).cast("long"), F.lit(700).cast("long"), F.lit(1583).cast("long")
    lon = (geo.tile_edge_lon(x, z) + geo.tile_edge_lon(x + 1, z)) / 2
    lat = (geo.tile_edge_lat(y, z) + geo.tile_edge_lat(y + 1, z)) / 2
    assert tuple(_row(spark, *geo.tile_of(lon, lat, z))) == (700, 1583)


def test_truncation_and_floor_differ_below_zero(spark):
    assert _row(spark, geo.raster_cell(F.lit(-10.0), 0.0, 30.0))[0] == 0
    assert _row(spark, geo.grid_cell(F.lit(-180.00001), F.lit(0.0), 1)[1])[0] == -1


def test_zigzag(spark):
    rows = spark.createDataFrame([(i,) for i in range(6)], "v long").select(geo.zigzag(F.col("v"))).collect()
    assert [r[0] for r in rows] == [0, -1, 1, -2, 2, -3]


def test_amounts_round_the_exact_value(spark):
    values = [2250.0, 2350.0, 1050.0, 85000.0, 75000.0, 1005000.0, 25_000.0, 150.0, 250.0, 0.0, 9999.99, 1234567.89] + [50.0 * i + 0.05 for i in range(200)] + [5000.0 * i for i in range(2, 400)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", geo.amount(F.col("v")).alias("a")).collect()
    assert [r.a for r in rows] == [f"{r.v / 1e6:.2f} M ac" if r.v >= 10_000 else f"{r.v / 1e3:.1f} k ac" for r in rows]
