"""Projection and tile arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# EPSG:5070 (Albers equal area on GRS80), the probability grid's origin
# and cell, and the unit conversions.
SEMI_MAJOR, ECC2 = 6378137.0, 0.00669438002290
LAT_ORIGIN, LON_ORIGIN, PARALLELS = 23.0, -96.0, (29.5, 45.5)
GRID_TOP, GRID_CELL = 83.748345, 8.98311982e-05
ACRES_PER_KM2, KM_PER_DEG_LON, KM_PER_DEG_LAT = 247.10538, 111.32, 110.574
CONUS = (-125.0, 24.0, -66.5, 49.8)

_E = math.sqrt(ECC2)


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - ECC2 * math.sin(lat) ** 2)


def _authalic(s: float) -> float:
    """q of Snyder's equal-area formulas, from the sine of a latitude."""
    return (1 - ECC2) * (s / (1 - ECC2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


_M1, _M2 = (_m(math.radians(p)) for p in PARALLELS)
_Q1, _Q2 = (_authalic(math.sin(math.radians(p))) for p in PARALLELS)
CONE = (_M1**2 - _M2**2) / (_Q2 - _Q1)
BASE = _M1**2 + CONE * _Q1
RHO0 = SEMI_MAJOR * math.sqrt(BASE - CONE * _authalic(math.sin(math.radians(LAT_ORIGIN)))) / CONE


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Forward EPSG:5070: easting and northing in metres."""
    s = F.sin(F.radians(lat))
    q = (1 - ECC2) * (s / (1 - ECC2 * s * s) - F.ln((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    rho = SEMI_MAJOR * F.sqrt(BASE - CONE * q) / CONE
    theta = CONE * F.radians(lon - LON_ORIGIN)
    return rho * F.sin(theta), RHO0 - rho * F.cos(theta)


def tile_edge_lon(x: Column, z: Column) -> Column:
    return x / F.pow(F.lit(2.0), z) * 360.0 - 180.0


def tile_edge_lat(y: Column, z: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / F.pow(F.lit(2.0), z)))))


def tile_of(lon: Column, lat: Column, z: Column) -> tuple[Column, Column]:
    """The tile that holds a point, kept within the grid and the projection's latitudes."""
    n = F.pow(F.lit(2.0), z)
    rad = F.radians(F.greatest(F.least(lat, F.lit(85.05)), F.lit(-85.05)))
    x = ((lon + 180.0) / 360.0 * n).cast("long")
    y = ((1 - F.ln(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * n).cast("long")
    top = (n - 1).cast("long")
    return F.greatest(F.least(x, top), F.lit(0)), F.greatest(F.least(y, top), F.lit(0))


def grid_cell(lon: Column, lat: Column, factor: Column | int) -> tuple[Column, Column]:
    """Row and column of the probability grid at a level; floors, also below zero."""
    return F.floor((GRID_TOP - lat) / (GRID_CELL * factor)), F.floor((lon + 180.0) / (GRID_CELL * factor))


def raster_cell(v: Column, origin: float, size: Column | float) -> Column:
    """A position's cell in the categorical raster; truncates toward zero."""
    return ((v - origin) / size).cast("long")


def pixel_acres(lat: Column, dlon: Column, dlat: Column) -> Column:
    return dlon * KM_PER_DEG_LON * F.cos(F.radians(lat)) * dlat * KM_PER_DEG_LAT * ACRES_PER_KM2


def zigzag(v: Column) -> Column:
    return F.shiftright(v, 1).bitwiseXOR(-v.bitwiseAND(F.lit(1).cast("long")))


def hex_channel(text: Column | str, channel: int) -> Column:
    """Red (0), green or blue of a colour written #rrggbb."""
    return F.conv(F.substring(text, 2 + 2 * channel, 2), 16, 10).cast("int")


def span_zoom(west: Column, north: Column, east: Column, south: Column, width: int = 1400) -> Column:
    """Zoom at which a place's extent fills a view of ``width`` pixels but for a margin: 3.5
    to 13.5, and 10 without an extent. Latitudes weigh twice; an extent is 0.01 at least."""
    span = F.greatest(F.abs(east - west), F.abs(north - south) * 2, F.lit(0.01))
    known = west.isNotNull() & north.isNotNull() & east.isNotNull() & south.isNotNull()
    zoom = F.when(known, F.log2(360.0 * (width / 512) / span) - 0.3).otherwise(10.0)
    return F.greatest(F.least(zoom, F.lit(13.5)), F.lit(3.5))


def place_label(name: Column, city: Column, state: Column, query: Column) -> Column:
    """The parts that aren't empty, or else what was asked for."""
    label = F.concat_ws(", ", *[F.when(c != "", c) for c in (name, city, state)])
    return F.when(label == "", query).otherwise(label)


def amount(acres: Column) -> Column:
    """``format_number`` with a pattern rounds the exact value, halves to even, as printf does
    elsewhere; ``format_string`` rounds a number's shortest digits, halves up."""
    fixed = lambda v, pattern: F.call_function("format_number", v, F.lit(pattern))
    return F.when(acres >= 10_000, F.concat(fixed(acres / 1e6, "0.00"), F.lit(" M ac"))).otherwise(F.concat(fixed(acres / 1e3, "0.0"), F.lit(" k ac")))
