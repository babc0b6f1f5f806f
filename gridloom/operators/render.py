"""Tile images: a group of at most 256 by 256 pixels becomes one PNG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .vector import line_pixels

TILE = 256


def png(rgba: np.ndarray, level: int = 4) -> bytes:
    """An 8-bit RGBA image as PNG, rows unfiltered."""
    height, width = rgba.shape[:2]

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.zeros((height, 1 + 4 * width), dtype=np.uint8)
    rows[:, 1:] = rgba.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes(), level)) + part(b"IEND", b"")


def _image(pdf: pd.DataFrame) -> pd.DataFrame:
    rgba = np.zeros((TILE, TILE, 4), dtype=np.uint8)
    pdf = pdf.sort_values("top", kind="stable")
    rgba[pdf["py"], pdf["px"]] = pdf[["r", "g", "b", "a"]].to_numpy(np.uint8)
    return pd.DataFrame({"tile": [pdf["tile"].iloc[0]], "drawn": [int((rgba[..., 3] > 0).sum())], "png": [png(rgba)]})


def render_tiles(pixels: DataFrame, classes: DataFrame, outlines: DataFrame | None = None, line: tuple[int, int, int, int] = (40, 40, 40, 210)) -> DataFrame:
    """``pixels(tile, px, py, code)`` -> ``(tile, drawn, png)``. Codes above 0 take their
    class's colour, the rest stays clear; outlines ``(tile, line)`` in pixels lie on top.
    A tile without pixels and outlines has no row."""
    rgb = [geo.hex_channel("hex", i).alias(c) for i, c in enumerate("rgb")]
    known = pixels.join(F.broadcast(classes.select("code", *rgb)), "code", "left")  # 256 classes
    drawn = F.when((F.col("code") > 0) & F.col("r").isNotNull(), 255).otherwise(0)
    rows = known.select("tile", "px", "py", *[F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"], drawn.alias("a"), F.lit(0).alias("top"))
    if outlines is not None:
        rows = rows.unionByName(line_pixels(outlines).select("tile", "px", "py", *[F.lit(v).alias(c) for v, c in zip(line, "rgba", strict=True)], F.lit(1).alias("top")))
    return rows.groupBy("tile").applyInPandas(_image, f"tile {pixels.schema['tile'].dataType.simpleString()}, drawn long, png binary")


def pixels_of_png(data: bytes) -> np.ndarray:
    """The RGBA array of an image that ``png`` wrote. Raises ValueError for other images."""
    at, parts = 8, {}
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        parts.setdefault(kind, []).append(data[at + 8 : at + 8 + size])
        at += size + 12
    width, height, depth, colour = struct.unpack_from(">IIBB", parts[b"IHDR"][0])
    rows = np.frombuffer(zlib.decompress(b"".join(parts[b"IDAT"])), np.uint8).reshape(height, -1)
    if (depth, colour) != (8, 6) or rows[:, 0].any():
        raise ValueError("not an 8-bit RGBA image with unfiltered rows")
    return rows[:, 1:].reshape(height, width, 4)


def colour_counts(images: DataFrame) -> DataFrame:
    """``(tile, png)`` -> ``(tile, colour, n)``: the pixels of each colour, as RRGGBB."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tile, data in zip(pdf["tile"], pdf["png"], strict=True):
                rgba = pixels_of_png(data).reshape(-1, 4).astype(np.int64)
                shown = rgba[rgba[:, 3] > 0] @ np.array([1 << 16, 1 << 8, 1, 0])
                colours, n = np.unique(shown, return_counts=True)
                yield pd.DataFrame({"tile": [tile] * len(n), "colour": [f"{c:06x}" for c in colours], "n": n})

    kind = images.schema["tile"].dataType.simpleString()
    return images.select("tile", "png").mapInPandas(rows, f"tile {kind}, colour string, n long")
