"""The few pixel operations that columns can't express: polygon filling, area resizing, JPEG sizes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fill_polygons(polygons, width: int, height: int) -> np.ndarray:
    """A height by width mask, 1 where any polygon covers a pixel's centre or passes through it.

    Polygons are lists of (x, y) in whole pixels; the union of all is taken.
    """
    mask = np.zeros((height, width), bool)
    for points in [] if polygons is None else polygons:
        p = np.asarray([(q["x"], q["y"]) if isinstance(q, dict) else tuple(q) for q in points], float)
        if len(p) < 3:
            continue
        # Only rows and columns that the polygon reaches are looked at, and each edge only in its own box.
        top, bottom = max(0, int(p[:, 1].min()) - 1), min(height, int(p[:, 1].max()) + 2)
        inside = np.zeros((max(0, bottom - top), width), bool)
        xs = np.arange(width)
        for (x1, y1), (x2, y2) in zip(p, np.roll(p, -1, axis=0), strict=True):
            low, high = max(top, int(np.floor(min(y1, y2))) - 1), min(bottom, int(np.ceil(max(y1, y2))) + 2)
            if low >= high:
                continue
            ys = np.arange(low, high)[:, None]
            if y1 != y2:
                crosses = (y1 > ys) != (y2 > ys)
                inside[low - top : high - top] ^= crosses & (xs < (x2 - x1) * (ys - y1) / (y2 - y1) + x1)
            # Pixels whose centre lies within half a pixel of the edge belong to it.
            first, last = max(0, int(np.floor(min(x1, x2))) - 1), min(width, int(np.ceil(max(x1, x2))) + 2)
            if first < last:
                near = xs[first:last]
                dx, dy = x2 - x1, y2 - y1
                t = np.clip(((near - x1) * dx + (ys - y1) * dy) / max(dx * dx + dy * dy, 1e-12), 0, 1)
                mask[low:high, first:last] |= np.maximum(abs(x1 + t * dx - near), abs(y1 + t * dy - ys)) < 0.5
        mask[top:bottom] |= inside
    return mask.astype(np.uint8)


def area_resize(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over equal areas, with parts of pixels counted by their share."""

    def shares(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        at = np.arange(n)
        return np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None) * m / n

    p = np.asarray(pixels, float)
    return shares(p.shape[0], rows) @ p @ shares(p.shape[1], columns).T


def jpeg_size(content: bytes | None) -> tuple[int, int] | None:
    """Width and height from the first frame header of a JPEG; None if there is none."""
    if not content or content[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(content):
        if content[at] != 0xFF:
            return None
        marker = content[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        if marker in (0x01, 0xD8, *range(0xD0, 0xD8)):
            at += 2
            continue
        at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def polygon_mask(polygons: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Masks in row order from array<array<struct<x,y>>> and sizes."""
    return pd.Series([fill_polygons(p, int(w), int(h)).reshape(-1).astype(np.int32) for p, w, h in zip(polygons, width, height, strict=True)])


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def jpeg_dimensions(content: pd.Series) -> pd.DataFrame:
    sizes = [jpeg_size(c) or (None, None) for c in content]
    return pd.DataFrame(sizes, columns=["width", "height"]).astype("Int32")
