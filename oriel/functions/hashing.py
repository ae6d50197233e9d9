"""Content hashes, difference hashes, Hamming distance and the hash that assigns splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oriel.functions.expressions import col
from oriel.functions.media import area_resize

#: Percentages below which a group goes to each split, in order.
SPLITS = (("train", 70), ("validation", 85), ("test", 100))


def content_hash(c: str | Column, normalise_newlines: bool = False) -> Column:
    """SHA-256 in hex of bytes or text; newlines are hashed as they are unless ``normalise_newlines``."""
    x = col(c)
    if normalise_newlines:
        x = F.regexp_replace(x.cast("string"), "\r\n?", "\n")
    return F.sha2(x.cast("binary"), 256)


def seeded_key(seed: int, *parts: str | Column) -> Column:
    """SHA-256 of ``seed:part:part``; its hex sorts like its bytes, so it gives a seeded order."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(col(p).cast("string") for p in parts)), 256)


def hash_bucket(seed: int, *parts: str | Column, buckets: int = 100) -> Column:
    """The first 64 bits of the seeded key, unsigned and big-endian, modulo ``buckets``."""
    head = F.conv(F.substring(seeded_key(seed, *parts), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(head, F.lit(buckets).cast("decimal(20,0)")).cast("int")


def assigned_split(seed: int, *group: str | Column) -> Column:
    """The split of a group: all its rows go to the same one, by its hash alone."""
    bucket = hash_bucket(seed, *group)
    out = None
    for name, below in SPLITS:
        out = F.when(bucket < below, name) if out is None else out.when(bucket < below, name)
    return out


def difference_hash(pixels: str | Column, rows: int = 8, columns: int = 9) -> Column:
    """64 bits of a ``rows`` by ``columns`` grid in row order: whether each right neighbour is larger, first bit highest."""
    places = F.array(*(F.lit(r * columns + c) for r in range(rows) for c in range(columns - 1)))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def bits(x: Column) -> Column:
        return F.aggregate(places, none, lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(F.when(F.element_at(x, i + 2) > F.element_at(x, i + 1), one).otherwise(none)))

    # The pixels are bound once, or they would be made anew for every bit.
    return F.element_at(F.transform(F.array(col(pixels)), bits), 1)


def grid_bits(means: np.ndarray) -> int:
    """64 bits of an 8 by 9 grid, as ``difference_hash``, as a signed number."""
    bits = np.packbits((means[:, 1:] > means[:, :-1]).reshape(-1))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def code_cells(text: str, cells: int = 72) -> tuple[list[int], list[int]]:
    """Sums of code points and numbers of characters of ``cells`` equal parts of the whole text; part j of n
    characters goes from floor(j * n / cells) on."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    edges = [j * len(codes) // cells for j in range(cells + 1)]
    sums = np.concatenate([[0], np.cumsum(codes, dtype=np.int64)])[edges]
    return np.diff(sums).tolist(), np.diff(edges).tolist()


def text_bits(text: str) -> int:
    """The difference hash of a text as a tiny image: each pixel is the mean code point of its part. Means are
    compared as fractions of whole numbers; an empty part counts as 0."""
    total, n = code_cells(text)
    value = 0
    for r in range(8):
        for k in range(r * 9, r * 9 + 8):
            value = value << 1 | (total[k + 1] * max(n[k], 1) > total[k] * max(n[k + 1], 1))
    return value - (1 << 64) if value >> 63 else value


@F.pandas_udf(T.LongType())
def text_difference_hash(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else text_bits(t) for t in text], dtype="Int64")


@F.pandas_udf(T.LongType())
def image_difference_hash(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """The difference hash of grey images (pixels in row order): means over equal areas make the 8 by 9 grid, rounded
    to whole grey values, ties to even."""

    def one(p, h, w):
        return None if p is None else grid_bits(np.rint(area_resize(np.asarray(p, float).reshape(int(h), int(w)), 8, 9)))

    return pd.Series([one(p, h, w) for p, h, w in zip(pixels, height, width, strict=True)], dtype="Int64")


def hamming(a: str | Column, b: str | Column) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))
