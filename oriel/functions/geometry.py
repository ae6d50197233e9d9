"""Boxes, polygons and masks as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oriel.functions.expressions import col, finite, half_even, safe_ratio

#: The walking corridor, as parts of the frame's width and height.
CORRIDOR_TOP, CORRIDOR_BOTTOM = 0.45, 1.0
CORRIDOR_TOP_LEFT, CORRIDOR_TOP_RIGHT = 0.38, 0.62
CORRIDOR_BOTTOM_LEFT, CORRIDOR_BOTTOM_RIGHT = 0.10, 0.90


def shoelace_area(points: str | Column) -> Column:
    """Area of a polygon given as array<struct<x,y>>."""
    p = col(points)
    n = F.size(p)
    terms = F.transform(p, lambda a, i: a["x"] * F.element_at(p, (F.pmod(i + 1, n) + 1).cast("int"))["y"] - F.element_at(p, (F.pmod(i + 1, n) + 1).cast("int"))["x"] * a["y"])
    return F.when(n >= 3, F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2).otherwise(F.lit(0.0))


def float_area(points: str | Column) -> Column:
    """Area with coordinates of single precision, as image libraries measure contours."""
    return shoelace_area(F.transform(col(points), lambda q: F.struct(q["x"].cast("float").cast("double").alias("x"), q["y"].cast("float").cast("double").alias("y"))))


def polygon_error(points: str | Column, width: str | Column, height: str | Column) -> Column:
    """First fault of a polygon: too few points, not finite, outside (bounds count as inside), no area; else null."""
    p, w, h = col(points), col(width), col(height)
    return (
        F.when(F.coalesce(F.size(p), F.lit(-1)) < 3, "too_few_points")
        .when(~F.forall(p, lambda q: finite(q["x"]) & finite(q["y"])), "not_finite")
        .when(~F.forall(p, lambda q: (q["x"] >= 0) & (q["x"] <= w) & (q["y"] >= 0) & (q["y"] <= h)), "outside")
        .when(shoelace_area(p) <= 0, "no_area")
    )


def box_error(x1, y1, x2, y2, width, height) -> Column:
    """``not_finite``, ``outside`` or ``empty``; null for a box with 0 <= x1 < x2 <= width, likewise y."""
    x1, y1, x2, y2, w, h = (col(c) for c in (x1, y1, x2, y2, width, height))
    return (
        F.when(~(finite(x1) & finite(y1) & finite(x2) & finite(y2)), "not_finite")
        .when((x1 < 0) | (y1 < 0) | (x2 > w) | (y2 > h), "outside")
        .when((x1 >= x2) | (y1 >= y2), "empty")
    )


def box_to_centre(x1, y1, x2, y2, width, height) -> Column:
    """Centre and size as parts of the frame."""
    x1, y1, x2, y2, w, h = (col(c).cast("double") for c in (x1, y1, x2, y2, width, height))
    return F.struct(((x1 + x2) / 2 / w).alias("cx"), ((y1 + y2) / 2 / h).alias("cy"), ((x2 - x1) / w).alias("w"), ((y2 - y1) / h).alias("h"))


def normalised(points: str | Column, width: str | Column, height: str | Column) -> Column:
    return F.transform(col(points), lambda q: F.struct((q["x"] / col(width)).alias("x"), (q["y"] / col(height)).alias("y")))


def denormalised(points: str | Column, width: str | Column, height: str | Column, digits: int = 2) -> Column:
    return F.transform(col(points), lambda q: F.struct(half_even(q["x"] * col(width), digits).alias("x"), half_even(q["y"] * col(height), digits).alias("y")))


def clipped_to_grid(points: str | Column, width: str | Column, height: str | Column) -> Column:
    """Points rounded to whole pixels, ties to even, and clipped to the frame."""
    within = lambda v, size: F.greatest(F.lit(0.0), F.least(F.rint(v), col(size) - F.lit(1.0)))
    return F.transform(col(points), lambda q: F.struct(within(q["x"], width).alias("x"), within(q["y"], height).alias("y")))


def in_corridor(x1, y1, x2, y2, width, height) -> Column:
    """Whether the middle of a box's lower side lies in the corridor's trapezoid, its border included.

    Corners of the trapezoid are whole pixels, ties to even.
    """
    x, y = (col(x1) + col(x2)) / 2.0, col(y2).cast("double")
    w, h = col(width), col(height)
    top, bottom = half_even(h * CORRIDOR_TOP), half_even(h * CORRIDOR_BOTTOM)
    tl, tr = half_even(w * CORRIDOR_TOP_LEFT), half_even(w * CORRIDOR_TOP_RIGHT)
    bl, br = half_even(w * CORRIDOR_BOTTOM_LEFT), half_even(w * CORRIDOR_BOTTOM_RIGHT)
    # Sides by cross products, so that no division decides about points on the border.
    left = (x - bl) * (top - bottom) - (y - bottom) * (tl - bl)
    right = (x - br) * (top - bottom) - (y - bottom) * (tr - br)
    return (y >= top) & (y <= bottom) & (left <= 0) & (right >= 0)


def is_present(mask: str | Column) -> Column:
    return F.exists(col(mask), lambda v: v != 0)


def union_mask(masks: str | Column, size: int | Column, threshold: float = 0.5) -> Column:
    """One mask from an array of score masks of equal size: 1 where any is above ``threshold``."""
    start = F.array_repeat(F.lit(0), size)
    return F.aggregate(col(masks), start, lambda acc, m: F.zip_with(acc, m, lambda a, v: F.greatest(a, F.when(v > threshold, 1).otherwise(0))))


def coverage(mask: str | Column) -> Column:
    m = col(mask)
    return safe_ratio(F.size(F.filter(m, lambda v: v != 0)), F.size(m))


def binary_iou(truth: str | Column, prediction: str | Column) -> Column:
    """Intersection over union; 1 if both are empty; an error if shapes differ."""
    a, b = col(truth), col(prediction)
    both = F.zip_with(a, b, lambda x, y: F.struct(((x != 0) & (y != 0)).cast("int").alias("i"), ((x != 0) | (y != 0)).cast("int").alias("u")))
    sums = F.aggregate(both, F.struct(F.lit(0).alias("i"), F.lit(0).alias("u")), lambda s, v: F.struct((s["i"] + v["i"]).alias("i"), (s["u"] + v["u"]).alias("u")))
    ratio = F.when(sums["u"] == 0, F.lit(1.0)).otherwise(F.try_divide(sums["i"].cast("double"), sums["u"].cast("double")))
    return F.when(F.size(a) == F.size(b), ratio).otherwise(F.raise_error(F.lit("mask shapes differ")).cast("double"))


def polygons_above(polygons: str | Column, scores: str | Column, threshold: float | Column) -> Column:
    """Polygons whose score reaches the threshold; an error if the arrays differ in length."""
    p, s = col(polygons), col(scores)
    both = F.zip_with(p, s, lambda a, b: F.struct(a.alias("polygon"), b.alias("score")))
    kept = F.transform(F.filter(both, lambda z: z["score"] >= threshold), lambda z: z["polygon"])
    return F.when(F.size(p) == F.size(s), kept).otherwise(F.raise_error(F.lit("polygons and scores differ in number")))
