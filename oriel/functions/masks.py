"""Masks as runs: arrays of (start, stop) over pixels in row order, sorted and disjoint. Union, overlap and coverage are sweeps over the
ends of runs on the JVM side; no array of pixels is made."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oriel.functions.expressions import col, safe_ratio
from oriel.functions.media import fill_polygons

RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def runs_of(mask: np.ndarray) -> list[tuple[int, int]]:
    flat = np.concatenate([[0], np.asarray(mask).reshape(-1) != 0, [0]]).astype(np.int8)
    return np.flatnonzero(np.diff(flat)).reshape(-1, 2).tolist()


@F.pandas_udf(RUNS)
def polygon_runs(polygons: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """The runs that polygons of any shape fill (``media.fill_polygons``); null where polygons are."""

    def one(p, w, h):
        return None if p is None else [{"start": a, "stop": b} for a, b in runs_of(fill_polygons(p, int(w), int(h)))]

    return pd.Series([one(*x) for x in zip(polygons, width, height, strict=True)], dtype=object)


def pixels(mask: str | Column) -> Column:
    return F.aggregate(col(mask), F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])


def covered_pixels(masks: list[str | Column], least: int = 1) -> Column:
    """Pixels that at least ``least`` of the masks cover: 1 is their union, as many as there are masks their intersection. Null if
    a mask is. One sweep over the sorted ends of runs."""
    ends = lambda m: F.flatten(F.transform(col(m), lambda r: F.array(F.struct(r["start"].alias("at"), F.lit(1).alias("step")), F.struct(r["stop"].alias("at"), F.lit(-1).alias("step")))))
    events = F.array_sort(F.concat(*map(ends, masks)))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("since"), F.lit(0).cast("long").alias("total"))

    def step(s: Column, e: Column) -> Column:
        total = s["total"] + F.when(s["depth"] >= least, e["at"] - s["since"]).otherwise(F.lit(0).cast("long"))
        return F.struct((s["depth"] + e["step"]).alias("depth"), e["at"].alias("since"), total.alias("total"))

    return F.aggregate(events, start, step)["total"]


def union_runs(masks: str | Column) -> Column:
    """One mask from an array of masks: their runs in order, those that touch made one."""
    runs = F.array_sort(F.flatten(col(masks)))
    start = F.struct(F.array().cast(RUNS).alias("out"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("stop"))
    closed = lambda s: F.when(s["start"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop")))))

    def step(s: Column, r: Column) -> Column:
        joins = F.coalesce(r["start"] <= s["stop"], F.lit(False))
        return F.when(joins, F.struct(s["out"].alias("out"), s["start"].alias("start"), F.greatest(s["stop"], r["stop"]).alias("stop"))).otherwise(
            F.struct(closed(s).alias("out"), r["start"].alias("start"), r["stop"].alias("stop"))
        )

    return F.aggregate(runs, start, step, closed)


def run_coverage(mask: str | Column, size: str | Column) -> Column:
    """Covered share of a grid of ``size`` pixels; null for a grid without any."""
    return safe_ratio(pixels(mask), col(size))


def run_iou(truth: str | Column, prediction: str | Column) -> Column:
    """Intersection over union of two masks of one grid; 1 if both are empty."""
    either = covered_pixels([truth, prediction], 1)
    return F.when(either == 0, F.lit(1.0)).otherwise(F.try_divide(covered_pixels([truth, prediction], 2).cast("double"), either.cast("double")))
