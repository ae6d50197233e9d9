"""Frame operators over one hot stream: the log is cut into slices of time, each the work of one task.

What a slice does to the state of its stream is summed up as a small value or function, the summaries are put together
in order, and each slice is replayed from the state that it is entered with. Results equal those of the
operators in ``frames``, whatever the slices. Only summaries of a stream meet in one task: a few rows for each slice.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oriel.plans.tables import written
from oriel.streaming.frames import _in_order

SLICE_ROWS = 1 << 20
PART = ("_slice", "stream")


def sliced(frames: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``frames`` dealt by ranges of (stream, captured_at, frame_id), of about ``slice_rows`` each, with their range as ``_slice``; a
    range may hold several streams, and a stream several ranges. Written, as ranges must not be drawn anew."""
    parts = max(1, -(-frames.count() // slice_rows))
    return written(frames.repartitionByRange(parts, "stream", "captured_at", "frame_id").withColumn("_slice", F.spark_partition_id()), "slices")


def entered_with(parts: DataFrame, value: Column, name: str, total: Callable[[Column], Column]) -> DataFrame:
    """(_slice, stream, ``name``): ``total`` of ``value`` over all earlier slices of the stream."""
    own = parts.groupBy(*PART).agg(total(value).alias("_v"))
    before = Window.partitionBy("stream").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return own.select(*PART, total(F.col("_v")).over(before).alias(name))


def with_last_rows(parts: DataFrame, back: int) -> DataFrame:
    """``parts`` and, for each slice of a stream, the ``back`` frames before it once more, marked by ``_ghost``.

    A slice has a frame of the stream at least, so ``back`` slices before it hold all of them.
    """
    frame = F.struct("captured_at", "frame_id", *[c for c in parts.columns if c not in ("_slice", "captured_at", "frame_id")])
    late = F.row_number().over(Window.partitionBy(*PART).orderBy(F.desc_nulls_last("captured_at"), F.desc("frame_id")))
    tails = parts.withColumn("_late", late).filter(F.col("_late") <= back).groupBy(*PART).agg(F.array_sort(F.collect_list(F.struct((-F.col("_late")).alias("o"), frame.alias("r")))).alias("tail"))
    earlier = F.flatten(F.collect_list("tail").over(Window.partitionBy("stream").orderBy("_slice").rowsBetween(-back, -1)))
    last = F.slice("earlier", F.greatest(F.size("earlier") - back + 1, F.lit(1)), back)
    ghosts = tails.select("_slice", earlier.alias("earlier")).select("_slice", F.explode(last).alias("x")).select("_slice", "x.r.*", F.lit(True).alias("_ghost"))
    return parts.withColumn("_ghost", F.lit(False)).unionByName(ghosts)


def over_slices(frames: DataFrame, back: int, operator: Callable[[DataFrame], DataFrame], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """An operator that looks at the ``back`` frames before each one; it is to cut its windows by ``PART``, as with
    ``lambda f: frames.stable(f, 3, by=PART)``."""
    return operator(with_last_rows(sliced(frames, slice_rows), back)).filter("NOT _ghost").drop("_ghost", "_slice")


def lost_path(frames: DataFrame, limit_ms: int = 2500, seen: str = "view", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``frames.lost_path``: a slice passes on its last sighting."""
    parts = sliced(frames, slice_rows)
    sighting = F.when(F.col("status") == seen, F.col("captured_at"))
    entry = entered_with(parts, sighting, "_entry", F.max)
    last = F.greatest(F.max(sighting).over(_in_order(PART).rowsBetween(Window.unboundedPreceding, 0)), F.col("_entry"))
    age = (F.unix_micros("captured_at") - F.unix_micros(last)) / F.lit(1000.0)
    return parts.join(entry, list(PART)).withColumn("path_state", F.when(age <= limit_ms, "following").otherwise("lostPath")).drop("_entry", "_slice")


def runs(frames: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``frames.runs``: a slice passes on its last status and how many runs have begun."""
    change = F.when(F.col("status").eqNullSafe(F.lag("status").over(_in_order(PART))) & F.lag(F.lit(1)).over(_in_order(PART)).isNotNull(), 0).otherwise(1)
    first = F.row_number().over(_in_order()) == 1  # of slices of a stream below
    parts = with_last_rows(sliced(frames, slice_rows), 1).withColumn("_c", change).filter("NOT _ghost").drop("_ghost")
    heads = parts.groupBy(*PART).agg(F.min(F.struct("captured_at", "frame_id", "status")).alias("h"), F.sum("_c").alias("_n"))
    # As in the plain form, a stream that begins without a status begins with run 0.
    heads = heads.select(*PART, F.col("h.captured_at").alias("captured_at"), F.col("h.frame_id").alias("frame_id"), F.col("h.status").alias("status"), "_n")
    less = F.when(first & F.col("status").isNull(), 1).otherwise(0)
    heads = heads.withColumn("_n", F.col("_n") - less).withColumn("_less", less)
    before = Window.partitionBy("stream").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    entry = heads.select(*PART, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_less")).alias("_entry"))
    numbered = parts.join(entry, list(PART)).withColumn("run", F.col("_entry") + F.sum("_c").over(_in_order(PART).rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("stream", "run", "status").agg(F.count(F.lit(1)).alias("length"), F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"))


def exits(at: np.ndarray, service: int) -> tuple[list[int], list[int]]:
    """What frames at times ``at`` (in order) do to the time until which their stream is busy: it is entered with ``u`` and left
    with the second value of the first pair whose first value is at least ``u``, or with ``u`` if there is none.

    A frame that is taken leads to the next one after ``service``; chains from later frames never end earlier, and soon are the same,
    so there are few steps. A slice is entered with at most its first time and ``service``, so only frames up to there count.
    """
    n = len(at)
    after = np.maximum(np.searchsorted(at, at + service, "left"), np.arange(1, n + 1))
    ends = at + service
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            ends[i] = ends[after[i]]
    if n:
        upto = int(np.searchsorted(at, at[0] + service, "left"))
        at, ends = at[: upto + 1], ends[: upto + 1]
    last = np.flatnonzero(np.append(ends[1:] != ends[:-1], True)) if len(at) else np.zeros(0, int)
    return at[last].tolist(), ends[last].tolist()


def taken(at: np.ndarray, service: int, until: int | None) -> np.ndarray:
    """Which frames are taken by a stream that is busy ``until``."""
    out, i = np.zeros(len(at), bool), 0 if until is None else int(np.searchsorted(at, until, "left"))
    while i < len(at):
        out[i] = True
        i = max(i + 1, int(np.searchsorted(at, at[i] + service, "left")))
    return out


def accepted_when_free(frames: DataFrame, service_ms: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``frames.accepted_when_free``: a slice passes on a step function, from the time until which it finds the stream busy to
    the one until which it leaves it so."""
    service, columns = service_ms * 1000, frames.columns
    parts = sliced(frames, slice_rows).withColumn("_at", F.unix_micros("captured_at"))

    def summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        upto, end = exits(np.sort(rows["_at"].dropna().to_numpy("int64")), service)
        return pd.DataFrame([(*key, upto, end)], columns=["_slice", "stream", "upto", "end"])

    def entries(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out, until = [], None
        for r in rows.sort_values("_slice").itertuples():
            out.append((r._1, key[0], until))
            k = 0 if until is None else bisect_left(r.upto, until)
            until = int(r.end[k]) if k < len(r.end) else until
        return pd.DataFrame({"_slice": [x[0] for x in out], "stream": [x[1] for x in out], "_until": pd.array([x[2] for x in out], "Int64")})

    kind = frames.schema["stream"].dataType
    head = [T.StructField("_slice", T.IntegerType()), T.StructField("stream", kind)]
    steps = parts.select(*PART, "_at").groupBy(*PART).applyInPandas(summed, T.StructType([*head, T.StructField("upto", T.ArrayType(T.LongType())), T.StructField("end", T.ArrayType(T.LongType()))]))
    entry = steps.groupBy("stream").applyInPandas(entries, T.StructType([*head, T.StructField("_until", T.LongType())]))

    def replayed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_at", "frame_id"])
        known = rows["_at"].notna().to_numpy()
        until = rows["_until"].iloc[0]
        dropped = np.ones(len(rows), bool)
        dropped[known] = ~taken(rows["_at"][known].to_numpy("int64"), service, None if pd.isna(until) else int(until))
        return rows.assign(dropped=dropped)[[*columns, "dropped"]]

    schema = T.StructType([*frames.schema.fields, T.StructField("dropped", T.BooleanType())])
    return parts.join(entry, list(PART)).groupBy(*PART).applyInPandas(replayed, schema)
