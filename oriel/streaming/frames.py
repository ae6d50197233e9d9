"""Frame streams: totals while they run, and stateful operators; each has a batch form that replays a log.

Frames are rows with ``frame_id``, ``stream`` (key), ``captured_at``, ``value`` and ``status``. The state
machines follow a written design rather than measured behaviour, so their limits are parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oriel.functions.expressions import safe_ratio

#: States of the assistant.
STATES = ("initializing", "objectOnly", "tactileCandidate", "tactileGuidance", "lostPath", "degraded", "uncertain", "hazardStop", "systemFailure", "stopped")
#: Kinds of announcements, the most urgent first; the first two are critical.
PRIORITIES = ("drop", "obstacle", "lost_path", "direction", "object")
CRITICAL = ("obstacle", "hazard", "error")


def event_frames(events: DataFrame) -> DataFrame:
    """Events as frames; their time becomes a zoned timestamp, which watermarks need."""
    return events.select(
        F.col("event_id").alias("frame_id"), F.col("user_id").alias("stream"), F.col("ts").cast("timestamp").alias("captured_at"), F.col("event_type").alias("status"), F.col("value")
    )


def status_totals(frames: DataFrame) -> DataFrame:
    """Frames and summed values by status; works on batches, and on streams in complete mode."""
    return frames.groupBy("status").agg(F.count(F.lit(1)).alias("frames"), F.sum("value").alias("total_value"), F.max("value").alias("max_value"))


def after_warmup(frames: DataFrame, warmup: int, strict: bool = False) -> DataFrame:
    """Frames of each stream but for its first ``warmup`` ones. ``strict``: an error if a stream has no more than those, as
    it then has nothing to be measured."""
    w = Window.partitionBy("stream")
    x = frames.withColumn("_n", F.row_number().over(w.orderBy("captured_at", "frame_id")))
    if not strict:
        return x.filter(F.col("_n") > warmup).drop("_n")
    late = F.when(F.col("_all") > warmup, F.col("_n") > warmup).otherwise(F.raise_error(F.lit(f"a stream ends in its warm-up of {warmup} frames")).cast("boolean"))
    return x.withColumn("_all", F.count(F.lit(1)).over(w)).filter(late).drop("_n", "_all")


def fresh(frames: DataFrame, processed_at: str, ttl_ms: int) -> DataFrame:
    """Adds ``stale``: the frame was processed over ``ttl_ms`` after its capture, or its times aren't known."""
    age = (F.unix_micros(processed_at) - F.unix_micros("captured_at")) / F.lit(1000.0)
    return frames.withColumn("age_ms", age).withColumn("stale", F.coalesce(age > ttl_ms, F.lit(True)))


#: What windows are cut by; ``slices`` cuts streams further.
STREAM = ("stream",)


def _in_order(by: tuple[str, ...] = STREAM) -> Window:
    return Window.partitionBy(*by).orderBy("captured_at", "frame_id")


def gaps(frames: DataFrame, limit_ms: int, by: tuple[str, ...] = STREAM) -> DataFrame:
    """Frames that came over ``limit_ms`` after the one before of their stream: what a watchdog reports."""
    since = (F.unix_micros("captured_at") - F.unix_micros(F.lag("captured_at").over(_in_order(by)))) / F.lit(1000.0)
    return frames.withColumn("gap_ms", since).filter(F.col("gap_ms") > limit_ms)


def runs(frames: DataFrame) -> DataFrame:
    """Maximal runs of equal status in each stream: stream, status, run, length, first and last frame."""
    change = F.when(F.col("status").eqNullSafe(F.lag("status").over(_in_order())), 0).otherwise(1)
    numbered = frames.withColumn("_c", change).withColumn("run", F.sum("_c").over(_in_order().rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("stream", "run", "status").agg(F.count(F.lit(1)).alias("length"), F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"))


def stable(frames: DataFrame, least: int = 3, by: tuple[str, ...] = STREAM) -> DataFrame:
    """Adds ``stable_status``: the status once it has lasted ``least`` frames; a critical one holds at once."""
    w = _in_order(by).rowsBetween(-(least - 1), 0)
    same = (F.count(F.lit(1)).over(w) == least) & (F.min("status").over(w) == F.max("status").over(w)) & (F.count("status").over(w) == least)
    return frames.withColumn("stable_status", F.when(F.col("status").isin(*CRITICAL), F.col("status")).when(same, F.col("status")))


def hazard_hold(frames: DataFrame, least: int = 3, by: tuple[str, ...] = STREAM) -> DataFrame:
    """Adds ``held``: a critical frame stops at once; release only after ``least`` frames in a row without one."""
    w = _in_order(by).rowsBetween(-(least - 1), 0)
    recent = F.max(F.col("status").isin(*CRITICAL).cast("int")).over(w)
    return frames.withColumn("held", F.coalesce(recent == 1, F.lit(True)))


def lost_path(frames: DataFrame, limit_ms: int = 2500, seen: str = "view") -> DataFrame:
    """Adds ``path_state``: ``following`` while the last sighting (status ``seen``) is at most ``limit_ms`` old, else
    ``lostPath``; nothing seen yet is lost."""
    last = F.max(F.when(F.col("status") == seen, F.col("captured_at"))).over(_in_order().rowsBetween(Window.unboundedPreceding, 0))
    age = (F.unix_micros("captured_at") - F.unix_micros(last)) / F.lit(1000.0)
    return frames.withColumn("path_state", F.when(age <= limit_ms, "following").otherwise("lostPath"))


def rolling_p95(frames: DataFrame, window: int = 20, profiles: tuple[float, float] = (200.0, 500.0), by: tuple[str, ...] = STREAM) -> DataFrame:
    """Adds the exact 95th percentile of the last ``window`` values and its profile."""
    w = _in_order(by).rowsBetween(-(window - 1), 0)
    p = F.percentile("value", F.lit(0.95)).over(w)
    return frames.withColumn("p95", p).withColumn("profile", F.when(F.col("p95") <= profiles[0], "full").when(F.col("p95") <= profiles[1], "reduced").otherwise("minimal"))


def frozen(frames: DataFrame, columns: tuple[str, ...] = ("value",), by: tuple[str, ...] = STREAM) -> DataFrame:
    """Frames equal to the one before of their stream in any of ``columns`` (a content hash, a time, a value): a camera
    that repeats itself."""
    same = F.lit(False)
    for c in columns:
        same = same | F.coalesce(F.col(c) == F.lag(c).over(_in_order(by)), F.lit(False))
    return frames.withColumn("_same", same).filter("_same").drop("_same")


def area_depth(samples: str, least: float = 0.0) -> Column:
    """Median of the valid depths (above ``least``) of a small area; null, never 0, if none is valid."""
    valid = F.array_sort(F.filter(F.col(samples), lambda v: v.isNotNull() & ~F.isnan(v) & (v > least)))
    n = F.size(valid)
    middle = (F.get(valid, F.floor((n - 1) / 2).cast("int")) + F.get(valid, F.floor(n / 2).cast("int"))) / 2.0
    return F.when(n > 0, middle)


def smoothed(frames: DataFrame, window: int = 5, by: tuple[str, ...] = STREAM) -> DataFrame:
    w = _in_order(by).rowsBetween(-(window - 1), 0)
    return frames.withColumn("smooth_value", F.avg("value").over(w)).withColumn("median_value", F.percentile("value", F.lit(0.5)).over(w))


def cooled_down(frames: DataFrame, cooldown_ms: int) -> DataFrame:
    """The first frame of each (stream, status) run of announcements: one is repeated only after
    ``cooldown_ms`` without any of that status; critical ones always pass."""
    w = Window.partitionBy("stream", "status").orderBy("captured_at", "frame_id")
    since = (F.unix_micros("captured_at") - F.unix_micros(F.lag("captured_at").over(w))) / F.lit(1000.0)
    return frames.withColumn("_s", since).filter(F.col("_s").isNull() | (F.col("_s") > cooldown_ms) | F.col("status").isin(*CRITICAL)).drop("_s")


def announced(frames: DataFrame, kind: str, tracked: str, cooldown_ms: int, stop: str | None = None) -> DataFrame:
    """What is said: of each stream and moment the most urgent kind of ``PRIORITIES`` (then the lowest frame); one that
    isn't critical only if its object had no frame of that kind for ``cooldown_ms`` before. Adds ``priority`` and ``cancels``: a
    critical one stops what is being said.

    With a flag ``stop``, a moment in which it is set says STOP alone (priority 0, of its lowest such frame): the ``flushed`` messages
    of that moment aren't said, and what was said before is forgotten.
    """
    rank = F.array_position(F.array(*(F.lit(p) for p in PRIORITIES)), F.col(kind)).cast("int")
    keys, x, stops = ["stream", tracked, kind], frames.withColumn("priority", rank), None
    if stop:
        moment = Window.partitionBy("stream", "captured_at")
        told = F.coalesce(F.col(stop), F.lit(False))
        x = x.withColumn("_stop", told).withColumn("_first", F.min(F.when(told, F.col("frame_id"))).over(moment)).withColumn("flushed", F.count_if(~told & (F.col("priority") > 0)).over(moment))
        is_first = F.coalesce(F.col("_stop") & (F.col("_first") == F.col("frame_id")), F.lit(False))
        before = Window.partitionBy("stream").orderBy(F.unix_micros("captured_at")).rangeBetween(Window.unboundedPreceding, -1)
        x = x.withColumn("_is_first", is_first).withColumn("_epoch", F.coalesce(F.sum(F.col("_is_first").cast("int")).over(before), F.lit(0)))
        stops = x.filter("_is_first").withColumns({kind: F.lit("STOP"), "priority": F.lit(0), "cancels": F.lit(True)}).drop("_stop", "_first", "_is_first", "_epoch")
        x, keys = x.filter("NOT _stop"), [*keys, "_epoch"]
    own = Window.partitionBy(*keys).orderBy("captured_at", "frame_id")
    since = (F.unix_micros("captured_at") - F.unix_micros(F.lag("captured_at").over(own))) / F.lit(1000.0)
    x = x.filter("priority > 0").withColumn("_since", since).withColumn("cancels", F.col("priority") <= 2)
    x = x.filter(F.col("cancels") | F.col("_since").isNull() | (F.col("_since") > cooldown_ms)).drop("_since")
    if stop:
        x = x.filter(F.col("_first").isNull()).withColumn("flushed", F.lit(0).cast("long")).drop("_stop", "_first", "_is_first", "_epoch")
    first = F.row_number().over(Window.partitionBy("stream", "captured_at").orderBy("priority", "frame_id"))
    said = x.withColumn("_said", first).filter("_said = 1").drop("_said")
    return said if stops is None else said.unionByName(stops)


def accepted_when_free(frames: DataFrame, service_ms: int) -> DataFrame:
    """Adds ``dropped``: the frame came while an accepted one of its stream was still being processed, which takes
    ``service_ms``; nothing is queued.

    A gap of ``service_ms`` frees the stream whatever came before, so only bursts between such gaps are folded, each
    in one row. A live stream needs one time for each key (``busy_stream``).
    """
    at = F.unix_micros("captured_at")
    free = F.coalesce(at - F.lag(at).over(_in_order()) >= service_ms * 1000, F.lit(True))
    bursts = frames.withColumn("_at", at).withColumn("_burst", F.sum(free.cast("int")).over(_in_order().rowsBetween(Window.unboundedPreceding, 0)))
    sorted_ = F.array_sort(F.collect_list(F.struct("_at", "frame_id")))
    start = F.struct(F.lit(-(1 << 62)).cast("long").alias("until"), F.array().cast("array<bigint>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        takes = x["_at"] >= acc["until"]
        return F.struct(F.when(takes, x["_at"] + service_ms * 1000).otherwise(acc["until"]).alias("until"), F.when(takes, F.concat(acc["taken"], F.array(x["frame_id"]))).otherwise(acc["taken"]).alias("taken"))

    folded = bursts.groupBy("stream", "_burst").agg(F.aggregate(sorted_, start, step)["taken"].alias("_taken"))
    return bursts.join(folded, ["stream", "_burst"]).withColumn("dropped", ~F.array_contains("_taken", F.col("frame_id"))).drop("_at", "_burst", "_taken")


def busy_stream(frames: DataFrame, service_ms: int) -> DataFrame:
    """On a stream: (stream, frame_id, dropped), as ``accepted_when_free``; state is the time until which a key is busy."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values(["captured_at", "frame_id"]).itertuples():
            at = r.captured_at.value // 1000
            dropped = until is not None and at < until
            until = until if dropped else at + service_ms * 1000
            out.append((key[0], r.frame_id, dropped))
        state.update((until,))
        yield pd.DataFrame(out, columns=["stream", "frame_id", "dropped"])

    return frames.groupBy("stream").applyInPandasWithState(step, "stream long, frame_id long, dropped boolean", "until long", "append", GroupStateTimeout.NoTimeout)


def dropped_when_busy(frames: DataFrame, busy: str = "busy") -> DataFrame:
    """Frames by stream, and how many of them came while one was in flight."""
    return frames.groupBy("stream").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col(busy)).alias("dropped")).withColumn("drop_rate", safe_ratio("dropped", "frames"))


def machine_states(frames: DataFrame, path: str, hazard: str, failed: str, slow: str, stop: str, least: int = 3, hold_ms: int = 500, lost_ms: int = 2500, told_ms: int = 1000, watchdog_ms: int = 500) -> DataFrame:
    """Adds ``state``, one of ``STATES``, from what each frame shows (boolean columns; null fails safe).

    In this order: a stop stops; a failure, or over ``watchdog_ms`` since the frame before, is systemFailure; a hazard is
    hazardStop at once and until ``least`` frames in a row show none; a path seen in ``least`` frames in a row guides,
    and goes on guiding for ``hold_ms`` after it was last stable; one seen for less is a candidate; without it the state is
    uncertain until ``lost_ms``, then lostPath for ``told_ms``, in which STOP is told, then objectOnly. Before ``least`` frames
    have come it is initializing; slow frames without a path are degraded.
    """
    w = _in_order()
    recent = w.rowsBetween(-(least - 1), 0)
    seen, danger = F.coalesce(F.col(path), F.lit(False)), F.coalesce(F.col(hazard), F.lit(True))
    at = F.unix_micros("captured_at") / F.lit(1000.0)
    steady = (F.min(seen.cast("int")).over(recent) == 1) & (F.count(F.lit(1)).over(recent) == least)
    x = frames.withColumn("_steady", steady).withColumn("_gap", at - F.lag(at).over(w)).withColumn("_held", F.max(danger.cast("int")).over(recent) == 1).withColumn("_n", F.row_number().over(w))
    age = at - F.max(F.when(F.col("_steady"), at)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    state = (
        F.when(F.coalesce(F.col(stop), F.lit(True)), "stopped")
        .when(F.coalesce(F.col(failed), F.lit(True)) | F.coalesce(F.col("_gap") > watchdog_ms, F.lit(False)), "systemFailure")
        .when(F.col("_held"), "hazardStop")
        .when(age <= hold_ms, "tactileGuidance")
        .when(seen, "tactileCandidate")
        .when(age <= lost_ms, "uncertain")
        .when(age <= lost_ms + told_ms, "lostPath")
        .when(F.col("_n") < least, "initializing")
        .when(F.coalesce(F.col(slow), F.lit(True)), "degraded")
        .otherwise("objectOnly")
    )
    return x.withColumn("state", state).drop("_steady", "_gap", "_held", "_n")


def transitions(frames: DataFrame) -> DataFrame:
    """Changes of status in each stream: stream, frame_id, from_status, to_status."""
    before = F.lag("status").over(_in_order())
    return frames.withColumn("from_status", before).filter(F.col("from_status").isNotNull() & (F.col("from_status") != F.col("status"))).select("stream", "frame_id", "from_status", F.col("status").alias("to_status"))


def replayed(actual: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """Transitions that only one of two timelines has."""
    a = actual.select(*key).withColumn("actual", F.lit(True))
    e = expected.select(*key).withColumn("expected", F.lit(True))
    return a.join(e, key, "full_outer").filter("actual IS NULL OR expected IS NULL").select(*key, F.when(F.col("actual").isNull(), "missing").otherwise("unexpected").alias("fault"))


def watchdog_stream(frames: DataFrame, limit_ms: int = 500) -> DataFrame:
    """On a stream: one row for each stream key and batch of its frames, and one ``failure`` row when no frame came
    for ``limit_ms`` of processing time. State is one count per key; it outlasts a failure, so that a stream
    that comes back goes on counting. It never ends by itself: stop the query, or give it a deadline.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            total = state.get[0]
            state.update((total,))  # without a new timeout: a silence is told once
            yield pd.DataFrame({"stream": [key[0]], "frames": [total], "state": ["failure"]})
            return
        total = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((total,))
        state.setTimeoutDuration(limit_ms)
        yield pd.DataFrame({"stream": [key[0]], "frames": [total], "state": ["fresh"]})

    return frames.groupBy("stream").applyInPandasWithState(step, "stream long, frames long, state string", "frames long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def stable_stream(frames: DataFrame, least: int = 3) -> DataFrame:
    """On a stream: rows where a stream's status has become stable, that is has lasted ``least`` frames, or is
    critical. State is a status and a length per key; frames of a batch are put in order first."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, length = state.get if state.exists else ("", 0)
        out = []
        for r in pd.concat(list(batches)).sort_values(["captured_at", "frame_id"]).itertuples():
            length = length + 1 if r.status == status else 1
            status = r.status
            if length == least or status in CRITICAL and length == 1:
                out.append((key[0], r.frame_id, status))
        state.update((status, length))
        yield pd.DataFrame(out, columns=["stream", "frame_id", "stable_status"])

    return frames.groupBy("stream").applyInPandasWithState(step, "stream long, frame_id long, stable_status string", "status string, length long", "append", GroupStateTimeout.NoTimeout)
