"""Stream forms of the frame operators, with state that outlasts restarts: value, list and map state, timers and TTL.

Each operator is a fold: what it knows of a stream, and a step for each frame in order of time. One stateful processor runs
every fold, so state, order, late frames, silence and expiry are handled in one place. The session needs the RocksDB
state store (``use_state_store``).

Frames of a stream must come in order from batch to batch; in a batch they may come in any. A frame that is not later than the last
one of its stream changes nothing and comes out as ``late``. All results but those of late frames equal the batch forms in
``frames``, however the log is cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from oriel.streaming.frames import CRITICAL, PRIORITIES


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def known(x: Any) -> Any:
    """None for what pandas writes for a null."""
    return None if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x else x


def percentile(values: list[float], p: float) -> float | None:
    """With linear interpolation between neighbours, in the engine's order of operations."""
    if not values:
        return None
    values = sorted(values)
    at = p * (len(values) - 1)
    low = int(at)
    high = low if at == low else low + 1
    if low == high or values[low] == values[high]:
        return values[low]
    return (high - at) * values[low] + (at - low) * values[high]


class Fold:
    """What an operator knows of a stream, and how a frame changes it.

    ``state`` are the fields of its value state and ``start`` their first values; ``window`` is how many numbers it keeps as a list state;
    ``out`` are the fields that it adds for each frame. ``silent_after_ms``: if set, ``silence`` is asked for a result
    when no frame came for so long of processing time.
    """

    state = "unused int"
    start: tuple = (None,)
    window = 0
    out = ""
    silent_after_ms: int | None = None

    def step(self, s: list, window: list, at: int, r: Any) -> tuple | None:
        """The values of ``out`` for frame ``r``, captured at ``at`` microseconds; changes ``s`` and ``window``. None: nothing comes out."""
        raise NotImplementedError

    def silence(self, s: list) -> tuple | None:
        """The values of ``out`` of a silence; None if it changes nothing."""
        return None


class LostPath(Fold):
    """``frames.lost_path``; a silence longer than the limit loses the path too."""

    state, start, out = "seen_at long, following boolean", (None, False), "path_state string"

    def __init__(self, limit_ms: int = 2500, seen: str = "view", timer: bool = False):
        self.limit, self.seen = limit_ms * 1000, seen
        self.silent_after_ms = limit_ms if timer else None

    def step(self, s, window, at, r):
        if r.status == self.seen:
            s[0] = at
        s[1] = s[0] is not None and at - s[0] <= self.limit
        return ("following" if s[1] else "lostPath",)

    def silence(self, s):
        was, s[1] = s[1], False
        return ("lostPath",) if was else None


class HazardHold(Fold):
    """``frames.hazard_hold``: flags of the last frames, -1 where the status isn't known."""

    out = "held boolean"

    def __init__(self, least: int = 3):
        self.window = least

    def step(self, s, window, at, r):
        status = known(r.status)
        window.append(-1.0 if status is None else float(status in CRITICAL))
        del window[: -self.window]
        return (max(window) != 0,)


class Machine(Fold):
    """``frames.machine_states`` over columns ``seen``, ``hazard``, ``failed``, ``slow`` and ``stop``; with ``timer`` a silence of
    ``watchdog_ms`` is a systemFailure."""

    state, start, out = "n long, run long, steady_at long, before long, calm long", (0, 0, None, None, None), "state string"

    def __init__(self, least: int = 3, hold_ms: int = 500, lost_ms: int = 2500, told_ms: int = 1000, watchdog_ms: int = 500, timer: bool = False):
        self.least, self.hold, self.lost, self.told, self.watchdog = least, hold_ms * 1000, lost_ms * 1000, told_ms * 1000, watchdog_ms * 1000
        self.silent_after_ms = watchdog_ms if timer else None

    def step(self, s, window, at, r):
        seen, hazard, failed, slow, stop = (known(getattr(r, c)) for c in ("seen", "hazard", "failed", "slow", "stop"))
        n, run, steady_at, before, calm = s
        n, run = n + 1, run + 1 if seen else 0
        calm = 0 if hazard is not False else None if calm is None else calm + 1
        steady_at = at if run >= self.least else steady_at
        age = None if steady_at is None else at - steady_at
        s[:] = n, run, steady_at, at, calm
        if stop is not False:
            return ("stopped",)
        if failed is not False or before is not None and at - before > self.watchdog:
            return ("systemFailure",)
        if calm is not None and calm < self.least:
            return ("hazardStop",)
        if age is not None and age <= self.hold:
            return ("tactileGuidance",)
        if seen:
            return ("tactileCandidate",)
        if age is not None and age <= self.lost + self.told:
            return ("uncertain" if age <= self.lost else "lostPath",)
        if n < self.least:
            return ("initializing",)
        return ("degraded" if slow is not False else "objectOnly",)

    def silence(self, s):
        return ("systemFailure",) if s[0] else None


class RollingP95(Fold):
    """``frames.rolling_p95``."""

    out = "p95 double, profile string"

    def __init__(self, window: int = 20, profiles: tuple[float, float] = (200.0, 500.0)):
        self.window, self.profiles = window, profiles

    def step(self, s, window, at, r):
        window.append(known(r.value))
        del window[: -self.window]
        p = percentile([v for v in window if v is not None], 0.95)
        return p, "minimal" if p is None or p > self.profiles[1] else "reduced" if p > self.profiles[0] else "full"


class Smoothed(Fold):
    """``frames.smoothed``."""

    out = "smooth_value double, median_value double"

    def __init__(self, window: int = 5):
        self.window = window

    def step(self, s, window, at, r):
        window.append(known(r.value))
        del window[: -self.window]
        values = [v for v in window if v is not None]
        return sum(values) / len(values) if values else None, percentile(values, 0.5)


class Frozen(Fold):
    """``frames.frozen``, as a flag: any of ``columns`` is as in the frame before."""

    state, start, out = "before array<string>", (None,), "frozen boolean"

    def __init__(self, columns: tuple[str, ...] = ("value",)):
        self.columns = columns

    def step(self, s, window, at, r):
        now = [None if (v := known(getattr(r, c))) is None else str(v + 0.0 if isinstance(v, float) else v) for c in self.columns]
        before, s[0] = s[0], now
        return (before is not None and any(a is not None and a == b for a, b in zip(now, before, strict=True)),)


class Warmup(Fold):
    """``frames.after_warmup``: the first frames of a stream don't come out."""

    state, start, out = "n long", (0,), "n long"

    def __init__(self, warmup: int):
        self.warmup = warmup

    def step(self, s, window, at, r):
        s[0] += 1
        return (s[0],) if s[0] > self.warmup else None


HEAD = "stream long, frame_id long, late boolean"


class Folded(StatefulProcessor):
    """Runs a fold: a value state and a list state for each stream, a timer for silences, and expiry of streams that are over."""

    def __init__(self, fold: Fold, ttl_ms: int | None = None):
        self.fold, self.ttl = fold, ttl_ms
        self.names = [f.split()[0] for f in f"{HEAD}, {fold.out}".split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, frame_id long", self.ttl)
        self.value = handle.getValueState("value", self.fold.state, self.ttl)
        self.numbers = handle.getListState("numbers", "x double", self.ttl) if self.fold.window else None
        self.timer = handle.getValueState("timer", "due long", self.ttl) if self.fold.silent_after_ms else None

    def state(self) -> tuple[list, list]:
        s = self.value.get()
        return list(self.fold.start if s is None else map(known, s)), [known(x[0]) for x in self.numbers.get()] if self.numbers else []

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        s, window = self.state()
        last = self.last.get()
        last = None if last is None else tuple(last)
        out = []
        for r in pd.concat(list(rows)).sort_values(["captured_at", "frame_id"]).itertuples(index=False):
            at = r.captured_at.value // 1000
            if last is not None and (at, r.frame_id) <= last:
                out.append((key[0], r.frame_id, True, *[None] * (len(self.names) - 3)))
                continue
            last = at, r.frame_id
            if (values := self.fold.step(s, window, at, r)) is not None:
                out.append((key[0], r.frame_id, False, *values))
        self.last.update(last)
        self.value.update(tuple(s))
        if self.numbers:
            self.numbers.put([(x,) for x in window])
        if self.timer:
            if (due := self.timer.get()) is not None:
                self.handle.deleteTimer(due[0])
            due = timerValues.getCurrentProcessingTimeInMs() + self.fold.silent_after_ms
            self.handle.registerTimer(due)
            self.timer.update((due,))
        yield pd.DataFrame(out, columns=self.names).astype({"stream": "int64", "frame_id": "Int64", "late": "bool"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        s, _ = self.state()
        self.timer.clear()
        values = self.fold.silence(s)
        self.value.update(tuple(s))
        out = [] if values is None else [(key[0], None, False, *values)]
        yield pd.DataFrame(out, columns=self.names).astype({"stream": "int64", "frame_id": "Int64", "late": "bool"})

    def close(self) -> None:
        pass


def folded(frames: DataFrame, fold: Fold, ttl_ms: int | None = None) -> DataFrame:
    """(stream, frame_id, late, and the fields of the fold) for each frame of a stream that the fold tells.

    A silence comes out without a frame_id. With ``ttl_ms`` a stream whose frames stop is forgotten after so long. Either
    asks for batches for ever, also where a trigger would end with the data: stop such a query.
    """
    mode = "ProcessingTime" if fold.silent_after_ms or ttl_ms else "None"
    return frames.groupBy("stream").transformWithStateInPandas(Folded(fold, ttl_ms), f"{HEAD}, {fold.out}", "Append", mode)


SAID = "stream long, captured_at timestamp, frame_id long, kind string, priority int, cancels boolean, flushed long"
WAITING = "frame_id long, kind string, tracked string, priority int"


class Feedback(StatefulProcessor):
    """``frames.announced`` on a stream, with STOP: list state holds the announcements of the moment that isn't over yet, map state
    the last time of each object and kind.

    A moment is over when a later frame comes, or after ``flush_ms`` without any. A moment with a ``stop`` says STOP alone: what
    waits is flushed, and what was said is forgotten.
    """

    def __init__(self, cooldown_ms: int, flush_ms: int | None = None):
        self.cooldown, self.flush = cooldown_ms * 1000, flush_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.moment = handle.getValueState("moment", "at long, stop_id long")
        self.waiting = handle.getListState("waiting", WAITING)
        self.told = handle.getMapState("told", "tracked string, kind string", "at long")
        self.timer = handle.getValueState("timer", "due long")

    def over(self, stream: int) -> list[tuple]:
        """What a moment that is over says."""
        now = self.moment.get()
        if now is None:
            return []
        at, stop_id = map(known, now)
        rows = [tuple(map(known, r)) for r in self.waiting.get()]
        self.moment.clear()
        self.waiting.clear()
        when = pd.Timestamp(at, unit="us")
        if stop_id is not None:
            self.told.clear()
            return [(stream, when, stop_id, "STOP", 0, True, len(rows))]
        said = []
        for frame_id, kind, tracked, priority in rows:
            key = ("" if tracked is None else f"+{tracked}", kind)
            last = self.told.getValue(key) if self.told.containsKey(key) else None
            if priority <= 2 or last is None or at - last[0] > self.cooldown:
                said.append((priority, frame_id, kind))
            self.told.updateValue(key, (at,))
        return [(stream, when, f, k, p, p <= 2, 0) for p, f, k in sorted(said)[:1]]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        frames = pd.concat(list(rows)).sort_values(["captured_at", "frame_id"])
        frames["_at"] = [t.value // 1000 for t in frames["captured_at"]]
        for at, part in frames.groupby("_at", sort=True):
            now = self.moment.get()
            if now is not None and now[0] > at:
                continue  # late: its moment is over
            if now is not None and now[0] < at:
                out += self.over(key[0])
                now = None
            stop = None if now is None else known(now[1])
            stops = [r.frame_id for r in part.itertuples(index=False) if known(r.stop) is True]
            self.moment.update((at, min([*stops, *([] if stop is None else [stop])], default=None)))
            for r in part.itertuples(index=False):
                if known(r.stop) is not True and known(r.kind) in PRIORITIES:
                    self.waiting.appendValue((r.frame_id, r.kind, None if known(r.tracked) is None else str(r.tracked), PRIORITIES.index(r.kind) + 1))
        if self.flush:
            if (due := self.timer.get()) is not None:
                self.handle.deleteTimer(due[0])
            due = timerValues.getCurrentProcessingTimeInMs() + self.flush
            self.handle.registerTimer(due)
            self.timer.update((due,))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in SAID.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield pd.DataFrame(self.over(key[0]), columns=[f.split()[0] for f in SAID.split(", ")])

    def close(self) -> None:
        pass


def feedback_stream(frames: DataFrame, kind: str, tracked: str, stop: str, cooldown_ms: int, flush_ms: int | None = None) -> DataFrame:
    """(stream, captured_at, frame_id, kind, priority, cancels, flushed): what is said, as ``frames.announced`` with ``stop``. Frames
    earlier than the moment that is waited for are passed over."""
    f = frames.select("stream", "frame_id", "captured_at", F.col(kind).alias("kind"), F.col(tracked).cast("string").alias("tracked"), F.col(stop).alias("stop"))
    return f.groupBy("stream").transformWithStateInPandas(Feedback(cooldown_ms, flush_ms), SAID, "Append", "ProcessingTime" if flush_ms else "None")
