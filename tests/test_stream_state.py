"""Stateful streams against the batch forms over the same log, across a restart; hot streams in slices."""

import random
import time
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from oriel.streaming import frames as S
from oriel.streaming import processors as P
from oriel.streaming import slices as L

SCHEMA = "frame_id long, stream long, captured_at timestamp, status string, value double, seen boolean, hazard boolean, failed boolean, slow boolean, stop boolean, kind string, tracked string, halt boolean"
START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def log(n=160, streams=2, seed=3):
    r, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at += r.choice([0, 40, 40, 90, 200, 700, 3000])
        rows.append((
            i, i % streams if streams > 1 else 0, START + timedelta(milliseconds=at), r.choice(["view", "view", "click", "error", "hazard", None]), r.choice([None, float(r.randint(0, 900)), 5.0]),
            r.random() < 0.8, r.choice([False] * 9 + [True, None]), r.choice([False] * 30 + [True, None]), r.random() < 0.5, r.random() < 0.05,
            r.choice([*S.PRIORITIES, "none", None]), r.choice(["x", "y", None]), r.random() < 0.1,
        ))
    return rows


@pytest.fixture(scope="module")
def stateful(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    P.use_state_store(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, folder, rows, cuts, operator):
    """Rows written as files cut at ``cuts``, the last one after a restart from the checkpoint."""
    src, out = f"{folder}/in", f"{folder}/out"
    edges = [0, *cuts, len(rows)]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        part = rows[a:b]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        if k < len(edges) - 3 and len(edges) > 3:
            continue  # the first two files are there when the query starts
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        q = operator(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


FOLDS = {
    "lost_path": (lambda: P.LostPath(), lambda f: S.lost_path(f).select("stream", "frame_id", "path_state")),
    "hazard_hold": (lambda: P.HazardHold(), lambda f: S.hazard_hold(f).select("stream", "frame_id", "held")),
    "machine": (lambda: P.Machine(), lambda f: S.machine_states(f, "seen", "hazard", "failed", "slow", "stop").select("stream", "frame_id", "state")),
    "p95": (lambda: P.RollingP95(7), lambda f: S.rolling_p95(f, 7).select("stream", "frame_id", "p95", "profile")),
    "smoothed": (lambda: P.Smoothed(), lambda f: S.smoothed(f).select("stream", "frame_id", "smooth_value", "median_value")),
    "frozen": (lambda: P.Frozen(("value", "captured_at")), lambda f: S.frozen(f, ("value", "captured_at")).select("stream", "frame_id", F.lit(True).alias("frozen"))),
    "warmup": (lambda: P.Warmup(5), lambda f: S.after_warmup(f, 5).select("stream", "frame_id")),
}


class Steps:
    """A fold run frame by frame, without Spark."""

    def __init__(self, fold):
        self.fold = fold

    def over(self, rows):
        states, out = {}, []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for x in sorted(rows, key=lambda x: (x[2], x[0])):
            row = type("Row", (), dict(zip(names, x)))
            s, window = states.setdefault(x[1], (list(self.fold.start), []))
            if (v := self.fold.step(s, window, round(x[2].timestamp() * 1e6), row)) is not None:
                out.append((x[1], x[0], *v))
        return out


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", FOLDS)
def test_folds_equal_the_batch_forms(spark, name):
    fold, batch = FOLDS[name]
    rows = log(400, 3)
    got = Steps(fold()).over(rows)
    if name == "frozen":
        got = [r for r in got if r[2]]
    if name == "warmup":
        got = [r[:2] for r in got]
    assert plain(got) == plain(batch(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect())


@pytest.mark.parametrize("name, cuts", [("machine", [50, 110]), ("p95", [3])])
def test_streams_equal_the_batch_forms(stateful, tmp_path, name, cuts):
    fold, batch = FOLDS[name]
    rows = log()
    got = streamed(stateful, tmp_path, rows, cuts, lambda s: P.folded(s, fold()))
    assert not got.filter("late").count()
    assert plain(got.drop("late").collect()) == plain(batch(stateful.createDataFrame(rows, SCHEMA)).collect())


def test_late_frames_change_nothing(stateful, tmp_path):
    rows = [r for r in log(60, 1)]
    rows[50] = (*rows[50][:2], START, *rows[50][3:])
    got = streamed(stateful, tmp_path, rows, [50], lambda s: P.folded(s, P.HazardHold()))
    assert [(r["frame_id"], r["held"]) for r in got.filter("late").collect()] == [(50, None)]
    want = S.hazard_hold(stateful.createDataFrame(rows[:50] + rows[51:], SCHEMA)).select("frame_id", "held").collect()
    assert plain(got.filter("NOT late").select("frame_id", "held").collect()) == plain(want)


def test_feedback_stream_with_stop(stateful, tmp_path):
    rows = log(150, 1, 5)
    rows += [(1000 + k, k, START + timedelta(days=1), *[None] * 10) for k in range(2)]  # ends the last moments
    got = streamed(stateful, tmp_path, rows, [90], lambda s: P.feedback_stream(s, "kind", "tracked", "halt", 1000))
    want = S.announced(stateful.createDataFrame(rows, SCHEMA), "kind", "tracked", 1000, stop="halt")
    columns = ["stream", "frame_id", "kind", "priority", "cancels", "flushed"]
    assert plain(got.select(columns).collect()) == plain(want.select(columns).collect())
    assert got.filter("kind = 'STOP' AND flushed > 0").count() and got.filter("priority > 2").count()


def test_silence_is_told_by_a_timer(stateful, tmp_path):
    rows = [(i, i % 2, START + timedelta(milliseconds=10 * i), "view", *[None] * 9) for i in range(6)]
    stateful.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = stateful.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    q = P.folded(stream, P.LostPath(500, timer=True)).writeStream.format("memory").queryName("silent").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        until = time.time() + 90  # a timer asks for batches for ever, so the test ends the query
        while time.time() < until and stateful.table("silent").filter("frame_id IS NULL").count() < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    told = stateful.table("silent").collect()
    assert sorted(r["stream"] for r in told if r["frame_id"] is None and r["path_state"] == "lostPath") == [0, 1]
    assert sum(r["path_state"] == "following" for r in told) == 6


@pytest.mark.parametrize("streams", [1, 4])
def test_slices_equal_whole_streams(spark, streams):
    rows = log(500, streams, 8)
    rows += [(900, 7, START, None, None, *[None] * 8), (901, 7, START, None, None, *[None] * 8), (902, 7, START, "view", None, *[None] * 8)]
    f = spark.createDataFrame(rows, SCHEMA).coalesce(1).cache()
    for size in (1 << 20, 30):
        same = lambda a, b, c: sorted(map(str, a.select(c).collect())) == sorted(map(str, b.select(c).collect()))  # noqa: B023, E731
        assert same(L.lost_path(f, slice_rows=size), S.lost_path(f), ["frame_id", "path_state", "value"])
        assert same(L.runs(f, size), S.runs(f), ["stream", "run", "status", "length", "first_at", "last_at"])
        assert same(L.accepted_when_free(f, 400, size), S.accepted_when_free(f, 400), ["frame_id", "stream", "captured_at", "dropped"])
        both = lambda x, by: S.hazard_hold(S.rolling_p95(S.stable(x, 3, by=by), 7, by=by), 5, by=by)
        assert same(L.over_slices(f, 6, lambda x: both(x, L.PART), size), both(f, S.STREAM), ["frame_id", "p95", "stable_status", "held"])  # noqa: B023
    parts = L.sliced(f, 30).groupBy("_slice").count().collect()
    assert len(parts) > 12 and max(r["count"] for r in parts) < 90
    assert L.runs(f.limit(0)).count() == 0 and L.accepted_when_free(f.limit(0), 400).count() == 0


def test_step_functions_stand_for_slices():
    r = random.Random(4)
    for _ in range(200):
        at = np.sort(np.array([r.randrange(400) for _ in range(r.randint(1, 60))], dtype="int64"))
        service = r.choice([0, 1, 7, 40])
        upto, end = L.exits(at, service)
        for u in [None, *range(int(at[0]) + service + 1)]:
            took = L.taken(at, service, u)
            want = int(at[took][-1]) + service if took.any() else u
            k = 0 if u is None else next((i for i, x in enumerate(upto) if x >= u), len(upto))
            assert (end[k] if k < len(end) else u) == want


def test_a_stream_within_its_warmup_is_an_error(spark):
    f = spark.createDataFrame(log(9, 2), SCHEMA)
    assert S.after_warmup(f, 3, strict=True).count() == 3
    with pytest.raises(Exception, match="warm-up"):
        S.after_warmup(f, 4, strict=True).collect()
