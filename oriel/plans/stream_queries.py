"""Queries over frame logs: the batch forms of the stream operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from oriel.plans.registry import query, table
from oriel.streaming import frames as S
from oriel.streaming import slices as L

_E = "(SELECT event_id AS frame_id, user_id AS stream, ts AS t, event_type AS status, value FROM events)"
_W = "(PARTITION BY stream ORDER BY t, frame_id)"
_W3 = "(PARTITION BY stream ORDER BY t, frame_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


def frames(spark, sf_dir):
    return S.event_frames(table(spark, sf_dir, "events"))


@query(f"SELECT status, count(*) AS frames, sum(value) AS total_value, max(value) AS max_value FROM {_E} GROUP BY status")
def frame_status_counts(spark, sf_dir):
    return S.status_totals(frames(spark, sf_dir))


@query(f"SELECT frame_id, age_ms, age_ms > 500 AS stale FROM (SELECT frame_id, round(value * 10) * 1.0 AS age_ms FROM {_E})")
def stale_frames(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("processed_at", F.timestamp_micros(F.unix_micros("captured_at") + (F.round(F.col("value") * 10) * 1000).cast("long")))
    return S.fresh(f, "processed_at", 500).select("frame_id", "age_ms", "stale")


@query(f"SELECT frame_id, stream, gap_ms FROM (SELECT *, (epoch_us(t) - epoch_us(lag(t) OVER {_W})) / 1000.0 AS gap_ms FROM {_E}) WHERE gap_ms > 3600000")
def watchdog_gaps(spark, sf_dir):
    return S.gaps(frames(spark, sf_dir), 3_600_000).select("frame_id", "stream", "gap_ms")


@query(f"""SELECT stream, status, run, count(*) AS length FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY stream ORDER BY t, frame_id ROWS UNBOUNDED PRECEDING) AS bigint) AS run FROM (SELECT *, CASE WHEN status IS NOT DISTINCT FROM lag(status) OVER {_W} THEN 0 ELSE 1 END AS c FROM {_E})) GROUP BY stream, status, run""")
def state_runs(spark, sf_dir):
    return S.runs(frames(spark, sf_dir)).select("stream", "status", "run", "length")


@query(f"SELECT frame_id, CASE WHEN status IN ('obstacle', 'hazard', 'error') THEN status WHEN count(*) OVER {_W3} = 3 AND min(status) OVER {_W3} = max(status) OVER {_W3} AND count(status) OVER {_W3} = 3 THEN status END AS stable_status FROM {_E}")
def stable_states(spark, sf_dir):
    return S.stable(frames(spark, sf_dir)).select("frame_id", "stable_status")


@query(f"SELECT frame_id, max(CASE WHEN status IN ('obstacle', 'hazard', 'error') THEN 1 ELSE 0 END) OVER {_W3} = 1 AS held FROM {_E}")
def hazard_hold(spark, sf_dir):
    return S.hazard_hold(frames(spark, sf_dir)).select("frame_id", "held")


@query(f"""SELECT frame_id, CASE WHEN (epoch_us(t) - epoch_us(seen)) / 1000.0 <= 7200000 THEN 'following' ELSE 'lostPath' END AS path_state FROM (SELECT *, max(CASE WHEN status = 'view' THEN t END) OVER (PARTITION BY stream ORDER BY t, frame_id ROWS UNBOUNDED PRECEDING) AS seen FROM {_E})""")
def lost_path(spark, sf_dir):
    return S.lost_path(frames(spark, sf_dir), 7_200_000).select("frame_id", "path_state")


@query(f"""SELECT frame_id, p95, CASE WHEN p95 <= 20 THEN 'full' WHEN p95 <= 50 THEN 'reduced' ELSE 'minimal' END AS profile FROM (SELECT frame_id, quantile_cont(value, 0.95) OVER (PARTITION BY stream ORDER BY t, frame_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS p95 FROM {_E})""")
def rolling_p95(spark, sf_dir):
    return S.rolling_p95(frames(spark, sf_dir), 20, (20.0, 50.0)).select("frame_id", "p95", "profile")


@query(f"SELECT frame_id, stream FROM (SELECT *, lag(t) OVER {_W} AS u, lag(h) OVER {_W} AS g FROM (SELECT *, md5(status || (CAST(value AS bigint) // 20)) AS h FROM {_E})) WHERE h = g OR t = u")
def frozen_frames(spark, sf_dir):
    """Frames whose content hash or time is that of the one before."""
    f = frames(spark, sf_dir).withColumn("content", F.md5(F.concat("status", F.floor(F.rint("value") / 20).cast("string"))))
    return S.frozen(f, ("content", "captured_at")).select("frame_id", "stream")


@query("SELECT vec_id, CASE WHEN len(v) > 0 THEN (v[(len(v) + 1) // 2] + v[len(v) // 2 + 1]) / 2 END AS depth FROM (SELECT vec_id, list_sort(list_filter(list_transform(embedding, lambda x: CAST(x AS double)), lambda x: x > 0)) AS v FROM embeddings)")
def area_depth(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.select("vec_id", S.area_depth("v").alias("depth"))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT stream, frame_id, epoch_us(t) AS t FROM {_E}), a AS (SELECT stream, min(t) AS t FROM e GROUP BY stream
UNION ALL SELECT a.stream, min(e.t) FROM a JOIN e ON e.stream = a.stream AND e.t >= a.t + 43200000000 GROUP BY a.stream)
SELECT frame_id, NOT EXISTS (SELECT 1 FROM a WHERE a.stream = e.stream AND a.t = e.t) AS dropped FROM e""")
def busy_drops(spark, sf_dir):
    """Frames that come while the last accepted one is still processed, which takes twelve hours here."""
    return S.accepted_when_free(frames(spark, sf_dir), 43_200_000).select("frame_id", "dropped")


_KIND = "CASE status WHEN 'error' THEN 'drop' WHEN 'purchase' THEN 'obstacle' WHEN 'view' THEN 'lost_path' WHEN 'signup' THEN 'direction' ELSE 'object' END"


@query(f"""SELECT frame_id, kind, priority, priority <= 2 AS cancels FROM (SELECT *, row_number() OVER (PARTITION BY stream, t ORDER BY priority, frame_id) AS first FROM (SELECT *, (epoch_us(t) - epoch_us(lag(t) OVER (PARTITION BY stream, tracked, kind ORDER BY t, frame_id))) / 1000.0 AS since FROM
(SELECT stream, frame_id, t, kind, CAST(floor(value) AS bigint) % 3 AS tracked, CAST(list_position(['drop', 'obstacle', 'lost_path', 'direction', 'object'], kind) AS integer) AS priority FROM (SELECT *, {_KIND} AS kind FROM {_E}))) WHERE priority <= 2 OR since IS NULL OR since > 86400000) WHERE first = 1""")
def priority_feedback(spark, sf_dir):
    s = F.col("status")
    kind = F.when(s == "error", "drop").when(s == "purchase", "obstacle").when(s == "view", "lost_path").when(s == "signup", "direction").otherwise("object")
    f = frames(spark, sf_dir).withColumn("kind", kind).withColumn("tracked", F.floor("value") % 3)
    return S.announced(f, "kind", "tracked", 86_400_000).select("frame_id", "kind", "priority", "cancels")


_HOUR = 3_600_000_000


@query(f"""WITH f AS (SELECT *, epoch_us(t) AS u, status IN ('view', 'click') AS seen, status = 'error' AND value > 60 AS hazard, status = 'error' AND value < 5 AS failed, value > 80 AS slow, status = 'purchase' AND value < 10 AS stop FROM {_E}),
g AS (SELECT *, u - lag(u) OVER {_W} AS gap, max(hazard) OVER {_W3} AS held, row_number() OVER {_W} AS n, min(seen) OVER {_W3} AND count(*) OVER {_W3} = 3 AS steady FROM f),
h AS (SELECT *, u - max(CASE WHEN steady THEN u END) OVER (PARTITION BY stream ORDER BY t, frame_id ROWS UNBOUNDED PRECEDING) AS age FROM g)
SELECT frame_id, CASE WHEN stop THEN 'stopped' WHEN failed OR coalesce(gap > {40 * _HOUR}, false) THEN 'systemFailure' WHEN held THEN 'hazardStop' WHEN age <= {20 * _HOUR} THEN 'tactileGuidance' WHEN seen THEN 'tactileCandidate'
WHEN age <= {60 * _HOUR} THEN 'uncertain' WHEN age <= {80 * _HOUR} THEN 'lostPath' WHEN n < 3 THEN 'initializing' WHEN slow THEN 'degraded' ELSE 'objectOnly' END AS state FROM h""")
def machine_states(spark, sf_dir):
    f = frames(spark, sf_dir)
    s, v = F.col("status"), F.col("value")
    f = f.withColumns({"seen": s.isin("view", "click"), "hazard": (s == "error") & (v > 60), "failed": (s == "error") & (v < 5), "slow": v > 80, "stop": (s == "purchase") & (v < 10)})
    h = 3_600_000
    return S.machine_states(f, "seen", "hazard", "failed", "slow", "stop", hold_ms=20 * h, lost_ms=60 * h, told_ms=20 * h, watchdog_ms=40 * h).select("frame_id", "state")


@query(f"SELECT frame_id, avg(value) OVER w AS smooth_value, median(value) OVER w AS median_value FROM {_E} WINDOW w AS (PARTITION BY stream ORDER BY t, frame_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def smoothed_values(spark, sf_dir):
    return S.smoothed(frames(spark, sf_dir)).select("frame_id", "smooth_value", "median_value")


@query(f"""SELECT frame_id, stream, status FROM (SELECT *, (epoch_us(t) - epoch_us(lag(t) OVER (PARTITION BY stream, status ORDER BY t, frame_id))) / 1000.0 AS s FROM {_E}) WHERE s IS NULL OR s > 86400000 OR status IN ('obstacle', 'hazard', 'error')""")
def cooldown_feedback(spark, sf_dir):
    return S.cooled_down(frames(spark, sf_dir), 86_400_000).select("frame_id", "stream", "status")


@query(f"SELECT stream, frames, dropped, dropped / frames AS drop_rate FROM (SELECT stream, count(*) AS frames, count(*) FILTER (value > 50) AS dropped FROM {_E} GROUP BY stream)")
def dropped_frames(spark, sf_dir):
    return S.dropped_when_busy(frames(spark, sf_dir).withColumn("busy", F.col("value") > 50))


@query(f"SELECT stream, frame_id, before AS from_status, status AS to_status FROM (SELECT *, lag(status) OVER {_W} AS before FROM {_E}) WHERE before <> status")
def state_transitions(spark, sf_dir):
    return S.transitions(frames(spark, sf_dir))


@query(f"""WITH x AS (SELECT frame_id, status <> lag(status) OVER {_W} AS a, status <> lag(status) OVER (PARTITION BY stream ORDER BY date_trunc('day', t), frame_id DESC) AS e FROM {_E})
SELECT frame_id, CASE WHEN a THEN 'unexpected' ELSE 'missing' END AS fault FROM x WHERE coalesce(a, false) <> coalesce(e, false)""")
def replay_faults(spark, sf_dir):
    """Changes of status in order of time, against a log whose days were written backwards."""
    f = frames(spark, sf_dir)
    backwards = f.withColumns({"captured_at": F.date_trunc("day", "captured_at"), "frame_id": -F.col("frame_id")})
    return S.replayed(S.transitions(f), S.transitions(backwards).withColumn("frame_id", -F.col("frame_id")), ["frame_id"])


@query(f"SELECT frame_id, status FROM (SELECT *, row_number() OVER {_W} AS n FROM {_E}) WHERE n > 5")
def frames_after_warmup(spark, sf_dir):
    return S.after_warmup(frames(spark, sf_dir), 5).select("frame_id", "status")


#: All events as one stream, cut into slices of so many frames.
_ONE = _E.replace("user_id AS stream", "0 AS stream")
_SLICE = 4096


def one_stream(spark, sf_dir):
    return frames(spark, sf_dir).withColumn("stream", F.lit(0).cast("long"))


@query(f"""SELECT status, run, count(*) AS length FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY stream ORDER BY t, frame_id ROWS UNBOUNDED PRECEDING) AS bigint) AS run FROM (SELECT *, CASE WHEN status IS NOT DISTINCT FROM lag(status) OVER {_W} THEN 0 ELSE 1 END AS c FROM {_ONE})) GROUP BY status, run""")
def hot_state_runs(spark, sf_dir):
    return L.runs(one_stream(spark, sf_dir), _SLICE).select("status", "run", "length")


@query(f"""SELECT frame_id, CASE WHEN (epoch_us(t) - epoch_us(seen)) / 1000.0 <= 600000 THEN 'following' ELSE 'lostPath' END AS path_state FROM (SELECT *, max(CASE WHEN status = 'view' THEN t END) OVER (PARTITION BY stream ORDER BY t, frame_id ROWS UNBOUNDED PRECEDING) AS seen FROM {_ONE})""")
def hot_lost_path(spark, sf_dir):
    return L.lost_path(one_stream(spark, sf_dir), 600_000, slice_rows=_SLICE).select("frame_id", "path_state")


@query(f"SELECT frame_id, max(CASE WHEN status IN ('obstacle', 'hazard', 'error') THEN 1 ELSE 0 END) OVER {_W3} = 1 AS held FROM {_ONE}")
def hot_hazard_hold(spark, sf_dir):
    return L.over_slices(one_stream(spark, sf_dir), 2, lambda f: S.hazard_hold(f, 3, by=L.PART), _SLICE).select("frame_id", "held")


@query(f"""SELECT frame_id, quantile_cont(value, 0.95) OVER w AS p95, avg(value) OVER w AS smooth_value FROM {_ONE} WINDOW w AS (PARTITION BY stream ORDER BY t, frame_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def hot_rolling_values(spark, sf_dir):
    both = lambda f: S.smoothed(S.rolling_p95(f, 20, by=L.PART), 20, by=L.PART)
    return L.over_slices(one_stream(spark, sf_dir), 19, both, _SLICE).select("frame_id", "p95", "smooth_value")


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT frame_id, epoch_us(t) AS t FROM {_ONE}), a AS (SELECT min(t) AS t FROM e UNION ALL SELECT (SELECT min(e.t) FROM e WHERE e.t >= a.t + 43200000000) FROM a WHERE a.t IS NOT NULL)
SELECT frame_id, t NOT IN (SELECT t FROM a WHERE t IS NOT NULL) AS dropped FROM e""")
def hot_busy_drops(spark, sf_dir):
    """One stream, busy for twelve hours with each frame that it takes."""
    return L.accepted_when_free(one_stream(spark, sf_dir), 43_200_000, _SLICE).select("frame_id", "dropped")


@query(f"""WITH f AS (SELECT *, epoch_us(t) AS u, {_KIND} AS kind, CAST(floor(value) AS bigint) % 3 AS tracked, value > 90 AS halt FROM {_E}),
g AS (SELECT *, CAST(list_position(['drop', 'obstacle', 'lost_path', 'direction', 'object'], kind) AS integer) AS priority, min(CASE WHEN halt THEN frame_id END) OVER (PARTITION BY stream, u) AS first FROM f),
h AS (SELECT *, count(*) FILTER (halt AND first = frame_id) OVER (PARTITION BY stream ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS epoch, count(*) FILTER (NOT halt) OVER (PARTITION BY stream, u) AS flushed FROM g),
k AS (SELECT *, (u - lag(u) OVER (PARTITION BY stream, tracked, kind, epoch ORDER BY u, frame_id)) / 1000.0 AS since FROM h WHERE NOT halt)
SELECT frame_id, kind, priority, priority <= 2 AS cancels, 0::bigint AS flushed FROM (SELECT *, row_number() OVER (PARTITION BY stream, u ORDER BY priority, frame_id) AS n FROM k WHERE first IS NULL AND (priority <= 2 OR since IS NULL OR since > 864000000)) WHERE n = 1
UNION ALL SELECT frame_id, 'STOP', 0, true, flushed FROM h WHERE halt AND first = frame_id""")
def stop_feedback(spark, sf_dir):
    """Announcements with STOP, which flushes what waits and forgets what was said."""
    s = F.col("status")
    kind = F.when(s == "error", "drop").when(s == "purchase", "obstacle").when(s == "view", "lost_path").when(s == "signup", "direction").otherwise("object")
    f = frames(spark, sf_dir).withColumns({"kind": kind, "tracked": F.floor("value") % 3, "halt": F.col("value") > 90})
    return S.announced(f, "kind", "tracked", 864_000_000, stop="halt").select("frame_id", "kind", "priority", "cancels", "flushed")
