"""Readers and sinks over small files, and streams against their batch forms."""

import json
import time

import pytest
from pyspark.sql import functions as F

from oriel.operators.validate import require_columns
from oriel.sources import readers as I
from oriel.sources import schemas as C
from oriel.sources import sinks as K
from oriel.streaming import frames as S


def test_intake(spark, tmp_path):
    p = tmp_path / "m.csv"
    head = ",".join(C.INTAKE_COLUMNS)
    p.write_text("﻿" + head + '\n' + ",".join(['" a ""b"" "'] + ["x"] * 12) + "\n", encoding="utf-8")
    assert I.read_intake(spark, str(p)).first()["source_path"] == 'a "b"'
    p.write_text("source_path\nx\n")
    with pytest.raises(ValueError, match="missing columns"):
        I.read_intake(spark, str(p))


def test_reviews_missing_or_twice(spark, tmp_path):
    assert I.read_reviews(spark, str(tmp_path / "none.csv")).count() == 0
    p = tmp_path / "r.csv"
    p.write_text(",".join(C.REVIEW_COLUMNS) + "\n" + "a,,,,,,\na,,,,,,\n")
    with pytest.raises(Exception, match="duplicate key"):
        I.read_reviews(spark, str(p))
    p.write_text(",".join(C.REVIEW_COLUMNS) + "\na,,,,,,\nb,,,,,,\n")
    assert I.read_reviews(spark, str(p)).count() == 2


def test_legacy_truth(spark, tmp_path):
    p = tmp_path / "t.csv"
    # The header as older files have it, typed out.
    p.write_text("sample_id,source_path,dataset_role,prediction_tactile_present,prediction_mask_coverage,ground_truth_tactile_present,ground_truth_mask_path,review_status,notes\n" + ",".join([" a "] + ["x"] * 8) + "\n")
    r = I.read_truth(spark, str(p)).first()
    assert r["sample_id"] == " a " and r["annotation_id"] == r["reviewer"] == "" and r["dataset_role"] == "x" and len(r) == 15
    p.write_text("sample_id,source_path,source_sha256,dataset_role,prediction_tactile_present,prediction_mask_coverage,ground_truth_tactile_present,ground_truth_mask_path,ground_truth_mask_sha256,annotation_origin,annotation_id,review_status,reviewer,reviewed_at,notes\n" + ",".join(str(i) for i in range(15)) + "\n")
    assert list(I.read_truth(spark, str(p)).first()) == [str(i) for i in range(15)]


def test_polygon_lines(spark):
    lines = ["0 0 0 1 0 1 1", "1 0 0 1 0 1 1", "0 0 0 1 0 1", "0 0 0 1 0", "0 0 0 2 0 1 1", "0 0 0 .5 0 1 0", "", "0 0 0 x 0 1 1"]
    got = I.parse_polygon_lines(spark.createDataFrame([(x,) for x in lines], "value string")).select("value", "error").collect()
    assert [r["error"] for r in got] == [None, "wrong_class", "too_few_values", "too_few_values", "bad_coordinate", "no_area", "bad_coordinate"]


def test_documents(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"manifest_version": 1, "dataset_version": "v", "split_seed": 1, "samples": [{"sample_id": "a", "split": "train"}]}, indent=1))
    header, samples = I.read_manifest(spark, str(p))
    assert header.first()["dataset_version"] == "v" and samples.first()["sample_id"] == "a"
    (tmp_path / "s.json").write_text(json.dumps({"imagePath": "i", "shapes": [{"label": "t", "points": [[0, 0], [1, 0], [1, 1]]}]}))
    assert I.read_shapes(spark, str(tmp_path / "s.json")).first()["shape_type"] == "polygon"
    with pytest.raises(Exception, match="required"):
        I.read_shapes(spark, str(tmp_path / "s.json"), strict=True).collect()


def test_files_and_inventory(spark, tmp_path):
    for n in ("b.JPG", "a.png", "c.txt"):
        (tmp_path / n).write_bytes(n.encode())
    assert [r["stem"] for r in I.list_files(spark, str(tmp_path)).orderBy("sort_name").collect()] == ["a", "b"]
    assert I.file_hashes(spark, str(tmp_path)).count() == 3
    rows = spark.createDataFrame([("x", "CC0", "u"), ("x", "cc0", "v"), ("y", "other", "w")], "title string, licence string, url string")
    assert I.filtered_inventory(rows, ["cc0"], 1).count() == 1
    with pytest.raises(Exception, match="fewer than 2"):
        I.filtered_inventory(rows, ["cc0"], 2).collect()
    assert I.retry_delays() == [0.5, 1.0, 2.0, 4.0] and not I.may_retry(404) and I.may_retry(429) and I.may_retry(503)
    assert I.without_words(spark.createDataFrame([("A Map",), ("photo",), (None,)], "t string"), "t", ["map"]).count() == 2
    with pytest.raises(ValueError):
        require_columns(rows, ["nope"])


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("b", 1), ("a", 2)], "k string, n int")
    K.create_once(d, str(tmp_path / "x"))
    with pytest.raises(Exception):
        K.create_once(d, str(tmp_path / "x"))
    K.replace(d.filter("n = 1"), str(tmp_path / "x"), sort="k")
    assert spark.read.csv(str(tmp_path / "x"), header=True).count() == 1
    version = K.commit_versions({"t": d}, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v" / version / "t")).count() == 2
    boxes = spark.createDataFrame([("train", "s", 0, 0, 0, 50, 50, 100, 100)], "split string, sample_id string, class_id int, x1 int, y1 int, x2 int, y2 int, width int, height int")
    pts = spark.createDataFrame([("train", "s", 1, 10, 10)], "split string, sample_id string, class_id int, width int, height int").withColumn("points", F.expr("array(named_struct('x', 0D, 'y', 5D))"))
    lines = K.label_lines(boxes, pts)
    assert {r["line"] for r in lines.collect()} == {"0 0.250000 0.250000 0.500000 0.500000", "1 0.000000 0.500000"}
    K.export_labels(lines, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2
    assert K.report_rows(spark.range(1).select(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)).alias("m")), ["m"]).first()["m"] == '{"a":2,"b":1}'


def test_stream_totals_match_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "in")
    events.repartition(3).write.parquet(src)
    stream = S.event_frames(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src))
    q = S.status_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = {r["status"]: r["frames"] for r in spark.table("totals").collect()}
    assert got == {r["status"]: r["frames"] for r in S.status_totals(S.event_frames(events)).collect()}


def test_stable_stream_matches_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("user_id < 5")
    src = str(tmp_path / "in")
    events.coalesce(1).write.parquet(src)
    out = S.stable_stream(S.event_frames(spark.readStream.schema(events.schema).parquet(src)))
    q = out.writeStream.outputMode("append").format("memory").queryName("stable").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = {(r["frame_id"], r["stable_status"]) for r in spark.table("stable").collect()}
    f = S.runs(S.event_frames(events))
    want = f.filter(f"length >= 3 OR status IN {S.CRITICAL}").count() + f.filter(f"length >= 3 AND status IN {S.CRITICAL}").count()
    assert len(got) == want


def test_watchdog_stream_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("user_id < 3")
    src = str(tmp_path / "in")
    events.coalesce(1).write.parquet(src)
    want = {r["user_id"]: r["count"] for r in events.groupBy("user_id").count().collect()}
    out = S.watchdog_stream(S.event_frames(spark.readStream.schema(events.schema).parquet(src)), 500)
    # A processing-time timeout asks for batches for ever, so the test has a deadline and stops the query.
    q = out.writeStream.outputMode("update").format("memory").queryName("dog").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        rows, until = [], time.time() + 60
        while time.time() < until and sum(r["state"] == "failure" for r in rows) < len(want):
            time.sleep(0.3)
            rows = spark.table("dog").collect()
    finally:
        q.stop()
    assert {r["stream"]: r["frames"] for r in rows if r["state"] == "fresh"} == want
    assert sorted((r["stream"], r["frames"]) for r in rows if r["state"] == "failure") == sorted(want.items())
