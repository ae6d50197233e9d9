"""Sinks: create once, replace, partitioned exports and reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.functions.expressions import counts_json
from oriel.functions.geometry import box_to_centre, normalised


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def create_once(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write; an existing target is an error."""
    w = df.write.mode("errorifexists")
    w.csv(path, header=True, escape='"') if kind == "csv" else getattr(w, kind)(path)


def replace(df: DataFrame, path: str, kind: str = "csv", sort: str | None = None) -> None:
    """Write beside the target and move into its place; a failed write leaves the target as it was."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows = df.repartitionByRange(sort).sortWithinPartitions(sort) if sort else df
    try:
        create_once(rows, staged, kind)
    except Exception:
        p, fs = _fs(spark, staged)
        fs.delete(p, True)
        raise
    target, fs = _fs(spark, path)
    old, _ = _fs(spark, f"{staged}.old")
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(_fs(spark, staged)[0], target):
        fs.rename(old, target)
        raise OSError(f"could not move a new version to {path}")
    fs.delete(old, True)


def commit_versions(tables: dict[str, DataFrame], root: str, pointer: str = "CURRENT") -> str:
    """Write several tables as one version and point to it last; on failure the version is deleted and the
    pointer stays. Returns the version."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{root}/{version}/{name}")
    except Exception:
        p, fs = _fs(spark, f"{root}/{version}")
        fs.delete(p, True)
        raise
    replace(spark.createDataFrame([(version,)], "version string").coalesce(1), f"{root}/{pointer}", "json")
    return version


def label_lines(boxes: DataFrame, polygons: DataFrame) -> DataFrame:
    """Training label lines with six decimals: ``class cx cy w h`` for boxes, ``class x y x y ...`` for polygons."""
    number = lambda c: F.format_string("%.6f", c)
    b = boxes.withColumn("c", box_to_centre("x1", "y1", "x2", "y2", "width", "height"))
    one = b.select(F.lit("object").alias("task"), "split", "sample_id", F.concat_ws(" ", F.col("class_id").cast("string"), number("c.cx"), number("c.cy"), number("c.w"), number("c.h")).alias("line"))
    pts = F.flatten(F.transform(normalised("points", "width", "height"), lambda q: F.array(number(q["x"]), number(q["y"]))))
    two = polygons.select(F.lit("tactile").alias("task"), "split", "sample_id", F.concat_ws(" ", F.col("class_id").cast("string"), F.concat_ws(" ", pts)).alias("line"))
    return one.unionByName(two)


def export_labels(lines: DataFrame, path: str) -> None:
    """Label lines by task and split; an existing export is an error. Rows are dealt by range of sample too, so that no
    task has to write a whole split."""
    lines.repartitionByRange("task", "split", "sample_id").sortWithinPartitions("task", "split", "sample_id", "line").write.mode("errorifexists").partitionBy("task", "split").parquet(path)


def yaml_text(labels: list[str]) -> str:
    """The dataset file of an export: folders of its splits and names by class id."""
    return "\n".join(["train: images/train", "val: images/val", "test: images/test", "names:", *(f"  {i}: {json.dumps(x)}" for i, x in enumerate(labels))]) + "\n"


def _write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    _write_bytes(spark, path, text.encode())


def export_dataset(lines: DataFrame, samples: DataFrame, path: str, labels: dict[str, list[str]], header: dict) -> None:
    """A training set: label lines by task and split, one dataset file for each task, and a manifest of the header (its
    version and the hashes of its inputs) and the samples, one JSON row each.

    All is written beside the target and moved into its place last; an existing target is an error, and a
    failed export leaves nothing.
    """
    spark = lines.sparkSession
    target, fs = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(f"export already exists: {path}")
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    p, _ = _fs(spark, staged)
    try:
        export_labels(lines, f"{staged}/labels")
        samples.write.mode("errorifexists").json(f"{staged}/samples")
        for task, names in labels.items():
            _write_text(spark, f"{staged}/{task}.yaml", yaml_text(names))
        _write_text(spark, f"{staged}/export_manifest.json", json.dumps(header, indent=2, sort_keys=True))
        if not fs.rename(p, target):
            raise OSError(f"could not move an export to {path}")
    except Exception:
        fs.delete(p, True)
        raise


def export_mixture(plan: DataFrame, path: str, header: dict, label: str) -> None:
    """A mixture plan by split, its dataset file, and a manifest with the number of rows of each split and source."""
    counts = {f"{r['split']}_{r['source']}": r["n"] for r in plan.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    lines = plan.select(F.lit("mixture").alias("task"), "split", F.col("target_name").alias("sample_id"), F.col("source").alias("line"))
    export_dataset(lines, plan, path, {"mixture": [label]}, header | {"summary": counts})


def report_rows(df: DataFrame, map_columns: list[str]) -> DataFrame:
    """Maps as JSON text with keys in order, so that a report fits in flat columns."""
    return df.withColumns({c: counts_json(c) for c in map_columns})
