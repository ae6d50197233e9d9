"""Tables behind a log of commits: a version is a file that is put in place only if its name is free.

Below a table's root, ``data`` holds folders that never change once written, and ``log`` a file for each version: which folder
holds each bucket of the key, and the schema. Readers take the last version, so while a writer commits they see the one before,
and never no table. Of two writers that start from one version, one gets its name and the other an error.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oriel.operators.review import upsert as merged
from oriel.plans.tables import delete_path

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has committed since the version that a change was made for."""


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all versions, in order."""
    p, fs = _place(spark, f"{root}/log")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith("."))


def _put(spark: SparkSession, path: str, text: str) -> bool:
    """Put a whole file in place if its name is free; False if it isn't.

    It is written beside its place first. A hard link (local files) or a rename that overwrites nothing (HDFS) then decides
    between writers. Object stores without such a rename need a lock of their own.
    """
    final, fs = _place(spark, path)
    beside, _ = _place(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.getScheme() != "file":
        done = not fs.exists(final) and fs.rename(beside, final)
        if not done:
            fs.delete(beside, False)
        return done
    files, path_of = spark._jvm.java.nio.file.Files, lambda p: spark._jvm.java.nio.file.Paths.get(p.toUri())
    full = lambda p: fs.makeQualified(p)
    try:
        files.createLink(path_of(full(final)), path_of(full(beside)))
        return True
    except Exception as x:  # noqa: BLE001
        if "FileAlreadyExists" in str(x):
            return False
        raise
    finally:
        fs.delete(beside, False)


def _state(spark: SparkSession, root: str, version: int) -> dict:
    if version == 0:
        return {"buckets": {}, "schema": None, "n": BUCKETS, "key": None}
    return json.loads("".join(r["value"] for r in spark.read.text(f"{root}/log/{version:010d}.json", wholetext=True).collect()))


def _bucket(key: str, n: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")


def _commit(df: DataFrame, root: str, state: dict, version: int, touched: list[int] | None) -> int:
    """Write rows as a new folder and commit them as the contents of the ``touched`` buckets, or of the whole table."""
    spark, folder = df.sparkSession, f"data/{uuid.uuid4().hex}"
    try:
        df.withColumn("_bucket", _bucket(state["key"], state["n"])).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{root}/{folder}")
        p, fs = _place(spark, f"{root}/{folder}")
        new = {f.getPath().getName().split("=")[1]: f"{folder}/{f.getPath().getName()}" for f in fs.listStatus(p) if "=" in f.getPath().getName()}
        kept = {} if touched is None else {b: path for b, path in state["buckets"].items() if int(b) not in touched}
        log = state | {"buckets": kept | new, "schema": df.schema.jsonValue()}
        if not _put(spark, f"{root}/log/{version + 1:010d}.json", json.dumps(log)):
            raise Conflict(f"version {version + 1} of {root} was committed by another writer")
    except Exception:
        delete_path(spark, f"{root}/{folder}")
        raise
    return version + 1


def write_table(df: DataFrame, root: str, key: str, buckets: int = BUCKETS, expected: int | None = None) -> int:
    """Commit ``df`` as the whole table; gives the new version. ``expected``: the version it was made from (the last one, if not
    given); if others have come since, it is a ``Conflict``."""
    last = max(versions(df.sparkSession, root), default=0) if expected is None else expected
    return _commit(df, root, {"buckets": {}, "schema": None, "n": buckets, "key": key}, last, None)


def read_table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of the table, the last one if not given."""
    number = version or max(versions(spark, root), default=0)
    if number == 0:
        raise FileNotFoundError(f"{root} has no version")
    return _read(spark, root, _state(spark, root, number), None)


def _read(spark: SparkSession, root: str, state: dict, only: list[int] | None) -> DataFrame:
    schema = T.StructType.fromJson(state["schema"])
    paths = [f"{root}/{p}" for b, p in state["buckets"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_table(changes: DataFrame, root: str, order: str | None = None, expected: int | None = None) -> int:
    """Commit the table with ``changes`` in place of rows of the same key, as ``review.upsert``; only the buckets that hold
    changed keys are read and written anew."""
    spark = changes.sparkSession
    last = max(versions(spark, root), default=0) if expected is None else expected
    state = _state(spark, root, last)
    if state["schema"] is None:
        raise FileNotFoundError(f"{root} has no version")
    touched = sorted(r[0] for r in changes.select(_bucket(state["key"], state["n"])).distinct().collect())
    if not touched:
        return last
    rows = merged(_read(spark, root, state, touched), changes, state["key"], order)
    return _commit(rows, root, state, last, touched)
