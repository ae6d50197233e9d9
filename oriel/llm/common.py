"""What several text operators share: the shared folder, written tables and hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.plans.tables import drop_folders, drop_table, folder_mark, shared_dir, shared_path, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores in front until no column of ``taken`` is called so in any case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns that tell every row apart, however often it is read, and their names.

    Rows of a plain file scan are known by their file and place in it; anything else is numbered and written first.
    """
    a, b = free_name(docs.columns, "_row_file"), free_name(docs.columns, "_row_place")
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in docs.columns:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias(a), F.col("_metadata.row_index").alias(b)), a, b
    return written(docs.select("*", F.lit(0).cast("long").alias(a), F.monotonically_increasing_id().alias(b)), "numbered"), a, b


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """Join with ``keys``, unique in ``on``; keys with over a thousandth of their summed ``count``
    are at most 1,000 and are broadcast, the others meet their rows by key. ``how`` is inner or left."""
    total = keys.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    bound = max(2000.0, total / 1000)
    hot = keys.filter(F.col(count) > bound)
    a = rows.join(F.broadcast(hot), on)
    b = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keys.filter(F.col(count) <= bound), on, how)
    return a.unionByName(b)


def text_bytes(text) -> bytes:
    """UTF-8 of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values; works on uint64 arrays."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
