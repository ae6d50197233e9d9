"""Joins of manifests: one to one, set reconciliation, defaults, roles, protected content, stale bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strict_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key with its number of rows on either side and a verdict: ``matched``, ``duplicate``,
    ``unmatched_left`` or ``unmatched_right``. One shuffle; each side is counted before it."""
    both = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("side")).unionByName(right.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.lit(2).alias("side")))
    n = both.groupBy(key).agg(F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("n_left"), F.sum(F.when(F.col("side") == 2, F.col("n")).otherwise(0)).alias("n_right"))
    verdict = F.when((F.col("n_left") > 1) | (F.col("n_right") > 1), "duplicate").when(F.col("n_right") == 0, "unmatched_left").when(F.col("n_left") == 0, "unmatched_right").otherwise("matched")
    return n.withColumn("verdict", verdict)


def reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys that one side lacks, as (key, side): ``missing`` from actual or ``extra`` in it."""
    sides = expected.select(key).distinct().withColumn("e", F.lit(1)).join(actual.select(key).distinct().withColumn("a", F.lit(1)), key, "full_outer")
    return sides.filter("e IS NULL OR a IS NULL").select(key, F.when(F.col("a").isNull(), "missing").otherwise("extra").alias("side"))


def left_default(left: DataFrame, right: DataFrame, key: str, column: str, default: str) -> DataFrame:
    return left.join(right.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def without_protected(rows: DataFrame, protected: DataFrame, key: str) -> DataFrame:
    """Rows whose content hash isn't protected. Spark broadcasts the protected side only if it is small."""
    return rows.join(protected.select(key).distinct(), key, "left_anti")


def paired_roles(rows: DataFrame, key: str, role: str, value: str, roles: list[str]) -> DataFrame:
    """One row per key with a column for each role's value, a count for each, and a status:
    ``duplicate`` if a role occurs twice, ``unpaired`` if one is missing, else ``paired``."""
    counts = [F.count_if(F.col(role) == r).alias(f"n_{r}") for r in roles]
    values = [F.max(F.when(F.col(role) == r, F.col(value))).alias(r) for r in roles]
    out = rows.groupBy(key).agg(*values, *counts)
    over = F.greatest(*(F.col(f"n_{r}") for r in roles)) > 1
    lacks = F.least(*(F.col(f"n_{r}") for r in roles)) == 0
    return out.withColumn("status", F.when(over, "duplicate").when(lacks, "unpaired").otherwise("paired"))


def merge_conflicts(inputs: list[DataFrame], key: str) -> DataFrame:
    """Keys that stand in more than one input or twice in one, with their number."""
    both = inputs[0].select(key)
    for other in inputs[1:]:
        both = both.unionByName(other.select(key))
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def binding_status(rows: DataFrame, reviews: DataFrame, key: str, hashes: list[str]) -> DataFrame:
    """Each row's review status: ``unreviewed`` without a review, ``stale`` if any hash differs, else ``current``."""
    r = reviews.select(key, *(F.col(h).alias(f"_{h}") for h in hashes), F.lit(1).alias("_reviewed"))
    same = F.lit(True)
    for h in hashes:
        same = same & F.coalesce(F.col(h) == F.col(f"_{h}"), F.lit(False))
    out = rows.join(r, key, "left")
    return out.withColumn("binding", F.when(F.col("_reviewed").isNull(), "unreviewed").when(same, "current").otherwise("stale")).drop("_reviewed", *(f"_{h}" for h in hashes))


def zipped(a: str, b: str):
    """Arrays zipped by place; an error if they differ in length."""
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a, b)).otherwise(F.raise_error(F.lit("arrays differ in length")))


def missing_members(rows: DataFrame, by: list[str], value: str, required: list[str]) -> DataFrame:
    """For each group which of the ``required`` values none of its rows has: ``by``, missing (sorted), complete. Only required values are
    gathered, so a group holds no more than there are of them."""
    wanted = F.array(*(F.lit(v) for v in required))
    have = F.collect_set(F.when(F.col(value).isin(*required), F.col(value)))
    out = rows.groupBy(*by).agg(F.array_sort(F.array_except(wanted, have)).alias("missing"))
    return out.withColumn("complete", F.size("missing") == 0)
