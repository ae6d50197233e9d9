"""Review states bound to content: seeding, importing, marking and upserting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oriel.functions.expressions import is_blank, is_zoned_timestamp
from oriel.operators.validate import require

# States of a ground-truth row.
UNREVIEWED, PROVISIONAL, HUMAN_REVIEWED, AMBIGUOUS = "unreviewed", "provisional", "human_reviewed", "ambiguous"
STATES = (UNREVIEWED, PROVISIONAL, HUMAN_REVIEWED, AMBIGUOUS)


def review_errors(status: str = "review_status", reviewer: str = "reviewer", reviewed_at: str = "reviewed_at", notes: str = "notes") -> list[tuple[str, Column]]:
    """Rules on a review: reviewed by a human needs a name and a zoned time, provisional must have neither, ambiguous needs notes."""
    s = F.col(status)
    return [
        ("unknown_status", ~F.coalesce(s.isin(*STATES), F.lit(False))),
        ("reviewer_required", (s == HUMAN_REVIEWED) & is_blank(reviewer)),
        ("zoned_time_required", (s == HUMAN_REVIEWED) & ~is_zoned_timestamp(reviewed_at)),
        ("provisional_has_reviewer", (s == PROVISIONAL) & (~is_blank(reviewer) | ~is_blank(reviewed_at))),
        ("notes_required", (s == AMBIGUOUS) & is_blank(notes)),
    ]


def seeded(predictions: DataFrame, truth_columns: list[str]) -> DataFrame:
    """A manifest from predictions: truth is blank, nothing is reviewed."""
    return predictions.withColumns({c: F.lit("") for c in truth_columns} | {"review_status": F.lit(UNREVIEWED), "reviewer": F.lit(""), "reviewed_at": F.lit(""), "notes": F.lit("")})


def imported(manifest: DataFrame, annotations: DataFrame, key: str, column: str, overwrite: bool = False) -> DataFrame:
    """Rows with an annotation become provisional with its value; ones that had been imported stay unless ``overwrite``."""
    a = annotations.select(key, F.col(column).alias("_new"))
    out = manifest.join(a, key, "left")
    take = F.col("_new").isNotNull() & (F.lit(overwrite) | (F.col("review_status") == UNREVIEWED))
    return out.withColumns({column: F.when(take, F.col("_new")).otherwise(F.col(column)), "review_status": F.when(take, PROVISIONAL).otherwise(F.col("review_status")), "reviewer": F.when(take, "").otherwise(F.col("reviewer")), "reviewed_at": F.when(take, "").otherwise(F.col("reviewed_at"))}).drop("_new")


def _only_provisional(marked: Column) -> Column:
    wrong = F.concat(F.lit("only provisional rows can be marked, not "), F.coalesce("review_status", F.lit("null")))
    return F.when(~marked, F.lit(False)).when(F.col("review_status") == PROVISIONAL, F.lit(True)).otherwise(F.raise_error(wrong).cast("boolean"))


def mark_human_reviewed(manifest: DataFrame, keys: DataFrame, key: str, reviewer: str, at: str) -> DataFrame:
    """Provisional rows among ``keys`` become reviewed by ``reviewer`` at ``at``; an error for rows of other states, for
    keys that the manifest lacks, and if any row of the table breaks a rule of ``review_errors`` before."""
    if not reviewer.strip():
        raise ValueError("a reviewer is required")
    broken = F.lit(False)
    for _, c in review_errors():
        broken = broken | F.coalesce(c, F.lit(False))
    valid = require(manifest, ~broken, "the manifest isn't valid")
    wanted = keys.select(key).distinct()
    unknown = wanted.join(manifest.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("_unknown"))
    out = valid.join(wanted.withColumn("_mark", F.lit(True)), key, "left").withColumn("_mark", _only_provisional(F.coalesce("_mark", F.lit(False))))
    out = require(out.join(F.broadcast(unknown), how="inner"), F.col("_unknown") == 0, "unknown keys").drop("_unknown")
    m = F.col("_mark")
    return out.withColumns({"review_status": F.when(m, HUMAN_REVIEWED).otherwise(F.col("review_status")), "reviewer": F.when(m, reviewer).otherwise(F.col("reviewer")), "reviewed_at": F.when(m, at).otherwise(F.col("reviewed_at"))}).drop("_mark")


def mark_ambiguous(manifest: DataFrame, keys: DataFrame, key: str, reason: str) -> DataFrame:
    """Provisional rows among ``keys`` become ambiguous with a reason and without a reviewer."""
    if not reason.strip():
        raise ValueError("a reason is required")
    out = manifest.join(keys.select(key).distinct().withColumn("_mark", F.lit(True)), key, "left").withColumn("_mark", _only_provisional(F.coalesce("_mark", F.lit(False))))
    m = F.col("_mark")
    return out.withColumns({"review_status": F.when(m, AMBIGUOUS).otherwise(F.col("review_status")), "notes": F.when(m, reason).otherwise(F.col("notes")), "reviewer": F.when(m, "").otherwise(F.col("reviewer")), "reviewed_at": F.when(m, "").otherwise(F.col("reviewed_at"))}).drop("_mark")


def upsert(reviews: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``reviews`` with rows of ``changes`` in place of those of the same key, and new ones added. Of several
    changes of a key the one of the highest ``order`` wins; without ``order`` repeated changes are an error."""
    if order is None:
        n = F.count(F.lit(1)).over(Window.partitionBy(key))
        latest = require(changes.withColumn("_n", n), F.col("_n") == 1, "a key is changed twice").drop("_n")
    else:
        latest = changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), F.struct(order, *(c for c in changes.columns if c != order))).alias("_c")).select("_c.*")
    return reviews.join(latest.select(key), key, "left_anti").unionByName(latest.select(*reviews.columns))


def bound_changes(changes: DataFrame, samples: DataFrame, key: str, hashes: list[str]) -> DataFrame:
    """``changes`` with the hashes of the ``samples`` that they are about; an error for a key without a sample or
    without a hash, as a review counts only for the content that was seen."""
    out = changes.drop(*hashes).join(samples.select(key, *hashes), key, "left")
    known = F.lit(True)
    for h in hashes:
        known = known & ~is_blank(h)
    return require(out, known, "a review needs a known sample with its hashes").select(*changes.columns)


def exit_code(invalid: str, ready: str) -> Column:
    """1 if a row is invalid, 2 if the table isn't ready, else 0."""
    return F.when(F.col(invalid) > 0, 1).when(~F.coalesce(ready, F.lit(False)), 2).otherwise(0)
