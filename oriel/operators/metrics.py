"""Confusion counts, overlap, thresholds, percentiles and grouped counts."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oriel.functions.expressions import col, safe_ratio


def confusion(truth: str | Column, prediction: str | Column) -> list[Column]:
    """tp, fp, fn and tn. Rows with an unknown side count nowhere, so a failed prediction is no negative."""
    t, p = col(truth), col(prediction)
    return [F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")]


def _guarded(df: DataFrame) -> DataFrame:
    """The one row of counts, or an error if it counts nothing."""
    some = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") > 0
    return df.filter(F.when(some, F.lit(True)).otherwise(F.raise_error(F.lit("no evaluated rows")).cast("boolean")))


def presence_metrics(df: DataFrame, truth: str | Column, prediction: str | Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall and f1. Ratios are null where nothing is counted below;
    f1 is 0 where precision and recall are both 0, and null where either is null."""
    out = df.groupBy(*(by or [])).agg(*confusion(truth, prediction))
    out = _guarded(out) if not by else out
    out = out.withColumn("accuracy", safe_ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))
    out = out.withColumn("precision", safe_ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", safe_ratio("tp", F.col("tp") + F.col("fn")))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when((p + r) > 0, 2 * p * r / (p + r)).when((p == 0) & (r == 0), F.lit(0.0)))


def presence_with_fpr(df: DataFrame, truth: str | Column, prediction: str | Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and false_positive_rate."""
    out = df.groupBy(*(by or [])).agg(*confusion(truth, prediction))
    out = _guarded(out) if not by else out
    return (
        out.withColumn("precision", safe_ratio("tp", F.col("tp") + F.col("fp")))
        .withColumn("recall", safe_ratio("tp", F.col("tp") + F.col("fn")))
        .withColumn("false_positive_rate", safe_ratio("fp", F.col("fp") + F.col("tn")))
    )


def outcome(truth: str | Column, prediction: str | Column) -> Column:
    t, p = col(truth), col(prediction)
    return F.when(t & p, "TP").when(~t & p, "FP").when(t & ~p, "FN").when(~t & ~p, "TN")


def mean_iou(truth: str | Column, iou: str | Column) -> Column:
    """Mean over rows that are positive by ground truth; null if there are none."""
    return F.avg(F.when(col(truth), col(iou)))


def threshold_reports(predictions: DataFrame, thresholds: list[float], truth: str, score: str, iou: str) -> DataFrame:
    """One report per threshold from one scan: rows are summed up by how many of the thresholds they reach, and the few sums are
    added up along the thresholds."""
    order = sorted({float(t) for t in thresholds})
    reached = reduce(add, (F.when(F.col(score) >= t, 1).otherwise(0) for t in order))
    level = F.when(F.col(score).isNotNull(), reached)
    t = F.col(truth)
    sums = predictions.groupBy(level.alias("_level")).agg(
        F.count_if(t).alias("_yes"), F.count_if(~t).alias("_no"), F.sum(F.when(t, F.col(iou))).alias("_iou"), F.count_if(t & F.col(iou).isNotNull()).alias("_known"),
    )
    each = sums.withColumn("threshold", F.explode(F.array(*(F.struct(F.lit(v).alias("t"), F.lit(k + 1).alias("k")) for k, v in enumerate(order))))).select("*", "threshold.k", F.col("threshold.t").alias("_t"))
    hit, miss = F.col("_level") >= F.col("k"), F.coalesce(F.col("_level") < F.col("k"), F.lit(False))
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    # A row that isn't hit has an overlap of 0, also if its score isn't known.
    below = F.coalesce(~hit, F.lit(True))
    out = each.groupBy(F.col("_t").alias("threshold")).agg(
        total("_yes", hit).alias("tp"), total("_no", hit).alias("fp"), total("_yes", miss).alias("fn"), total("_no", miss).alias("tn"),
        safe_ratio(F.sum(F.when(hit, F.coalesce("_iou", F.lit(0.0))).otherwise(0.0)), total("_known", hit) + total("_yes", below)).alias("mean_iou"),
    )
    return (
        out.withColumn("precision", safe_ratio("tp", F.col("tp") + F.col("fp")))
        .withColumn("recall", safe_ratio("tp", F.col("tp") + F.col("fn")))
        .withColumn("false_positive_rate", safe_ratio("fp", F.col("fp") + F.col("tn")))
    )


def percentiles(value: str | Column, names: dict[str, float]) -> list[Column]:
    """Exact percentiles with linear interpolation between neighbours."""
    return [F.percentile(col(value), F.lit(p)).alias(n) for n, p in names.items()]


#: Parts of equal width into which the values of a group are counted to find where a rank lies.
BINS = 4096
#: Up to so many rows the engine's own percentiles are taken, which keep the distinct values of a group in one task.
FEW_ROWS = 1 << 20


def exact_percentiles(df: DataFrame, by: list[str], value: str, names: dict[str, float], bins: int = BINS) -> DataFrame:
    """One row for each group: ``by`` and the exact percentiles, interpolated as ``percentile`` does; null where no value is known.

    No task holds the values of a group: they are counted by parts of their range, counts tell in which part a rank lies, and
    only that part is sorted, by its distinct values and their counts. Two aggregations that are summed up before they are
    shuffled, whatever the number of percentiles. Values must be finite. Tables of at most ``FEW_ROWS`` rows, which are counted
    first, take the engine's own percentiles instead, with the same results.
    """
    if df.count() <= FEW_ROWS:
        return df.groupBy(*by).agg(*percentiles(F.col(value).cast("double"), names))
    x = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    if not by:
        x, by = x.withColumn("_all", F.lit(0)), ["_all"]
    alike = lambda a, b, keys: reduce(and_, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))
    span = x.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    # Subtraction, product and floor never turn an order round, so bins are ranges.
    bin_ = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("_v") - F.col("_low")) * (F.lit(float(bins)) / (F.col("_high") - F.col("_low"))))).otherwise(F.lit(0))
    binned = x.alias("x").join(span.alias("s"), alike("x", "s", by)).select("x.*", bin_.alias("_bin"))
    counts = binned.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    counts = counts.withColumn("_before", F.sum("_n").over(group.orderBy("_bin")) - F.col("_n")).withColumn("_all_n", F.sum("_n").over(group))
    position = [(n, F.lit(float(p)) * (F.col("_all_n") - 1)) for n, p in names.items()]
    ranks = F.array(*(F.struct(F.lit(n).alias("name"), at.alias("at"), F.lit(side).alias("side"), (F.floor(at) if side == 0 else F.ceil(at)).alias("r")) for n, at in position for side in (0, 1)))
    asked = counts.select(*by, "_bin", "_n", "_before", F.inline(ranks)).filter("r >= _before AND r < _before + _n")
    parts = asked.select(*by, "_bin").distinct()
    keys = [*by, "_bin"]
    inside = binned.alias("x").join(parts.alias("p"), alike("x", "p", keys)).select("x.*").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_m"))
    inside = inside.withColumn("_upto", F.sum("_m").over(Window.partitionBy(*keys).orderBy("_v")))
    r = F.col("a.r") - F.col("a._before")
    met = asked.alias("a").join(inside.alias("v"), alike("a", "v", keys)).filter((r >= F.col("v._upto") - F.col("v._m")) & (r < F.col("v._upto")))
    met = met.select(*(F.col(f"a.{k}").alias(k) for k in by), "a.name", "a.at", "a.side", "v._v")
    low, high, at = (F.max(F.when(F.col("side") == s, F.col(c))) for s, c in ((0, "_v"), (1, "_v"), (0, "at")))
    each = met.groupBy(*by, "name").agg(low.alias("low"), high.alias("high"), at.alias("at"))
    between = (F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high")
    each = each.withColumn("p", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between))
    found = each.groupBy(*by).agg(*(F.max(F.when(F.col("name") == n, F.col("p"))).alias(n) for n in names))
    if by == ["_all"]:
        return df.sparkSession.range(1).select(F.lit(0).alias("_all")).join(found, "_all", "left").drop("_all")
    groups = df.select(*by).distinct()
    return groups.alias("g").join(found.alias("f"), alike("g", "f", by), "left").select("g.*", *(f"f.{n}" for n in names))


def timing_summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, p50, p95, max and the rate per second of milliseconds; an error without any row."""
    x = F.col(value)
    out = df.groupBy(*(by or [])).agg(F.count(x).alias("n"), F.avg(x).alias("mean_ms"), F.max(x).alias("max_ms"))
    ranks = exact_percentiles(df, by or [], value, {"p50_ms": 0.5, "p95_ms": 0.95})
    if by:
        out = out.alias("o").join(ranks.alias("r"), reduce(and_, (F.col(f"o.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by))).select("o.*", "r.p50_ms", "r.p95_ms")
    else:
        out = out.join(F.broadcast(ranks), how="inner")  # one row each
        out = out.filter(F.when(F.col("n") > 0, F.lit(True)).otherwise(F.raise_error(F.lit("no timings")).cast("boolean")))
    return out.select(*(by or []), "n", "mean_ms", "p50_ms", "p95_ms", "max_ms", safe_ratio(F.lit(1000.0), "mean_ms").alias("rate"))


def max_or(value: str | Column, default: float = 0.0) -> Column:
    return F.coalesce(F.max(col(value)), F.lit(default))


def value_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def independent_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by value of several columns at once, as (field, value, rows); each row is expanded in its
    task and summed there before the shuffle."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.inline(pairs)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("rows"))


def map_totals(df: DataFrame, counts: str) -> DataFrame:
    """Sums of a map column's counts by key."""
    return df.select(F.explode(counts).alias("class", "n")).groupBy("class").agg(F.sum("n").alias("rows"))


def any_failed(failed: str | Column) -> Column:
    """Exit code of a batch: 1 if any row failed or isn't known not to have, else 0."""
    return F.when(F.coalesce(F.bool_or(F.coalesce(col(failed), F.lit(True))), F.lit(True)), 1).otherwise(0)
