"""Row validation: all errors, the first error, waterfalls of reasons, gates and assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oriel.functions.expressions import col, is_blank

Rule = tuple[str, Column]


def all_errors(rules: list[Rule]) -> Column:
    """Names of all rules whose condition holds, in order. A null condition doesn't hold."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules)), lambda x: x.isNotNull())


def first_error(rules: list[Rule]) -> Column:
    """Name of the first rule whose condition holds; later conditions aren't evaluated then."""
    out = None
    for name, c in rules:
        out = F.when(c, name) if out is None else out.when(c, name)
    return out if out is not None else F.lit(None).cast("string")


def missing_fields(fields: list[str]) -> Column:
    return all_errors([(f, is_blank(f)) for f in fields])


def allowed(lists: dict[str, list[str]]) -> Column:
    """Whether each column holds one of its listed values; null is none of them."""
    out = F.lit(True)
    for c, values in lists.items():
        out = out & F.coalesce(F.col(c).isin(*values), F.lit(False))
    return out


def pinned(rows: DataFrame, pins: DataFrame, key: str, size: str, digest: str) -> DataFrame:
    """``rows`` with ``pin``: ``missing`` without a pin, ``size`` or ``hash`` where it differs, else ``ok``. Pins have the
    same columns, one row for each key; a cached file is used only if its pin is ``ok``."""
    p = pins.select(key, F.col(size).alias("_size"), F.col(digest).alias("_digest"))
    rules = [("missing", F.col("_size").isNull()), ("size", F.col("_size") != F.col(size)), ("hash", F.lower("_digest") != F.lower(digest))]
    return rows.join(p, key, "left").withColumn("pin", F.coalesce(first_error(rules), F.lit("ok"))).drop("_size", "_digest")


def labels_equal(actual: str | Column, expected: str | Column) -> Column:
    """Whether two maps of class ids to names are the same, whatever the type of the ids and their order."""
    plain = lambda c: F.array_sort(F.transform(F.map_entries(col(c)), lambda e: F.struct(e["key"].cast("int").alias("class_id"), e["value"].cast("string").alias("label"))))
    return F.coalesce(plain(actual) == plain(expected), F.lit(False))


# What a candidate bundle holds, and what its training configuration must say.
BUNDLE_FILES = "best.pt metrics.json training_config.json environment.txt sha256.txt MODEL_CARD.md".split()
POSITIVE_SETTINGS = "seed imgsz epochs".split()


def bundle_errors(required: list[str] = BUNDLE_FILES, version: str | None = None) -> list[Rule]:
    """Rules on one row per bundle: ``files`` (map of names to sizes), ``checksum_line``, ``sha256``, ``metrics`` (map),
    ``config`` (map of strings), ``task`` and ``labels_ok``."""
    sizes = F.array(*(F.coalesce(F.col("files")[n], F.lit(-1).cast("long")) for n in required))
    parts = F.split(F.trim(F.col("checksum_line")), r"\s+")
    rules = [
        ("missing_file", F.exists(sizes, lambda x: x < 0)),
        ("empty_file", F.exists(sizes, lambda x: x == 0)),
        ("checksum_line", ~F.coalesce((F.size(parts) == 2) & (F.get(parts, F.lit(1)) == "best.pt"), F.lit(False))),
        ("checksum", ~F.coalesce(F.lower(F.get(parts, F.lit(0))) == F.col("sha256"), F.lit(False))),
        ("no_metrics", F.coalesce(F.size("metrics"), F.lit(0)) <= 0),
        ("dataset_version", is_blank(F.col("config")["dataset_version"])),
        *((f"bad_{k}", ~F.coalesce(F.col("config")[k].rlike("^[0-9]+$") & (F.col("config")[k].try_cast("long") > 0), F.lit(False))) for k in POSITIVE_SETTINGS),
        ("task", ~F.coalesce(F.col("task") == "segment", F.lit(False))),
        ("labels", ~F.coalesce("labels_ok", F.lit(False))),
    ]
    if version:
        rules.append(("version", ~F.coalesce(F.col("config")["version"] == version, F.lit(False))))
    return rules


def config_errors(checkpoint_name: str, folder: str) -> list[Rule]:
    """Rules on a run's configuration: ``dataset_version``, ``checkpoint``, ``run_name`` and ``run_exists``."""
    parts = F.split(F.replace(F.col("checkpoint"), F.lit("\\"), F.lit("/")), "/")
    return [
        ("dataset_version", is_blank("dataset_version")),
        ("checkpoint_name", ~F.coalesce(F.element_at(parts, -1) == checkpoint_name, F.lit(False))),
        ("checkpoint_folder", ~F.coalesce(F.exists(parts, lambda p: F.lower(p) == folder), F.lit(False))),
        ("run_name", is_blank("run_name")),
        ("run_exists", F.coalesce("run_exists", F.lit(True))),
    ]


def waterfall(df: DataFrame, rules: list[Rule], column: str = "reject_reason") -> DataFrame:
    """``df`` with the first reason to reject each row, or null."""
    return df.withColumn(column, first_error(rules))


def reason_counts(df: DataFrame, column: str = "reject_reason", accepted: str = "accepted") -> DataFrame:
    return df.groupBy(F.coalesce(column, F.lit(accepted)).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def exploded_errors(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """One row per error: key, place of the error in the row's list from 1, error."""
    return df.select(key, F.posexplode(all_errors(rules)).alias("place", "error")).withColumn("place", F.col("place") + 1)


def summary(df: DataFrame, errors: Column, statuses: dict[str, Column]) -> DataFrame:
    """One row: totals, valid and invalid rows, and rows for which each status holds.

    Statuses are counted whether or not the row has errors, so an incomplete row may be invalid too.
    """
    x = df.select("*", F.size(errors).alias("_errors"))
    return x.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("_errors") == 0).alias("valid_rows"),
        F.count_if(F.col("_errors") > 0).alias("invalid_rows"),
        *(F.count_if(c).alias(n) for n, c in statuses.items()),
    )


def readiness(summary_df: DataFrame, total: str, invalid: str, reviewed: str) -> DataFrame:
    """Adds ``ready``: there are rows, none is invalid, and all are reviewed. Unknown counts aren't ready."""
    ready = (F.col(total) > 0) & (F.col(invalid) == 0) & (F.col(reviewed) == F.col(total))
    return summary_df.withColumn("ready", F.coalesce(ready, F.lit(False)))


def manifest_gate(summary_df: DataFrame, allow_provisional: bool = False) -> DataFrame:
    """Adds ``verdict``: ``invalid``, ``incomplete`` or ``provisional`` in this order, else ``ready``."""
    out = F.when(F.col("invalid_rows") > 0, "invalid").when(F.col("incomplete_rows") > 0, "incomplete")
    if not allow_provisional:
        out = out.when(F.col("provisional_rows") > 0, "provisional")
    return summary_df.withColumn("verdict", F.when(F.coalesce(F.col("total_rows"), F.lit(0)) == 0, "empty").otherwise(out.otherwise("ready")))


def deployment_gate(recall: str | Column, mean_iou: str | Column, least_recall: float = 0.90, least_iou: float = 0.75, fpr: str | Column | None = None, most_fpr: float | None = None) -> Column:
    """Whether a candidate may be deployed; a figure that isn't known fails. The false positive rate is
    tested only if a limit is given."""
    ok = (col(recall) >= least_recall) & (col(mean_iou) >= least_iou)
    if most_fpr is not None:
        ok = ok & (col(fpr) <= most_fpr)
    return F.coalesce(ok, F.lit(False))


def version_matches(config_validation: str, config_dataset: str, manifest: str) -> Column:
    """Whether a manifest has the version that a run was validated on, or else trained on."""
    return F.coalesce(F.coalesce(F.col(config_validation), F.col(config_dataset)) == F.col(manifest), F.lit(False))


def combined_status(status: str | Column, failed: str | Column) -> Column:
    """Failure unless a known status came from a run that is known not to have failed."""
    return F.when(~col(failed) & col(status).isin("obstacle", "uncertain"), col(status)).otherwise(F.lit("failure"))


def frame_status(in_corridor: str | Column) -> Column:
    """No status ever says that the way is free."""
    return F.when(col(in_corridor) > 0, "obstacle").otherwise("uncertain")


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df`` whose evaluation fails at the first row that doesn't meet ``condition``."""
    return df.filter(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, as an error on evaluation; else no rows."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # The error hangs on the count, so that it can't be raised for a key before its rows are counted.
    fault = F.concat(F.lit("duplicate key: "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)), F.lit(" x "), F.col("n").cast("string"))
    return counted.filter(F.when(F.col("n") > 1, F.raise_error(fault).cast("boolean")).otherwise(F.lit(False)))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if lost := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df


def checked_range(name: str, value, low, high):
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in {low}..{high}")
    return value
