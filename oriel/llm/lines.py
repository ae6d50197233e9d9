"""Line deduplication by overlapping three-line windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel.llm.common import with_row_key, written

#: A window hash is hot if it has over this share of all windows; so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000
SALTS = 64


def line_windows(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, row, pos, h1, h2): 128 bits for each run of ``size`` lines that start at line ``pos``."""
    lines = docs.select("doc_id", "row", F.split("text", "\n").alias("lines")).filter(F.size("lines") >= size)
    at = lambda i, k: F.element_at("lines", i + k + 1)
    found = F.transform(
        F.sequence(F.lit(0), F.size("lines") - size),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(*(at(i, k) for k in range(size))).alias("h1"),
            F.xxhash64(F.lit(0x5BD1E995), *(at(i, k) for k in range(size - 1, -1, -1))).alias("h2"),
        ),
    )
    return lines.select("doc_id", "row", F.inline(found))


def repeated_windows(windows: DataFrame) -> DataFrame:
    """(h1, h2, count, first): windows that occur more than once, with their first place. Counts are
    summed before the shuffle, so a frequent window is one row from each task."""
    return windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("doc_id", "row", "pos")).alias("first")).filter("count > 1")


def later_places(windows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Places of repeated windows but for the first. Windows over ``HOT_SHARE`` of all are joined
    with a broadcast table of at most ``1 / HOT_SHARE`` rows, all others by key."""
    total = repeated.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]
    hot = repeated.filter(F.col("count") > max(1000.0, total * HOT_SHARE))
    rest = repeated.filter(F.col("count") <= max(1000.0, total * HOT_SHARE))
    later = F.struct("doc_id", "row", "pos") > F.col("first")
    few = F.broadcast(hot.select("h1", "h2", "first"))
    a = windows.join(few, ["h1", "h2"]).filter(later)
    b = windows.join(few.select("h1", "h2"), ["h1", "h2"], "left_anti").join(rest.select("h1", "h2", "first"), ["h1", "h2"]).filter(later)
    return a.unionByName(b).select("doc_id", "row", "pos")


def line_dedup(docs: DataFrame, size: int = 3) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_spans (maximal removed runs) and the text left.

    Lines are what ``\\n`` separates. Each run of ``size`` consecutive lines that occurs earlier (by
    doc_id, then by row hash, then by line; the same document included) is removed; overlapping removed
    runs merge. Windows are judged on the input, not on what is left. Documents of fewer lines have no
    window and stay whole. A null text has no lines and stays null; an empty one has one empty line.
    Of rows with the same doc_id and text the first by file and place stays as it would alone; the others lose every line,
    if they have a window, as all of theirs occur earlier. Null doc_ids
    come first. Other columns are left alone; an empty table gives no rows.
    """
    docs, a, b = with_row_key(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.col(a).alias("file"), F.col(b).alias("at")).alias("place")).withColumn("row", F.xxhash64("text"))
    windows = written(line_windows(own, size), "windows")
    repeated = written(repeated_windows(windows), "repeated")
    copies = written(own.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_copy")).filter("n > 1"), "copies")
    decided = later_places(windows, repeated).withColumn("first_copy", F.lit(None).cast(copies.schema["first_copy"].dataType))
    decided = decided.unionByName(copies.select("doc_id", "row", F.lit(None).cast("int").alias("pos"), "first_copy"))
    decided = decided.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("starts"), F.max("first_copy").alias("first_copy"))
    # Later copies of a frequent row are told by a broadcast table of at most 1 / HOT_SHARE rows; all others meet by key.
    total = copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = F.broadcast(copies.filter(F.col("n") > max(1000.0, total * HOT_SHARE))).alias("s")
    same = "d.doc_id <=> s.doc_id AND d.row = s.row"
    again = own.alias("d").join(hot, F.expr(f"{same} AND d.place <> s.first_copy"))
    rest = own.alias("d").join(hot, F.expr(f"{same} AND d.place <> s.first_copy"), "left_anti").alias("d").join(decided.alias("s"), F.expr(same), "left")
    none = F.array().cast("array<int>")
    out = again.select("d.doc_id", "d.text", none.alias("starts"), F.lit(True).alias("copy")).unionByName(
        rest.select("d.doc_id", "d.text", F.coalesce("s.starts", none).alias("starts"), F.coalesce(F.expr("d.place <> s.first_copy"), F.lit(False)).alias("copy"))
    )
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (size - 1)))))
    covered = F.when(F.col("copy") & (F.size("lines") >= size), F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(covered)
    out = out.withColumn("lines", F.split("text", "\n")).withColumn("removed", covered)
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    # A run starts at a removed line whose predecessor stays.
    spans = F.size(F.array_except("removed", F.transform("removed", lambda p: p + 1)))
    return out.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        spans.cast("long").alias("n_spans"),
        F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("lines", i + 1)), "\n")).alias("text"),
    )
