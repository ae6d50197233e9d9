"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oriel.llm.common import free_name, with_row_key, written

#: Words are what lies between ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
#: Weights by rank of the source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Sources up to which their table is broadcast; with more it is joined by key, salted.
BROADCAST_SOURCES = 20_000
#: Blocks that a source is cut into at least (if it has as many words), and words a block has at most.
SOURCE_BLOCKS, BLOCK_WORDS = 1024, 1 << 20
#: Documents of a source in one run of its shuffled order, on average.
RUN_DOCS = 4096
#: Cells of [0, slots) by which slots meet sources.
CELLS = 4096
#: Bits of the hash that shuffles a source.
HASH_BITS = 60


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """One row per source: key (rank by code point from 0, null last), words and documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    return per.withColumn("key", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long"))


def targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight`` and ``target``: weights share ``share`` of all words, no target exceeds ``cap``
    times its source's words, and what is above goes to the others by weight until none is above.

    That end is the level at which min(cap, level * weight) sums to the budget; sources reach their
    cap in order of cap by weight, so one sorted pass over running sums finds it.
    """
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), (F.pmod("key", F.lit(len(weights))) + 1).cast("int"))
    # A single row for each source: one window without partitions is enough.
    everything = Window.partitionBy()
    up_to = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    s = (
        sources.withColumn("weight", w)
        .withColumn("limit", F.col("source_size") * F.lit(cap))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("capped", F.coalesce(F.sum("limit").over(up_to), F.lit(0.0)))
        .withColumn("free_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("free_weight"))
    )
    # The first source, in order, whose cap lies above the level sets it for itself and all after it.
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "key", "level"))).over(everything)["level"]
    s = s.withColumn("final", level)
    return s.withColumn("target", F.when(F.col("final").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("final") * F.col("weight")))).drop("limit", "ratio", "budget", "capped", "free_weight", "level", "final")


def blocks(sources: DataFrame) -> DataFrame:
    """Adds ``quota`` (whole words to take), ``block`` (words in each of the source's equal blocks) and ``n_slots``."""
    return (
        sources.withColumn("quota", F.least(F.round("target").cast("long"), F.floor(F.col("source_size") * 2.0).cast("long")))
        .withColumn("block", F.greatest(F.lit(1).cast("long"), F.least(F.lit(BLOCK_WORDS).cast("long"), F.floor(F.col("source_size") / SOURCE_BLOCKS).cast("long"))))
        .withColumn("n_slots", F.ceil(F.col("quota") / F.col("block")).cast("long"))
    )


def golden_step(n: int) -> int:
    """The whole number nearest to n / golden ratio that has no factor in common with n."""
    best = max(1, round(n * (math.sqrt(5) - 1) / 2))
    for d in range(n + 1):
        for x in (best - d, best + d):
            if 1 <= x <= max(1, n) and math.gcd(x, n) == 1:
                return x
    return 1


def schedule(sources: DataFrame) -> DataFrame:
    """The mix as slots in order: slot, key (of the source) and rank (of the slot in its source).

    Slot k of n has the golden-ratio point k * step mod n, which the cumulative numbers of slots map to a
    source. As step and n share no factor, these points are 0 .. n-1 each once, so a source gets
    exactly its slots, spread evenly over the order. Slots meet sources by cells of the range of points.
    """
    spark = sources.sparkSession
    n = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0)).alias("n")).first()["n"]
    step = golden_step(n) if n else 1
    width = max(1, math.ceil(n / CELLS))
    upper = F.sum("n_slots").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    ranges = (
        sources.filter("n_slots > 0")
        .select("key", "n_slots", upper.alias("stop"))
        .withColumn("first", F.col("stop") - F.col("n_slots"))
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / width).cast("long"), F.floor((F.col("stop") - 1) / width).cast("long"))))
        .select("cell", "key", "first", "stop")
    )
    # k * step can pass 64 bits on very long schedules; decimals hold it there.
    product = f"(id * {step}L) % {max(1, n)}L" if n < 3_000_000_000 else f"cast((cast(id AS decimal(19,0)) * cast({step} AS decimal(19,0))) % cast({n} AS decimal(19,0)) AS long)"
    slots = spark.range(n).selectExpr("id AS slot", f"{product} AS point").withColumn("cell", F.floor(F.col("point") / width).cast("long"))
    placed = slots.join(ranges, "cell").filter("point >= first AND point < stop").select("slot", "key")
    # Ranks by two levels: within runs of slots, and the runs before, so that no task holds all slots of a source.
    placed = placed.withColumn("run", F.floor(F.col("slot") / 65536).cast("long"))
    before = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("key", "run").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return (
        placed.withColumn("within", F.row_number().over(Window.partitionBy("key", "run").orderBy("slot")) - 1)
        .join(runs, ["key", "run"])
        .select("slot", "key", (F.col("before") + F.col("within")).cast("long").alias("rank"))
    )


def with_sources(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """``rows`` with their source's columns; null is a source of its own."""
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumnRenamed("source", "_s").withColumnRenamed("salt", "_salt")
    return rows.withColumn("salt", F.pmod("h", F.lit(64)).cast("int")).join(salted, F.col("source").eqNullSafe(F.col("_s")) & (F.col("salt") == F.col("_salt"))).drop("_s", "salt", "_salt")


def streams(rows: DataFrame) -> DataFrame:
    """Adds ``at``: where a document starts in the shuffled stream of words of its source.

    The order is by a hash of doc_id and text, of ``HASH_BITS`` bits. Its highest bits deal each source into
    runs of about ``RUN_DOCS`` documents; sums of runs come first, then the order within each run.
    """
    run = F.floor((F.col("h").cast("double") / F.lit(float(1 << HASH_BITS))) * F.ceil(F.col("n_docs") / RUN_DOCS)).cast("long")
    rows = rows.withColumn("run", run)
    earlier = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("key", "run").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    order = Window.partitionBy("key", "run").orderBy("h", "doc_id", "size", "row_a", "row_b").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("within", F.coalesce(F.sum("size").over(order), F.lit(0))).join(runs, ["key", "run"]).withColumn("at", F.col("before") + F.col("within")).drop("run", "before", "within")


def decisions(keyed: DataFrame, a: str, b: str, share: float, weights: tuple[float, ...]) -> DataFrame:
    """What the mix does with each row of ``keyed``, whose columns ``a`` and ``b`` tell rows apart: row_a, row_b,
    doc_id, size, source_size, target, taken and first_slot.

    The shuffled stream of each source is cut into equal blocks; every slot of the schedule takes the next block of
    its source, from the start again once the stream has ended, and the last slot of a source only the words left to
    its target. A document is taken in the slots whose blocks hold its words, first in ``first_slot``.
    """
    sized = keyed.select(
        F.col(a).alias("row_a"),
        F.col(b).alias("row_b"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text").cast("string"))), 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"),
    )
    sized = written(sized, "sizes")
    sources = written(blocks(targets(ranked_sources(sized), share, weights=weights)), "sources")
    n_sources = sources.count()
    rows = written(streams(with_sources(sized, sources, n_sources)), "streams")
    # Each document occurs in the first and in the second pass over its source.
    passes = rows.filter("size > 0").withColumn("from", F.explode(F.array(F.col("at"), F.col("at") + F.col("source_size")))).filter("from < quota")
    pieces = passes.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / F.col("block")).cast("long"), F.floor((F.least(F.col("from") + F.col("size"), F.col("quota")) - 1) / F.col("block")).cast("long"))))
    placed = pieces.join(schedule(sources), ["key", "rank"])
    overlap = F.least(F.col("from") + F.col("size"), (F.col("rank") + 1) * F.col("block"), F.col("quota")) - F.greatest(F.col("from"), F.col("rank") * F.col("block"))
    taken = placed.groupBy("row_a", "row_b").agg(F.sum(overlap).cast("long").alias("taken"), F.min("slot").alias("first_slot"))
    out = rows.join(taken, ["row_a", "row_b"], "left")
    return out.select("row_a", "row_b", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_slot")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, the words that the mix takes of it, and the first
    slot of the schedule that takes any (null if none).

    Null and empty texts have size 0 and are taken 0 times. As targets stop at twice the source, no document is
    taken over twice. Very long texts are one row of sizes and lie in as many blocks as they need. Repeated rows
    count as documents of their own; equal ones may share what is taken between them in either order, with equal
    sums. An empty table gives no rows. Clashing extra columns are left alone. Runs agree.
    """
    keyed, a, b = with_row_key(docs)
    return decisions(keyed, a, b, share, weights).drop("row_a", "row_b")


def mixture(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes any of their words: not at all, once or twice, with all
    their columns; each task's rows in the order of the slots that take them first.

    A document of which the mix takes over its size in words stands twice. A source's last document may be
    taken in part and then stands whole. Each row goes by its own decision, whatever doc_id or text it shares.
    """
    keyed, a, b = with_row_key(docs)
    times, slot = free_name(keyed.columns, "_times"), free_name(keyed.columns, "_slot")
    chosen = decisions(keyed, a, b, share, weights).filter("taken > 0")
    chosen = chosen.select(F.col("row_a").alias(a), F.col("row_b").alias(b), F.when(F.col("taken") > F.col("size"), 2).otherwise(1).alias(times), F.col("first_slot").alias(slot))
    rows = keyed.join(chosen, [a, b])
    return rows.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).sortWithinPartitions(slot).select(*(F.col(f"`{c}`") for c in docs.columns))
