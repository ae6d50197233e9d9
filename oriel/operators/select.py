"""Ordered selection: seeded ranks, budgets, held-out heads, ratio mixes, best thresholds."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oriel.functions.expressions import col
from oriel.functions.hashing import seeded_key
from oriel.operators.validate import checked_range
from oriel.plans.tables import written


def seeded_order(rows: DataFrame, key: str, seed: int) -> DataFrame:
    return rows.withColumn("order_key", seeded_key(seed, key))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank`` from 1 in the order of ``order`` (unique), without one task for all rows.

    Rows are dealt by range; sizes of ranges, one row each, give every range its first rank.
    """
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("_part").orderBy(*order)
    return dealt.join(F.broadcast(starts), "_part").withColumn("rank", (F.col("_before") + F.row_number().over(within)).cast("long")).drop("_part", "_before")


#: Rows of a block in the order of a budget, and rows that one task walks at a time.
BLOCK_ROWS = 100_000


def _walk(order: str, room: int, n: int):
    """Takes rows in order as long as there is room: their keys and numbers, and a last row that tells where the step ended."""

    def walk(step: pd.DataFrame) -> pd.DataFrame:
        out, left, taken = [], room, n
        for key, s in step.sort_values(order)[[order, "_size"]].itertuples(index=False):
            if s <= left:
                left, taken = left - s, taken + 1
                out.append((key, taken, left, len(step)))
        out.append((step[order].max(), None, left, len(step)))
        kinds = {order: step[order].dtype, "take": "Int32", "left": "int64", "seen": "int64"}
        return pd.DataFrame({c: pd.Series(v, dtype=t) for (c, t), v in zip(kinds.items(), zip(*out, strict=True), strict=True)})

    return walk


def budget_select(rows: DataFrame, order: str, size: str, budget: int, most: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows taken greedily in the order of ``order`` (unique): one is skipped if it would exceed ``budget``, and at most ``most`` are
    taken. Adds ``take``, the number of the row among those taken. A row without a size is never taken.

    Rows are dealt into blocks by order. As long as whole blocks fit, running sums over one row for each block tell that all
    of their rows are taken. Where something is skipped, the rest of the budget is small, and as it only shrinks, a row larger
    than it never fits later: each step gives a task the next ``block_rows`` rows that still fit, which it walks; the driver
    sees only what is left.
    """
    checked_range("most", most, 1, 1 << 62)
    sized = rows.select(order, F.col(size).cast("long").alias("_size")).filter(F.col("_size").isNotNull())
    parts = max(1, -(-sized.count() // block_rows))
    dealt = written(sized.repartitionByRange(parts, order).withColumn("_block", F.spark_partition_id()), "blocks")
    blocks = dealt.groupBy("_block").agg(F.sum("_size").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.min("_size").alias("_least"))
    upto = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    running = blocks.withColumns({"_used": F.sum("_sum").over(upto), "_taken": F.sum("_n").over(upto), "_least": F.min("_least").over(upto)})
    whole = running.filter((F.col("_used") <= budget) & (F.col("_taken") <= most) & (F.col("_least") >= 0))
    head = whole.agg(F.max("_block").alias("b"), F.coalesce(F.max("_used"), F.lit(0)).alias("used"), F.coalesce(F.max("_taken"), F.lit(0)).alias("n")).first()
    left, taken, last = budget - head["used"], head["n"], None
    starts = F.broadcast(whole.select("_block", (F.col("_taken") - F.col("_n")).alias("_before")))  # one row for each block
    within = F.row_number().over(Window.partitionBy("_block").orderBy(order))
    chosen = [dealt.join(starts, "_block").select(order, (F.col("_before") + within).cast("int").alias("take"))] if head["n"] else []
    rest = dealt if head["b"] is None else dealt.filter(F.col("_block") > head["b"])
    kinds = T.StructType([rows.schema[order], T.StructField("take", T.IntegerType()), T.StructField("left", T.LongType()), T.StructField("seen", T.LongType())])
    while taken < most:
        fits = rest.filter(F.col("_size") <= left)
        fits = fits if last is None else fits.filter(F.col(order) > F.lit(last))
        asked = min(most - taken, block_rows)
        step = written(fits.select(order, "_size").orderBy(order).limit(asked).withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(_walk(order, left, taken), kinds), "step")
        end = step.filter("take IS NULL").first()
        if end is None:
            break
        new = step.filter("take IS NOT NULL").select(order, "take")
        taken += new.count()
        chosen.append(new)
        left, last = end["left"], end[order]
        if end["seen"] < asked:
            break
    if not chosen:
        return rows.limit(0).withColumn("take", F.lit(0))
    return rows.join(reduce(DataFrame.unionByName, chosen), order)


def holdout_head(ranked_rows: DataFrame, share: float = 0.1) -> DataFrame:
    """Adds ``part``: the first max(1, round(share * n)) ranks (ties to even) are ``validation``, the others
    ``train``; an error if that leaves no training row."""
    n = ranked_rows.agg(F.count(F.lit(1)).alias("_n")).withColumn("_head", F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(share)).cast("int")))
    head = F.when(F.col("_n") > F.col("_head"), F.col("_head")).otherwise(F.raise_error(F.lit("no training rows left")).cast("int"))
    return ranked_rows.join(F.broadcast(n), how="inner").withColumn("part", F.when(F.col("rank") <= head, "validation").otherwise("train")).drop("_n", "_head")


def ratio_mix(main: DataFrame, extra: DataFrame, ratio: int, name: str) -> DataFrame:
    """The rows of ``extra`` (rank from 1) that go with ``main``: max(1, round(n / ratio)) places, ties to even,
    filled in order and from the start again; names are unique by place."""
    if ratio not in (2, 4):
        raise ValueError("ratio must be 2 or 4")
    sizes = main.agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(extra.agg(F.count(F.lit(1)).alias("_m"))), how="inner")
    need = F.greatest(F.lit(1), F.bround(F.col("_n") / F.lit(float(ratio))).cast("int"))
    # Each extra row makes its own places, so nothing is generated in one task.
    rows = extra.join(F.broadcast(sizes), how="inner").withColumn("_need", need).filter("rank <= _need")
    places = rows.withColumn("place", F.explode(F.expr("sequence(cast(rank AS int) - 1, _need - 1, cast(_m AS int))")))
    return places.withColumn("target_name", F.format_string("%04d_%s", "place", F.col(name).cast("string"))).drop("_n", "_m", "_need")


def best_threshold(reports: DataFrame, threshold: str = "threshold") -> DataFrame:
    """The one best report: highest recall, then mean IoU, then lowest false positive rate, then lowest
    threshold. Unknown figures count as worst."""
    order = F.struct(F.coalesce("recall", F.lit(-1.0)), F.coalesce("mean_iou", F.lit(-1.0)), -F.coalesce("false_positive_rate", F.lit(1.0)), -col(threshold))
    return reports.agg(F.max_by(F.struct(*reports.columns), order).alias("best")).select("best.*")


def limit_or_fail(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows; an error if there are fewer."""
    head = rows.orderBy(order).limit(n)
    count = head.agg(F.count(F.lit(1)).alias("_n"))
    return head.join(F.broadcast(count), how="inner").filter(F.when(F.col("_n") == n, F.lit(True)).otherwise(F.raise_error(F.lit(f"fewer than {n} rows")).cast("boolean"))).drop("_n")
