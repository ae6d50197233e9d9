"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel.llm.common import drop_table, written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, class) for every node of ``links`` (a, b): class is the lowest node of its component.

    Each round hangs the larger neighbours of a node on its lowest neighbour, then the rest of each
    node's lower neighbours; after a few rounds every node hangs on the lowest one. Only lowest
    neighbours are gathered, summed up before each shuffle. Rounds end in written tables; if ``max_rounds``, far more
    than any length of chain needs, don't end it, an error is raised.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "edges")
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_table(last)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if (now["n"], now["h"]) == state:
            break
        state = (now["n"], now["h"])
    else:
        raise RuntimeError(f"components aren't found after {max_rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("class"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("class")).distinct()
    return nodes.unionByName(roots)
