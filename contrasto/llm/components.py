"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is joins and aggregations that combine before their shuffle.  The least neighbours are written before they are
joined with the edges, so that both sides of the join have exchanges of their own and Spark can split a hub's edges over
tasks (or send the small side to all).  Each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasto.llm.common import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: long columns u, v.  Returns (node, root): the smallest node of its component, for nodes with an edge to another."""
    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "components")
    mark = _mark(e)
    for _ in range(most_rounds):
        # large star: the larger neighbours of a node point to the least of its neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components")
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "components")
        # small star: a node and its smaller neighbours point to the least of them
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "components")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        now = _mark(e)
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
