"""Connected components by alternating large-star and small-star steps, as joins and aggregations.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each step keeps at most as many edges as it
reads. The least neighbours of a step are written before they are joined, so both sides of the join are plain shuffles
and adaptive execution splits the rows of a hub over tasks (`spark.sql.adaptive.skewJoin`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: a node's larger neighbours to the least of it and its neighbours; small star: it and its smaller ones to the least of those."""
    if large:
        x = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(x.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w")))
        moved = x.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v"))
    else:
        least = durable(edges.groupBy("u").agg(F.min("v").alias("w")))
        moved = edges.join(least, "u").select(F.greatest("v", "w").alias("u"), F.least("v", "w").alias("v")).unionByName(least.select("u", F.col("w").alias("v")))
    out = durable(moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    forget(least)
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) edges of any sortable type to (node, component): the least node of each component.

    Nodes that are in no edge between two different nodes are absent; null ends are ignored; an empty table gives none.
    """
    now = durable(edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or (state["n"], state["h"]) == seen:
            break
        seen, last, half = (state["n"], state["h"]), now, _step(now, True)
        now = _step(half, False)
        forget(last)
        forget(half)
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
