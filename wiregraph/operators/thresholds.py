"""Pathways for every threshold from one run.

At each hop a cell keeps the largest threshold at which it is still reached: the best, over the ways of that length, of
the weakest connection on the way. Where that is no more than an earlier hop's, the hop is the cell's distance at no
threshold and is dropped. So each cell's distance is a step function of the threshold, and so is each row's hop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hubs import FromEnd
from ..functions.storage import durable
from ..schema import PATH, ROW, require

#: Stands for no limit at the roots.
NO_LIMIT = 2**63 - 1


def _strength(edges: DataFrame, per: str) -> DataFrame:
    """Adds `strength`, which a threshold is compared with: the row's weight, or that of all rows of its pair."""
    if per == "row":
        return edges.withColumn("strength", F.col("weight"))
    if per != "pair":
        raise ValueError("per: row or pair")
    return edges.withColumn("strength", F.sum("weight").over(Window.partitionBy("pre", "post")))


def distances(adjacency: FromEnd, groups: DataFrame, max_hops: int) -> DataFrame:
    """(grp, node, d, least, most): thresholds from `least` to `most` at which a cell is d hops from its group.

    `adjacency` has (src, dst, strength), a row a pair. Only what is wider than at all earlier hops goes on.
    """
    moving = durable(groups.selectExpr("grp", "root_id node").distinct().withColumn("most", F.lit(NO_LIMIT)))
    out = moving.select("grp", "node", F.lit(0).alias("d"), F.lit(0).cast("long").alias("least"), "most")
    for hop in range(1, max_hops + 1):
        reached = adjacency.meet(moving, "node").groupBy("grp", F.col("dst").alias("node")).agg(F.max(F.least("most", "strength")).alias("most"))
        before = out.groupBy("grp", "node").agg(F.max("most").alias("before"))
        # no wider than before: reached as soon at each threshold
        wider = reached.join(before, ["grp", "node"], "left").where("before is null or most > before")
        now = durable(wider.select("grp", "node", F.coalesce(F.col("before") + 1, F.lit(0).cast("long")).alias("least"), "most"))
        if now.isEmpty():
            break
        moving = now.select("grp", "node", "most")
        out = out.unionByName(now.withColumn("d", F.lit(hop)))
    return out


def paths(edges: DataFrame, groups: DataFrame, max_hops: int = 5, *, down: bool = True, per: str = "row") -> DataFrame:
    """The rows of `paths` without recurrents for all thresholds, with `least` and `most`: at which thresholds the row is at that hop.

    A row may occur at several hops, for thresholds that do not overlap. Thresholds are whole numbers from 0.
    """
    near, far = ("pre", "post") if down else ("post", "pre")
    e = durable(_strength(require(edges, *ROW).select(*ROW), per))
    adjacency = FromEnd(e.groupBy(F.col(near).alias("src"), F.col(far).alias("dst")).agg(F.max("strength").alias("strength")), "src", "dst")
    d = distances(adjacency, groups, max_hops)
    a = d.select("grp", F.col("node").alias(near), (F.col("d") + 1).alias("d"), F.col("least").alias("la"), F.col("most").alias("ma"))
    b = d.select("grp", F.col("node").alias(far), "d", F.col("least").alias("lb"), F.col("most").alias("mb"))
    both = e.join(a, near).join(b, ["grp", far, "d"])
    both = both.withColumn("least", F.greatest("la", "lb")).withColumn("most", F.least("ma", "mb", "strength")).where("least <= most")
    return both.withColumn("hop", (F.col("d") * (1 if down else -1)).cast("int")).select(*PATH, "least", "most")


def at_threshold(rows: DataFrame, k: int) -> DataFrame:
    """The path rows at one threshold, as an expansion of the connections of at least k gives them."""
    return rows.where((F.col("least") <= k) & (F.col("most") >= k)).select(*PATH)


def hop_summaries(rows: DataFrame, ks: list[int]) -> DataFrame:
    """(threshold, grp, hop, cells, synapses, n_rows) for each of the thresholds."""
    reached = F.when(F.col("hop") > 0, F.col("post")).otherwise(F.col("pre"))
    each = rows.withColumn("threshold", F.explode(F.array(*[F.lit(k) for k in ks]))).where("threshold between least and most")
    return each.groupBy("threshold", "grp", "hop").agg(F.countDistinct(reached).alias("cells"), F.sum("weight").alias("synapses"), F.count("*").alias("n_rows"))
