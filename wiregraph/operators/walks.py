"""Weighted random walks: exact expected visits, first hits and their levels, for which no walk needs to be drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hubs import FromEnd
from ..functions.ranks import running
from ..functions.storage import durable
from .groups import collapse


def transitions(path_edges: DataFrame, edge_weight: str = "sum", order_col: str | None = None) -> DataFrame:
    """(pre, post, weight, p): the share of a cell's out-weight on each of its edges within the path set."""
    pairs = collapse(path_edges, edge_weight, order_col)
    return pairs.withColumn("p", F.col("weight") / F.sum("weight").over(Window.partitionBy("pre")))


def cumulative(trans: DataFrame) -> DataFrame:
    """Adds cum_lo and cum_hi: the range of a uniform draw times the total that leads to each edge."""
    return running(trans, ["pre"], ["post"], "weight", "cum_hi").withColumn("cum_lo", F.col("cum_hi") - F.col("weight"))


def expected_visits(trans: DataFrame, starts: DataFrame, max_level: int, *, absorb: DataFrame | None = None, per_start: bool = True) -> DataFrame:
    """(start, level, root_id, p): the exact mean number of visits of one walk from each start; mass with no way on ends.

    `absorb` (root_id): first hits; mass that reaches these cells at level 1 or later is counted there and goes no further.
    Each level is a sparse product: the state's rows meet the edges of their cell, hubs in parts, and add up by target. Without per_start the starts are summed and `start` is left out, which keeps the state to cells.
    """
    keys = ["start", "root_id"] if per_start else ["root_id"]
    state = starts.select("root_id").distinct().withColumn("start", F.col("root_id")).withColumn("p", F.lit(1.0)).select(*keys, "p")
    # joined once a level, so laid out for it
    step, stop = FromEnd(trans.select("pre", "post", F.col("p").alias("share")), "pre", "post"), None if absorb is None else durable(absorb.select("root_id").distinct())
    out = state.withColumn("level", F.lit(0))
    for level in range(1, max_level + 1):
        moving = state if stop is None or level == 1 else state.join(stop, "root_id", "left_anti")
        moved = step.meet(moving, "root_id").withColumn("root_id", F.col("post")).groupBy(*keys).agg(F.sum(F.col("p") * F.col("share")).alias("p"))
        state = durable(moved)
        if state.isEmpty():
            break
        out = out.unionByName(state.withColumn("level", F.lit(level)))
    return out.select(*keys[:-1], "level", "root_id", "p")


def hits_in(visits: DataFrame, cells: DataFrame) -> DataFrame:
    """Visits in the given cells, and all of level 0."""
    return visits.where("level = 0").unionByName(visits.where("level > 0").join(cells.select("root_id").distinct(), "root_id", "left_semi").select(*visits.columns))


def visits_wide(visits: DataFrame, max_level: int) -> DataFrame:
    """One row per cell with the visits of each level in columns v0.., zero where none."""
    named = visits.withColumn("c", F.concat(F.lit("v"), "level"))
    return named.groupBy("root_id").pivot("c", [f"v{i}" for i in range(max_level + 1)]).agg(F.sum("p")).na.fill(0.0)


def level_totals(visits: DataFrame, cells: DataFrame) -> DataFrame:
    """(level, total, scaled): visits in the cells by level, and divided by the largest."""
    t = visits.join(cells.select("root_id").distinct(), "root_id", "left_semi").groupBy("level").agg(F.sum("p").alias("total"))
    return t.withColumn("scaled", F.try_divide("total", F.max("total").over(Window.partitionBy())))  # one row a level


def type_share(visits: DataFrame, annotations: DataFrame, top: int = 11, cells: DataFrame | None = None) -> DataFrame:
    """The types with the largest share of all steps in cells of known type, most frequent first; with `cells`, of the steps in these and of level 0."""
    visits = visits if cells is None else hits_in(visits, cells)
    typed = visits.join(annotations.where("cell_type is not null").select("root_id", "cell_type"), "root_id").groupBy("cell_type").agg(F.sum("p").alias("n"))
    share = F.coalesce(F.try_divide("n", F.sum("n").over(Window.partitionBy())), F.col("n"))  # one row a type
    return typed.select("cell_type", F.round(share, 6).alias("share")).orderBy(F.desc("share"), "cell_type").limit(top)


def first_hit_levels(hits: DataFrame) -> DataFrame:
    """(level, p): the mean number of walks, one from each start, whose first step in the cells is at that level.

    `hits` are of `expected_visits` with these cells as `absorb`, taken in them by `hits_in`.
    """
    return hits.where("level > 0").groupBy("level").agg(F.sum("p").alias("p"))


def group_visits(path_edges: DataFrame, groups: DataFrame, max_level: int) -> DataFrame:
    """(grp, level, root_id, p): expected visits of one walk from each cell of each group that is on its pathways, summed over the starts.

    All groups in one run: a group's walks follow the edges of its own path set. Cells of no path row start no walk.
    """
    edge = ["grp", "pre", "post"]
    rows = path_edges.dropDuplicates([*edge, "neuropil", "transmitter", "weight"]).groupBy(*edge).agg(F.sum("weight").alias("weight"))
    step = durable(rows.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("grp", "pre"))).selectExpr("grp", "pre as root_id", "post", "share"))
    state = durable(groups.distinct().join(step.select("grp", "root_id").distinct(), ["grp", "root_id"], "left_semi").withColumn("p", F.lit(1.0)))
    out = state.withColumn("level", F.lit(0))
    for level in range(1, max_level + 1):
        state = durable(state.join(step, ["grp", "root_id"]).groupBy("grp", F.col("post").alias("root_id")).agg(F.sum(F.col("p") * F.col("share")).alias("p")))
        if state.isEmpty():
            break
        out = out.unionByName(state.withColumn("level", F.lit(level)))
    return out.select("grp", "level", "root_id", "p")
