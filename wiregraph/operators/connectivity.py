"""Connectivity between groups of cells: matrices, marginals, orders and strongest partners, all pairs of groups at once.

Matrices are long and sparse: (source_group, target_group, transmitter, pre, post, synapses), transmitter 'all' included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import every_pair
from .marginals import KEYS, PAIR, all_keys, connected, members
from .marginals import order as connected_order


def pair_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Connections from a cell of a source group to one of a target group, in one scan; a cell in two groups counts in both."""
    s = sources.distinct().select(F.col("grp").alias("source_group"), F.col("root_id").alias("pre"))
    t = targets.distinct().select(F.col("grp").alias("target_group"), F.col("root_id").alias("post"))
    return edges.join(s, "pre").join(t, "post").select(*PAIR, "transmitter", "pre", "post", "weight")


def matrix(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Synapses of each pair, per transmitter and for 'all', by grouping sets over one shuffle; rows without a transmitter count in 'all' only."""
    keys = [*PAIR, "transmitter", "pre", "post"]
    x = pair_edges(edges, sources, targets)
    sets = x.groupingSets([keys, [*PAIR, "pre", "post"]], *keys).agg(F.sum("weight").alias("synapses"), F.grouping("transmitter").alias("g"))
    return sets.where("g = 1 or transmitter is not null").withColumn("transmitter", F.when(F.col("g") == 1, "all").otherwise(F.col("transmitter"))).select(*keys, "synapses")


def of_all(m: DataFrame) -> DataFrame:
    return m.where("transmitter = 'all'").drop("transmitter")


def marginals(m: DataFrame, edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(pair, transmitter, side, cell, synapses, partners) of every cell of each group, zero without a partner.

    `partners` counts cells with over 0 synapses. One row for each cell, opposite group and transmitter is written: where the
    zeros are not wanted as rows, the functions of `marginals` do without.
    """
    cells = members(sources, targets)
    keys = all_keys(edges, sources, targets).withColumn("grp", F.when(F.col("side") == "source", F.col("source_group")).otherwise(F.col("target_group")))
    found = connected(m)
    return keys.join(cells, ["side", "grp"]).select(*KEYS, "cell").join(found, [*KEYS, "cell"], "left").na.fill(0, ["synapses", "partners"])


def dense(m: DataFrame, sources: DataFrame, targets: DataFrame, source: str, target: str) -> DataFrame:
    """(pre, post, synapses) for every cell of one source and one target group, zero where not connected."""
    s, t = sources.where(F.col("grp") == source).select(F.col("root_id").alias("pre")).distinct(), targets.where(F.col("grp") == target).select(F.col("root_id").alias("post")).distinct()
    known = of_all(m).where((F.col("source_group") == source) & (F.col("target_group") == target)).select("pre", "post", "synapses")
    return every_pair(s, t).join(known, ["pre", "post"], "left").na.fill(0, ["synapses"])


def wide(m: DataFrame, posts: list[int] | None = None) -> DataFrame:
    """One row per source cell, one column per target cell, zero where not connected."""
    return of_all(m).groupBy("pre").pivot("post", posts).sum("synapses").na.fill(0)


def transmitter_totals(m: DataFrame, edges: DataFrame) -> DataFrame:
    """Synapses of each pair of groups by every transmitter of the whole table, 0 where absent."""
    found = m.where("transmitter != 'all'").groupBy(*PAIR, "transmitter").agg(F.sum("synapses").alias("synapses"))
    kinds = edges.where("transmitter is not null").select("transmitter").distinct()
    return every_pair(m.select(*PAIR).distinct(), kinds).join(found, [*PAIR, "transmitter"], "left").na.fill(0, ["synapses"])


def order(marg: DataFrame) -> DataFrame:
    """(pair, side, cell, synapses, position): cells by total synapses, the most first, ties by id; zero-filled rows come last."""
    return connected_order(marg)


def strongest_partner(m: DataFrame, selected: DataFrame, side: str = "target") -> DataFrame:
    """(pair, other, transmitter, partner, weight, strength, label): each opposite cell's strongest selected cell over all transmitters.

    `selected` is of `examples`. Ties go to the earlier transmitter, then the earlier selected cell. Strength is relative to the
    largest 'all' entry of the selected cells. Selected cells come with their own totals and override others of the same id.
    """
    mine, theirs = ("post", "pre") if side == "target" else ("pre", "post")
    sel = selected.where(F.col("side") == side).select(*PAIR, F.col("cell").alias(mine), F.col("synapses").alias("total"), "sel_rank")
    x = m.join(sel, [*PAIR, mine]).where("synapses > 0")
    top = x.where("transmitter = 'all'").groupBy(*PAIR).agg(F.max("synapses").alias("top"))
    w = Window.partitionBy(*PAIR, "other").orderBy(F.desc("weight"), "transmitter", "sel_rank")
    best = x.where("transmitter != 'all'").select(*PAIR, F.col(theirs).alias("other"), "transmitter", F.col(mine).alias("partner"), F.col("synapses").alias("weight"), "total", "sel_rank")
    best = best.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place", "sel_rank")
    own = sel.select(*PAIR, F.col(mine).alias("other"), F.lit(None).cast("string").alias("transmitter"), F.col(mine).alias("partner"), F.col("total").alias("weight"), "total")
    rows = best.join(own.select(*PAIR, "other"), [*PAIR, "other"], "left_anti").unionByName(own)
    rows = rows.join(top, PAIR, "left")
    return rows.select(*PAIR, "other", "transmitter", "partner", "weight", F.try_divide(F.col("weight").cast("double"), F.col("top").cast("double")).alias("strength"), F.format_string("%d group (%d synapses)", "partner", "total").alias("label"))
