"""Where the pathways of two groups meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bitmaps as B
from .nodes import degrees, levels


def edge_intersection(path_edges: DataFrame, group_a: str, group_b: str) -> DataFrame:
    """Rows of A's path set whose pair is also in B's; A's hop stays."""
    b = path_edges.where(F.col("grp") == group_b).select("pre", "post").distinct()
    return path_edges.where(F.col("grp") == group_a).join(b, ["pre", "post"], "left_semi").select(*path_edges.columns)


def all_intersections(path_edges: DataFrame) -> DataFrame:
    """(group_a, group_b, pairs): common edges of every two groups that have any, whatever their hops.

    By bitmaps of stretches of pairs, so two groups meet once a stretch and not on each pair; a null group or end meets none.
    """
    names = B.numbered(path_edges)
    own = path_edges.select("grp", "pre", "post").join(names, "grp").groupBy("pre", "post", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    return B.intersections(B.shared_pairs(own.withColumn("hop", F.lit(0)), names))


def initial_cells(common: DataFrame) -> DataFrame:
    """root_id of cells that are `pre` but never `post` in the common edges; meaningful without recurrents."""
    return common.select(F.col("pre").alias("root_id")).distinct().join(common.select(F.col("post").alias("root_id")).distinct(), "root_id", "left_anti")


def intersection_nodes(common: DataFrame, nodes_b: DataFrame) -> DataFrame:
    """(root_id, level_a, level_b, degree, initial) of the cells of the common edges; degree is within them."""
    own = levels(common).join(degrees(common), ["grp", "root_id"]).select("root_id", F.col("level").alias("level_a"), "degree")
    start = initial_cells(common).withColumn("initial", F.lit(True))
    return own.join(nodes_b.select("root_id", F.col("level").alias("level_b")), "root_id").join(start, "root_id", "left").select("root_id", "level_a", "level_b", "degree", F.coalesce("initial", F.lit(False)).alias("initial"))


def _grid(spark, max_level: int) -> DataFrame:
    return spark.range(0, (max_level + 1) ** 2, numPartitions=1).select(F.expr(f"cast(id div {max_level + 1} as int)").alias("level_a"), F.expr(f"cast(id % {max_level + 1} as int)").alias("level_b"))


def level_overlap(cells: DataFrame, max_level: int) -> DataFrame:
    """Cells and degree by (level_a, level_b), of all and of the initial ones, zero-filled over 0..max_level."""
    initial = F.col("initial")
    found = cells.groupBy("level_a", "level_b").agg(F.count("*").alias("cells"), F.sum("degree").alias("degree"), F.count_if(initial).alias("initial_cells"), F.sum(F.when(initial, F.col("degree")).otherwise(0)).alias("initial_degree"))
    return _grid(cells.sparkSession, max_level).join(found, ["level_a", "level_b"], "left").na.fill(0)


def overlap_marginals(overlap: DataFrame) -> DataFrame:
    """(side, level, cells, degree): both marginals of the grid in one pass."""
    sets = overlap.groupingSets([["level_a"], ["level_b"]], "level_a", "level_b").agg(F.sum("cells").alias("cells"), F.sum("degree").alias("degree"), F.grouping("level_a").alias("g"))
    return sets.select(F.when(F.col("g") == 0, "a").otherwise("b").alias("side"), F.coalesce("level_a", "level_b").alias("level"), "cells", "degree")


def visit_overlap(visits_a: DataFrame, visits_b: DataFrame, cells: DataFrame, max_level: int) -> DataFrame:
    """(level_a, level_b, share): over common cells, products of A's and B's visits, scaled to sum 1; all 0 if there are none."""
    a = visits_a.join(cells.select("root_id"), "root_id", "left_semi").select("root_id", F.col("level").alias("level_a"), F.col("p").alias("pa"))
    b = visits_b.select("root_id", F.col("level").alias("level_b"), F.col("p").alias("pb"))
    found = a.join(b, "root_id").groupBy("level_a", "level_b").agg(F.sum(F.col("pa") * F.col("pb")).alias("product"))
    found = found.withColumn("share", F.try_divide("product", F.sum("product").over(Window.partitionBy())))  # one row a pair of levels
    return _grid(cells.sparkSession, max_level).join(found, ["level_a", "level_b"], "left").select("level_a", "level_b", F.coalesce("share", F.lit(0.0)).alias("share"))


def convergence_score(visits_a: DataFrame, visits_b: DataFrame, cells: DataFrame) -> DataFrame:
    """(root_id, score): A's visits times B's visits of each common cell, over all levels."""
    total = lambda v, name: v.groupBy("root_id").agg(F.sum("p").alias(name))
    x = cells.select("root_id").join(total(visits_a, "a"), "root_id", "left").join(total(visits_b, "b"), "root_id", "left")
    return x.select("root_id", (F.coalesce("a", F.lit(0.0)) * F.coalesce("b", F.lit(0.0))).alias("score"))


def type_composition(cells: DataFrame, annotations: DataFrame, value: str = "degree") -> DataFrame:
    """(level_a, level_b, cell_type, value): sums by type, the second type column standing in for a missing first."""
    kind = F.coalesce("cell_type", "hemibrain_type").alias("cell_type")
    return cells.join(annotations, "root_id").select("level_a", "level_b", kind, value).where("cell_type is not null").groupBy("level_a", "level_b", "cell_type").agg(F.sum(value).alias(value))
