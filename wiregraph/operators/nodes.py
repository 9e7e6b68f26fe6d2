"""Cells of path sets with their level and degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require


def levels(path_edges: DataFrame) -> DataFrame:
    """(grp, root_id, level): from the first row where a cell is `pre` (the hop before it), else from the first where it is `post`.

    Downstream rows come before upstream ones and low hops before high ones.
    """
    require(path_edges, "pre", "post", "weight", "hop")
    first = F.min(F.struct(F.when(F.col("hop") > 0, 0).otherwise(1), F.abs("hop"), "hop"))["hop"]
    pre = path_edges.groupBy("grp", F.col("pre").alias("root_id")).agg(first.alias("h")).select("grp", "root_id", F.when(F.col("h") > 0, F.col("h") - 1).otherwise(F.col("h")).alias("as_pre"))
    post = path_edges.groupBy("grp", F.col("post").alias("root_id")).agg(first.alias("h")).select("grp", "root_id", F.when(F.col("h") > 0, F.col("h")).otherwise(F.col("h") + 1).alias("as_post"))
    return pre.join(post, ["grp", "root_id"], "full").select("grp", "root_id", F.coalesce("as_pre", "as_post").cast("int").alias("level"))


def degrees(path_edges: DataFrame) -> DataFrame:
    """(grp, root_id, degree): different cells before plus different cells after; a self-loop counts twice."""
    pairs = path_edges.select("grp", "pre", "post").distinct()
    return pairs.select("grp", F.explode(F.array("pre", "post")).alias("root_id")).groupBy("grp", "root_id").agg(F.count("*").alias("degree"))


def node_table(path_edges: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """Levels and degrees of every cell, with annotations where there are any; two rows for a cell there are an error."""
    out = levels(path_edges).join(degrees(path_edges), ["grp", "root_id"])
    if annotations is None:
        return out
    once = annotations.groupBy("root_id").agg(*[F.first(c).alias(c) for c in annotations.columns if c != "root_id"], F.count("*").alias("_n"))
    once = once.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("annotated twice: "), F.col("root_id").cast("string")))).otherwise(F.lit(True)))
    return out.join(once.where("_ok").drop("_n", "_ok"), "root_id", "left").select("grp", "root_id", "level", "degree", *[c for c in annotations.columns if c != "root_id"])


def level_profile(nodes: DataFrame, max_level: int) -> DataFrame:
    """Cells and degree sum of each level 0..max_level of each group, zero where a group has none."""
    found = nodes.groupBy("grp", "level").agg(F.count("*").alias("cells"), F.sum("degree").alias("degree"))
    grid = nodes.select("grp").distinct().select("grp", F.explode(F.sequence(F.lit(0), F.lit(max_level))).alias("level"))
    return grid.join(found, ["grp", "level"], "left").na.fill(0, ["cells", "degree"])


def max_level(nodes: DataFrame) -> int:
    return nodes.agg(F.max("level")).first()[0] or 0
