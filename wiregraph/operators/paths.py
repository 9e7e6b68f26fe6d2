"""Pathways hop by hop from groups of cells, all groups in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import durable
from ..schema import PATH, ROW, require
from .bitmaps import members, numbered, path_rows, path_sets


def paths(edges: DataFrame, groups: DataFrame, max_hops: int = 5, *, downstream: bool = True, upstream: bool = False, skip_recurrents: bool = True) -> DataFrame:
    """All connection rows on up to max_hops hops from each group, with `hop`: positive downstream, negative upstream.

    With skip_recurrents, rows that lead back to a cell already reached are left out. Both directions: a row may occur in both.
    All groups expand together, as bitmaps; groups without a name have no rows.
    """
    if not (downstream or upstream):
        raise ValueError("choose downstream, upstream or both")
    edges = require(edges, *ROW).select(*ROW)
    names = numbered(groups)
    start = durable(members(groups, names))
    parts = [path_rows(path_sets(edges, start, max_hops, down, skip_recurrents), names) for down, wanted in ((True, downstream), (False, upstream)) if wanted]
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


def one_hop(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows that leave each group's cells, recurrents kept; no iteration."""
    return edges.join(groups.distinct(), edges["pre"] == groups["root_id"]).withColumn("hop", F.lit(1)).select(*PATH)


def hop_summary(path_edges: DataFrame) -> DataFrame:
    """Cells reached, synapses and rows of each hop of each group."""
    reached = F.when(F.col("hop") > 0, F.col("post")).otherwise(F.col("pre"))
    return require(path_edges, "pre", "post", "weight", "hop").groupBy("grp", "hop").agg(F.countDistinct(reached).alias("cells"), F.sum("weight").alias("synapses"), F.count("*").alias("n_rows"))


def path_size(path_edges: DataFrame) -> DataFrame:
    """Cells and rows of each group's path set."""
    ends = path_edges.select("grp", F.explode(F.array("pre", "post")).alias("root_id"))
    return ends.groupBy("grp").agg(F.countDistinct("root_id").alias("cells"), F.expr("count(*) div 2").alias("n_rows"))
