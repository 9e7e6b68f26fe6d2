"""Groups of cells and thresholds on connections."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import GROUPS, require


def lookup(annotations: DataFrame, criteria: str | Column) -> DataFrame:
    """root_id of the cells of a type (a string) or of any predicate on annotations."""
    predicate = F.col("cell_type") == criteria if isinstance(criteria, str) else criteria
    return require(annotations, "root_id").where(predicate).select("root_id").distinct()


def resolve(annotations: DataFrame, spec: Mapping[str, int | str | Column | list | DataFrame]) -> DataFrame:
    """(grp, root_id): each named group from one id, a type, a predicate, ids, or a DataFrame with root_id."""
    spark, out = annotations.sparkSession, None
    for name, x in spec.items():
        if isinstance(x, DataFrame):
            ids = require(x, "root_id").select(F.col("root_id").cast("long")).distinct()
        elif isinstance(x, (str, Column)):
            ids = lookup(annotations, x)
        else:
            ids = spark.createDataFrame([(i,) for i in dict.fromkeys([x] if isinstance(x, int) else x)], "root_id long")
        part = ids.select(F.lit(name).alias("grp"), "root_id")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], GROUPS)


def by_type(annotations: DataFrame, column: str = "cell_type") -> DataFrame:
    """Every type as a group; cells without one are in none."""
    return annotations.where(F.col(column).isNotNull()).select(F.col(column).alias("grp"), "root_id").distinct()


def threshold(edges: DataFrame, least: int, per: str = "row") -> DataFrame:
    """Connections of at least so many synapses, counted by row or by pair (all rows of a pair stay or go together)."""
    if per == "row":
        return edges.where(F.col("weight") >= least)
    if per != "pair":
        raise ValueError("per: row or pair")
    strong = edges.groupBy("pre", "post").agg(F.sum("weight").alias("w")).where(F.col("w") >= least)
    return edges.join(strong.select("pre", "post"), ["pre", "post"], "left_semi").select(*edges.columns)


def collapse(edges: DataFrame, edge_weight: str = "sum", order_col: str | None = None) -> DataFrame:
    """One weighted edge (pre, post, weight) for each pair: the sum over its different connection rows, or the last by `order_col`.

    Copies of a row at several hops count once. Of rows equal in `order_col` the one with the last neuropil, transmitter
    and weight counts.
    """
    rows = edges.dropDuplicates(["pre", "post", "neuropil", "transmitter", "weight"])
    if edge_weight == "sum":
        return rows.groupBy("pre", "post").agg(F.sum("weight").alias("weight"))
    if edge_weight != "last" or not order_col:
        raise ValueError("edge_weight: sum, or last with order_col")
    return rows.groupBy("pre", "post").agg(F.max_by("weight", F.struct(order_col, "neuropil", "transmitter", "weight")).alias("weight"))


#: Rows of one side that meet the other side in one task of a full product.
PRODUCT_ROWS = 1000


def every_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of `left` with each of `right`, where that is what is asked for: in parts of PRODUCT_ROWS of `right`, each met by `left` in a task."""
    parts = right.count() // PRODUCT_ROWS + 1
    cut = right.withColumn("_part", F.pmod(F.xxhash64(*right.columns), F.lit(parts)))
    return left.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(cut, "_part").drop("_part")
