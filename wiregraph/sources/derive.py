"""A part graph and a supplier graph from order lines: consecutive lines of an order are linked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connections(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Edges between the `key` (l_partkey or l_suppkey) of one line and of the next of the same order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = _table(spark, sf_dir, "lineitem").select(F.col(key).alias("pre"), F.lead(key).over(order).alias("post"), F.col("l_returnflag").alias("neuropil"), F.col("l_linestatus").alias("transmitter"), F.col("l_quantity").cast("long").alias("q"))
    return lines.where("post is not null").groupBy("pre", "post", "neuropil", "transmitter").agg(F.sum("q").alias("weight")).select("pre", "post", "neuropil", "weight", "transmitter")


def part_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("root_id"), F.col("p_type").alias("cell_type"), F.col("p_brand").alias("hemibrain_type"))


def supplier_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    return _table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("root_id"), F.col("n_name").alias("cell_type"), F.col("r_name").alias("hemibrain_type"))
