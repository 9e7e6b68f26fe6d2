"""Ranks and running sums within keys, over ranges of the order instead of one task for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import durable


def running(df: DataFrame, keys: list[str], order: list, value: str | None = None, name: str = "place") -> DataFrame:
    """Adds `name`: the running sum of `value` (None: the running count, so 1 is the first) within the keys, in the order given.

    Rows are sorted into ranges of keys and order, written once, summed within each range, and each range starts from
    what the ranges before it hold of the key. A key of any size is spread over as many tasks as it has ranges. `order` are
    columns or names and must tell the rows of a key apart, else tied rows may change places. Null keys are a key.
    """
    spark, columns = df.sparkSession, df.columns
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(df.repartitionByRange(n, *keys, *by).withColumn("_range", F.spark_partition_id()))
    amount = F.lit(1) if value is None else F.col(value)
    held = placed.groupBy(*keys, "_range").agg(F.sum(amount).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a key and range
    start = held.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumn("_at", F.sum(amount).over(within))
    on = local["_range"] == start["_r"]
    for k in keys:
        on = on & local[k].eqNullSafe(start[f"_{k}"])
    return local.join(start, on).select(*columns, (F.col("_at") + F.col("_start")).alias(name))
