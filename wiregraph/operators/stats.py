"""Bootstrap intervals of marginals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .marginals import KEYS, members

#: A drawn number below 2^32 * CDF(k) of the Poisson distribution with mean 1 stands for a weight of at most k.
WEIGHTS = [int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def weight(replicate: Column, cell: Column) -> Column:
    """How often a cell is drawn in a replicate: Poisson with mean 1, from the md5 of both, so any engine gives the same."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", replicate.cast("string"), cell.cast("string"))), 1, 8), 16, 10).cast("long")
    return sum(((u >= F.lit(w)).cast("int") for w in WEIGHTS), F.lit(0))


def bootstrap_ci(rows: DataFrame, sources: DataFrame, targets: DataFrame, value: str = "synapses", reps: int = 10_000, level: float = 0.99) -> DataFrame:
    """(keys, n, mean, low, high): percentile intervals of resampled means over `connected` rows, cells without a connection included.

    Poisson bootstrap: a replicate's mean is the weighted one, and a cell has one weight in a replicate wherever it
    counts. So the weights of a group add up once for all its pairs and transmitters, and cells without a connection need
    no rows. Nothing is held per group but its replicates' sums. Replicates that draw no cell of a group are left out.
    """
    times = F.explode(F.sequence(F.lit(1), F.lit(reps)))
    all_cells = members(sources, targets)
    drawn = all_cells.withColumn("rep", times).groupBy("side", "grp", "rep").agg(F.sum(weight(F.col("rep"), F.col("cell"))).alias("drawn"))
    size = all_cells.groupBy("side", "grp").agg(F.count("*").alias("n"))
    sums = rows.select(*KEYS, "cell", value).withColumn("rep", times).groupBy(*KEYS, "rep").agg(F.sum(weight(F.col("rep"), F.col("cell")) * F.col(value)).alias("s"))
    own = F.when(F.col("side") == "source", F.col("source_group")).otherwise(F.col("target_group")).alias("grp")
    means = sums.withColumn("grp", own).join(drawn, ["side", "grp", "rep"]).where("drawn > 0").withColumn("m", F.col("s") / F.col("drawn"))
    tail = (1 - level) / 2
    bounds = means.groupBy(*KEYS, "grp").agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    total = rows.groupBy(*KEYS).agg(F.sum(value).alias("total"))
    out = bounds.join(total, KEYS).join(size, ["side", "grp"])
    return out.select(*KEYS, "n", (F.col("total") / F.col("n")).alias("mean"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
