"""Marginals of connectivity matrices without their zeros.

Only cells with a connection are rows. How many cells of a group have none is counted, not written: means, intervals,
histograms, scales and examples are worked out from the rows and that count, and are the same as over zero-filled rows.
`fill` asks for the pairs of groups without any connection too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import running
from .groups import every_pair

PAIR = ["source_group", "target_group"]
KEYS = [*PAIR, "transmitter", "side"]
#: Two-sided 99 % point of the normal distribution.
Z99 = 2.5758293035489004


def connected(m: DataFrame) -> DataFrame:
    """(keys, cell, synapses, partners) of the cells with synapses in a matrix, from both sides in one shuffle."""
    keys = [*PAIR, "transmitter"]
    sets = m.where("synapses > 0").groupingSets([[*keys, "pre"], [*keys, "post"]], *keys, "pre", "post").agg(F.sum("synapses").alias("synapses"), F.count("*").alias("partners"), F.grouping("post").alias("g"))
    return sets.select(*keys, F.when(F.col("g") == 1, "source").otherwise("target").alias("side"), F.coalesce("pre", "post").alias("cell"), "synapses", "partners")


def members(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(side, grp, cell): the cells of every source and target group, each once."""
    side = lambda df, name: df.distinct().select(F.lit(name).alias("side"), "grp", F.col("root_id").alias("cell"))
    return side(sources, "source").unionByName(side(targets, "target"))


def _own_group() -> Column:
    return F.when(F.col("side") == "source", F.col("source_group")).otherwise(F.col("target_group"))


def all_keys(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """The keys of every pair of groups, every transmitter of the whole table and 'all', and both sides: the result's size when it is filled."""
    kinds = edges.where("transmitter is not null").select("transmitter").unionByName(edges.sparkSession.sql("select 'all' transmitter")).distinct()
    names = every_pair(sources.select(F.col("grp").alias("source_group")).distinct(), targets.select(F.col("grp").alias("target_group")).distinct())
    return every_pair(names, kinds).select("*", F.explode(F.array(F.lit("source"), F.lit("target"))).alias("side"))


def summary(rows: DataFrame, sources: DataFrame, targets: DataFrame, value: str = "synapses", fill: DataFrame | None = None) -> DataFrame:
    """(keys, n, zeros, total, squares, least, most) of `connected` rows: n is the group's size, zeros the cells that are not rows.

    Keys without any row are left out unless `fill` (of `all_keys`) names them.
    """
    x = F.col(value).cast("decimal(19,0)")
    found = rows.groupBy(*KEYS).agg(F.count("*").alias("k"), F.sum(value).alias("total"), F.sum((x * x).cast("decimal(28,0)")).alias("squares"), F.min(value).alias("least"), F.max(value).alias("most"))
    if fill is not None:
        found = fill.join(found, KEYS, "left").na.fill(0, ["k", "total", "squares", "least", "most"])
    size = members(sources, targets).groupBy("side", F.col("grp").alias("own")).agg(F.count("*").alias("n"))
    out = found.withColumn("own", _own_group()).join(size, ["side", "own"])
    zeros = F.col("n") - F.col("k")
    return out.select(*KEYS, "n", zeros.alias("zeros"), "total", "squares", F.when(zeros > 0, 0).otherwise(F.col("least")).cast("long").alias("least"), "most")


def stats(s: DataFrame, z: float = Z99) -> DataFrame:
    """(keys, n, mean, low, high) of a summary: the mean over all cells of the group, and its closed-form interval."""
    n, total = F.col("n").cast("decimal(19,0)"), F.col("total").cast("decimal(19,0)")
    spread = (n * F.col("squares").cast("decimal(38,0)") - (total * total).cast("decimal(38,0)")).cast("double")  # exact up to here
    mean, half = F.col("total") / F.col("n"), F.lit(z) * F.sqrt(spread) / F.col("n") / F.sqrt("n")
    return s.select(*KEYS, "n", mean.alias("mean"), (mean - half).alias("low"), (mean + half).alias("high"))


def histogram(rows: DataFrame, s: DataFrame, bin_width: int, value: str = "synapses") -> DataFrame:
    """(keys, bin, cells): cells in each bin of the width, by its number; those without a connection are in bin 0."""
    found = rows.groupBy(*KEYS, F.floor(F.col(value) / bin_width).cast("long").alias("bin")).agg(F.count("*").alias("cells"))
    none = s.where("zeros > 0").select(*KEYS, F.lit(0).cast("long").alias("bin"), F.col("zeros").alias("cells"))
    return found.unionByName(none).groupBy(*KEYS, "bin").agg(F.sum("cells").alias("cells"))


def scaled(rows: DataFrame, s: DataFrame) -> DataFrame:
    """(pair, side, cell, synapses, scaled) of the connected cells over all transmitters: targets by the largest, sources from least to largest.

    Cells that are not rows would be 0; null where the scale is 0.
    """
    whole = s.where("transmitter = 'all'").select(*PAIR, "side", "least", "most")
    x = F.col("synapses")
    value = F.when(F.col("side") == "target", F.try_divide(x.cast("double"), F.col("most").cast("double"))).otherwise(F.try_divide((x - F.col("least")).cast("double"), (F.col("most") - F.col("least")).cast("double")))
    return rows.where("transmitter = 'all'").join(whole, [*PAIR, "side"]).select(*PAIR, "side", "cell", "synapses", value.alias("scaled"))


def order(rows: DataFrame) -> DataFrame:
    """(pair, side, cell, synapses, position) of the connected cells, the most synapses first; all others would follow by id."""
    own = rows.where("transmitter = 'all'").select(*PAIR, "side", "cell", "synapses")
    return running(own, [*PAIR, "side"], [F.desc("synapses"), "cell"], name="position").withColumn("position", F.col("position").cast("int"))


def examples(rows: DataFrame, s: DataFrame, sources: DataFrame, targets: DataFrame, n: int = 5) -> DataFrame:
    """(pair, side, cell, synapses, sel_rank): up to n cells evenly spaced along the rising totals; each cell once.

    A rank among the cells without a connection is found by counting: with p_i the place in its group of the i-th
    connected cell, the k-th cell that is not connected stands at k plus the number of i with p_i - i <= k.
    """
    keys = [*PAIR, "side"]
    ranks = F.array_distinct(F.array(*[F.bround(F.lit(i / max(1, n - 1)) * (F.col("n") - 1), 0).cast("long") for i in range(n)]))
    wanted = s.where("transmitter = 'all'").select(*keys, "zeros", F.explode(ranks).alias("sel_rank"))
    own = rows.where("transmitter = 'all'").select(*keys, "cell", "synapses")
    up = running(own, keys, ["synapses", "cell"], name="place").withColumn("place", F.col("place") - 1)
    there = wanted.where("sel_rank >= zeros").withColumn("place", F.col("sel_rank") - F.col("zeros")).join(up, [*keys, "place"]).select(*keys, "cell", "synapses", "sel_rank")
    places = running(members(sources, targets), ["side", "grp"], ["cell"], name="p").select("side", F.col("grp").alias("own"), "cell", (F.col("p") - 1).alias("p"))
    among = own.withColumn("own", _own_group()).join(places, ["side", "own", "cell"])
    free = running(among, keys, ["cell"], name="i").select(*keys, (F.col("p") - (F.col("i") - 1)).alias("free"))
    lacking = wanted.where("sel_rank < zeros")
    before = free.join(lacking, keys).where("free <= sel_rank").groupBy(*keys, "sel_rank").agg(F.count("*").alias("k"))
    at = lacking.join(before, [*keys, "sel_rank"], "left").withColumn("p", F.col("sel_rank") + F.coalesce("k", F.lit(0))).withColumn("own", _own_group())
    none = at.join(places, ["side", "own", "p"]).select(*keys, "cell", F.lit(0).cast("long").alias("synapses"), "sel_rank")
    return there.unionByName(none).withColumn("sel_rank", F.col("sel_rank").cast("int"))
