"""Results that are kept by group and computed only where they are lacking.

Data of one result is in folders by what it was made from (`made`), the members of a group (`members`) and the group.
A manifest, written after the data, says which of them are complete: what a killed write has left is never read, and is
overwritten when its group is computed again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.storage import durable

MANIFEST = "made string, members string, grp string, n_rows long"


def _hash(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, h): a fingerprint of the rows of each key that does not depend on their order."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns) if c not in keys]
    a, b = F.xxhash64(*values), F.xxhash64(F.lit(1), *values)
    parts = [F.count("*"), F.sum(a.cast("decimal(38,0)")), F.sum(b.cast("decimal(38,0)"))]
    return df.groupBy(*keys).agg(F.md5(F.concat_ws(" ", *[p.cast("string") for p in parts])).alias("h"))


def manifest(folder: str, name: str, like: DataFrame) -> DataFrame:
    """What is complete of a result; empty where nothing is."""
    spark = like.sparkSession
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/{name}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def kept(folder: str, name: str, inputs: DataFrame, groups: DataFrame, options: Mapping, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The result of `compute(groups)` (with a column grp), read where it has been computed for a group and written where not.

    A group is computed again if the inputs (rows, in any order), the options or its cells have changed; groups of the same
    name but other cells are kept side by side. Groups without a name have no result. A group without rows in the result
    counts as computed.
    """
    made = F.md5(F.concat(F.lit(json.dumps(dict(options), sort_keys=True, default=str)), F.lit(" "), F.lit(_hash(inputs).first()["h"])))
    groups = groups.where("grp is not null").select("grp", "root_id").distinct()
    wanted = _hash(groups, "grp").withColumnRenamed("h", "members").withColumn("made", made)
    # written, so that data and manifest agree
    lacking = durable(wanted.join(manifest(folder, name, inputs), ["made", "members", "grp"], "left_anti").select("made", "members", "grp"))
    data = f"{folder}/{name}/data"
    if lacking.isEmpty():
        schema = compute(groups.where("false")).schema
    else:
        found = compute(groups.join(lacking, "grp", "left_semi"))
        schema = found.schema
        found.join(lacking, "grp").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("made", "members", "grp").parquet(data)
        there = _read(inputs, data, schema).join(lacking, ["made", "members", "grp"], "left_semi").groupBy("made", "members", "grp").agg(F.count("*").alias("n_rows"))
        lacking.join(there, ["made", "members", "grp"], "left").na.fill(0, ["n_rows"]).select("made", "members", "grp", "n_rows").write.mode("append").parquet(f"{folder}/{name}/manifest")
    return _read(inputs, data, schema).join(wanted, ["made", "members", "grp"], "left_semi").select(*schema.names)


def _read(like: DataFrame, path: str, schema) -> DataFrame:
    """The data with its own types: names of groups that look like numbers stay strings."""
    from pyspark.sql import types as T

    full = T.StructType([f for f in schema if f.name != "grp"] + [T.StructField(c, T.StringType()) for c in ("made", "members", "grp")])
    try:
        return like.sparkSession.read.schema(full).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return like.sparkSession.createDataFrame([], full)
