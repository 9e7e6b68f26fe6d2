"""Column sets of the tables, and checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

EDGES = T.StructType([T.StructField("pre", T.LongType()), T.StructField("post", T.LongType()), T.StructField("neuropil", T.StringType()), T.StructField("weight", T.LongType()), T.StructField("transmitter", T.StringType())])
ANNOTATIONS = T.StructType([T.StructField("root_id", T.LongType()), T.StructField("cell_type", T.StringType()), T.StructField("hemibrain_type", T.StringType())])
GROUPS = T.StructType([T.StructField("grp", T.StringType()), T.StructField("root_id", T.LongType())])
ROW = ["pre", "post", "neuropil", "weight", "transmitter"]
PATH = ["grp", *ROW, "hop"]


def require(df: DataFrame, *columns: str) -> DataFrame:
    """`df`, or a ValueError that lists the columns it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)} (there are {', '.join(df.columns)})")
    return df
