"""Reading and writing connections, annotations and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import bucketed
from ..schema import ANNOTATIONS, EDGES, ROW, require


def _read(spark: SparkSession, path: str, schema, sep: str | None) -> DataFrame:
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("csv", "tsv", "gz"):
        return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").option("sep", sep or ("\t" if ".tsv" in path else ",")).csv(path)
    raise ValueError(f"neither CSV, TSV nor Parquet: {path}")


def read_connections(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Connections; a CSV's five columns are named by position, ids stay exact, and short or long rows are errors."""
    return require(_read(spark, path, EDGES, sep), *ROW)


def read_annotations(spark: SparkSession, path: str, sep: str | None = None, schema=ANNOTATIONS) -> DataFrame:
    """One row per cell; more columns are welcome with a schema that names them."""
    return require(_read(spark, path, schema, sep), "root_id", "cell_type")


def without_sentinel(edges: DataFrame, sentinel: int = -1) -> DataFrame:
    """Rows whose ends are both cells (older exports write -1 for none); a null end is none either."""
    return edges.where((F.col("pre") != sentinel) & (F.col("post") != sentinel))


def save(results: dict[str, DataFrame], folder: str, partition_by: dict[str, str] | None = None) -> None:
    """One Parquet table per result; `partition_by` names a column for some (such as grp), so that one group can be read alone."""
    for name, df in results.items():
        writer = df.write.mode("overwrite")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def laid_out(edges: DataFrame) -> dict[str, DataFrame]:
    """The connections twice, in sorted buckets of `pre` and of `post`, for analyses that join them by either end many times."""
    rows = require(edges, *ROW).select(*ROW)
    return {end: bucketed(rows, end) for end in ("pre", "post")}
