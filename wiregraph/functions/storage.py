"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and all runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found and not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return (found or _OWN[0]).rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read back: short lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system it is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame) -> None:
    """Deletes a table of `durable` that is no longer read."""
    for f in df.inputFiles()[:1]:
        remove(df.sparkSession, f.rsplit("/", 1)[0])


def bucketed(df: DataFrame, *keys: str, deal: bool = True) -> DataFrame:
    """`df` written once to the shared folder in buckets of the keys, sorted by them: joins on these move only the other side.

    For tables that are joined again and again. As many buckets as there are shuffle partitions, a file each; or, if not
    dealt, a file for each bucket of which a task has rows, without a shuffle: for tables of few large rows.
    """
    spark, name = df.sparkSession, f"laid_out_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(n, *keys) if deal else df).write.bucketBy(n, *keys).sortBy(*keys).format("parquet").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
