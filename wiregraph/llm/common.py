"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import durable, forget, shared_dir  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The word patterns of the queries' contracts.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Estimated bytes up to which a side of a join is broadcast; above, the join shuffles.
BROADCAST_BYTES = 32 << 20


def fit(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """`df` to be broadcast if its rows, counted here unless given, at `row_bytes` each are within BROADCAST_BYTES."""
    return F.broadcast(df) if (df.count() if rows is None else rows) * row_bytes <= BROADCAST_BYTES else df


@contextmanager
def batch_bytes(spark: SparkSession, size: str) -> Iterator[None]:
    """Within it, Arrow batches to and from Python end at `size` (plus a row); for jobs that run inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Identifies rows up to those that are equal in id and text, which every operator treats alike."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("k_id"), F.xxhash64(text).alias("k_a"), F.crc32(text.cast("binary")).alias("k_b")]


def same_key(left: DataFrame, right: DataFrame, cols=("k_id", "k_a", "k_b")) -> Column:
    """Null-safe equality on a row key (ids may be null)."""
    on = left[cols[0]].eqNullSafe(right[cols[0]])
    for c in cols[1:]:
        on = on & (left[c] == right[c])
    return on


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: unlike a projection, a generator is not copied into later filters and lambdas."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row key, and the columns of `df` as c_0, c_1, ... in their order, so that no name of theirs can clash."""
    names = df.columns
    x = df.toDF(*[f"c_{i}" for i in range(len(names))])
    return x.select(*row_key(f"c_{names.index(id_col)}", f"c_{names.index(text_col)}"), "*")


def unkeyed(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like` again, from a result of `keyed`."""
    return df.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(like.columns)])
