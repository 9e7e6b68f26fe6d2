"""Reproducible shuffle and sharding: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [int(_mix(np.array([seed & (2**64 - 1)], np.uint64), (r + 1) * 0x9E3779B97F4A7C15 % 2**64)[0]) for r in range(ROUNDS)]


def permute(x: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A bijection of 0..n-1: Feistel rounds over the least even number of bits that holds n - 1, walked until below n."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = np.array(x, np.uint64)
    todo = np.arange(len(out))
    keys = _keys(seed)
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> half, out[todo] & mask
            for key in keys:
                left, right = right, left ^ (_mix(right, key) & mask)
            out[todo] = (left << half) | right
            todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def number_rows(df: DataFrame, *order: str, name: str = "row_number") -> tuple[DataFrame, int]:
    """`df` with its columns and `name`: 0..n-1 in the order of the columns; and n.

    Ranges are sorted apart and written once with each row's place, so a lost executor cannot renumber rows;
    only the count of each range goes through the driver. Rows equal in all order columns may change places.
    """
    columns = df.columns
    x = df.toDF(*[f"c_{i}" for i in range(len(columns))])
    by = [f"c_{columns.index(c)}" for c in order]
    placed = durable(x.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "part int, start long")
    return placed.join(F.broadcast(offsets), "part").select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(columns)], (F.col("start") + F.col("at")).alias(name)), total


def shard(df: DataFrame, order: list[str], n_shards: int, seed: int = 0) -> DataFrame:
    """Adds `row_number`, `position` (its place in the shuffle), `shard` = position mod n and `slot` = position div n.

    Shard counts differ by one at most and slots have no gaps, by construction. Any shard and slot lead back to
    a row number, so a reader can fetch the k-th sample of a shard without reading the others. Null keys sort
    first; rows alike in `order` are interchangeable; an empty table gives no rows. Other columns stay; it is a
    ValueError if one of them has the name of an added one.
    """
    if clash := {"row_number", "position", "shard", "slot"} & set(df.columns):
        raise ValueError(f"columns that the result adds are there already: {', '.join(sorted(clash))}")
    numbered, n = number_rows(df, *order)

    @F.pandas_udf("long")
    def position(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series(permute(x.to_numpy(), n, seed))

    placed = numbered.withColumn("position", position("row_number"))
    return placed.withColumn("shard", (F.col("position") % n_shards).cast("int")).withColumn("slot", F.floor(F.col("position") / n_shards).cast("long"))


def shard_documents(documents: DataFrame, n_shards: int = 40, seed: int = 20) -> DataFrame:
    """Every row of documents (doc_id, text) to its shard and slot, under the law `rows`; only ids, sizes and checksums move.

    A null text counts as empty: size 16, checksum 0. The law has no `grown_shard`. Repeated rows are numbered each;
    very long texts cost one reading; other columns of documents, whatever their names, are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(rows, ["doc_id", "text_crc32", "size"], n_shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")
