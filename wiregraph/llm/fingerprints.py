"""Quartile bucket digests of texts, and their likeness.

Byte triplets are hashed into 256 buckets and counted; a digest says of each bucket between which quartiles of the
counts it lies (2 bits), and how long the text is (eighths of a doubling). Locality-sensitive: what two texts share
moves their counts alike (compare Oliver, Cheng and Chen, "TLSH", 2013).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256
#: The two distances back from a byte at which the other bytes of its triplets stand.
TRIPLETS = ((1, 2), (3, 7), (5, 16))
REACH = max(b for _, b in TRIPLETS)
#: Bytes whose triplets are hashed at once, and bytes of text in one sorted range; ranges at most (their bounds are sent to each task).
SLICE, RANGE_BYTES, MAX_RANGES = 1 << 20, 32 << 20, 20_000
#: Eighths of a doubling in length that count as different lengths in full, and their share of the difference.
LENGTH_STEPS, LENGTH_SHARE = 32, 0.1


def counts(data: bytes) -> np.ndarray:
    """How many triplets fall into each bucket; before the text stand zero bytes, so that every byte has its triplets."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), SLICE):
        piece = data[max(0, at - REACH) : at + SLICE]
        lead = REACH - min(at, REACH)
        a = np.frombuffer(b"\0" * lead + piece, np.uint8).astype(np.uint32)
        for k, (near, far) in enumerate(TRIPLETS):
            h = a[REACH:] | (a[REACH - near : len(a) - near] << np.uint32(8)) | (a[REACH - far : len(a) - far] << np.uint32(16)) | np.uint32(k << 24)
            h *= np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            total += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return total


def digest(text: str) -> bytes:
    """A byte for the length and two bits for each bucket. Equal texts have equal digests; an empty text's is all zero."""
    data = text.encode()
    c = counts(data)
    q = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    level = (c[:, None] > q).sum(1).astype(np.uint8).reshape(-1, 4)
    length = min(255, round(8 * float(np.log2(len(data) + 1))))
    return bytes([length]) + (level[:, 0] << 6 | level[:, 1] << 4 | level[:, 2] << 2 | level[:, 3]).tobytes()


def _levels(d: bytes) -> np.ndarray:
    b = np.frombuffer(d, np.uint8)[1:]
    return np.stack([b >> 6, b >> 4 & 3, b >> 2 & 3, b & 3], axis=1).ravel().astype(np.int64)


def likeness(a: bytes, b: bytes) -> float:
    """From 0 to 1 (equal digests): one less the difference, of which 1 is the bound.

    The difference of the buckets is the sum of their distances in quartiles over what it would be if the second
    digest's quartiles were dealt out anew; lengths add a tenth at most.
    """
    if a == b:
        return 1.0
    x, y = _levels(a), _levels(b)
    p, q = np.bincount(x, minlength=4), np.bincount(y, minlength=4)
    chance = float(p @ np.abs(np.arange(4)[:, None] - np.arange(4)) @ q) / BUCKETS
    apart = float(np.abs(x - y).sum()) / chance if chance else 0.0
    return max(0.0, 1.0 - apart - LENGTH_SHARE * min(1.0, abs(a[0] - b[0]) / LENGTH_STEPS))


@F.pandas_udf(T.StringType())
def fingerprint(text: pd.Series) -> pd.Series:
    """The digest of each text as lower-case hex; null counts as empty."""
    return text.fillna("").map(lambda t: digest(t).hex())


@F.pandas_udf(T.DoubleType())
def fingerprint_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """The likeness of two columns of fingerprints; null where one is null."""
    return pd.Series([None if pd.isna(x) or pd.isna(y) else likeness(bytes.fromhex(x), bytes.fromhex(y)) for x, y in zip(a, b)], dtype="float64")


def _order(doc_id, h) -> tuple:
    return (False, h) if pd.isna(doc_id) else (True, doc_id, h)


def in_order(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, again, id, text): rows in ranges of rising id, each with the first row of the next one (`again`) at its end.

    So a reader of a sorted partition sees after each row the row that follows it in the whole table; after the last
    range comes the first. One shuffle of the texts. Ranges are cut at rows, whose keys (id and a hash of the text) are
    the only thing the driver holds, MAX_RANGES at most; equal ids go by the hash of the text, null ids come first.
    """
    x = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    size = x.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = min(MAX_RANGES, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES + 1))
    lead = F.min(F.struct(F.col("id").isNotNull().alias("there"), "id", "h")).alias("k")
    cut = x.select("id", "h").repartitionByRange(n, F.col("id").isNotNull(), "id", "h").groupBy(F.spark_partition_id()).agg(lead).select("k.id", "k.h").collect()
    starts = sorted(_order(r["id"], r["h"]) for r in cut)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """The row's range, and for the first row of a range also the range before as -1 - its number."""
        out = []
        for i, h in zip(ids, hashes):
            at = bisect_right(starts, key := _order(i, h)) - 1
            out.append([at, -1 - (at - 1) % len(starts)] if starts[at] == key else [at])
        return pd.Series(out)

    x = x.withColumn("at", F.explode(places("id", "h"))).withColumn("again", F.col("at") < 0)
    x = x.withColumn("part", F.when(F.col("again"), -1 - F.col("at")).otherwise(F.col("at")))
    return x.repartitionById(max(1, len(starts)), F.col("part")).sortWithinPartitions("part", "again", F.col("id").isNotNull(), "id", "h").select("part", "again", "id", "text")


def report(documents: DataFrame) -> DataFrame:
    """Of every document (doc_id, text) its fingerprint, that of its edited text, and how alike they and the next document's are.

    The edited text has the last floor(n_chars / 2) code points replaced by as many of the next document's first (all, if
    it has fewer). Null text counts as empty; repeated rows each give a row, and one may be the next of the other; a
    document alone is its own next; equal ids go by the hash of the text, null ids come first. Texts are read whole,
    a slice at a time. An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = part = None
        for b in batches:
            out = []
            for p, again, i, text in zip(b["part"], b["again"], b["id"], b["text"]):
                if p != part:
                    part, held = p, None
                own = digest(text)
                if held is not None:
                    before, was, of = held
                    half = len(was) // 2
                    edited = was[: len(was) - half] + text[:half]
                    changed = digest(edited)
                    out.append((before, len(was), hashlib.sha256(edited.encode()).hexdigest(), of.hex(), changed.hex(), likeness(of, changed), likeness(of, own)))
                held = None if again else (i, text, own)
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"doc_id": "Int64"})

    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_order(ids).mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
