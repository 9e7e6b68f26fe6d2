"""Edges laid out for joins from one end, with hubs split by their other end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bucketed, durable

#: Edges of a cell that stay together; a cell with more is split into parts.
HUB_EDGES = 10_000


class FromEnd:
    """Edges (`end`, `other`, ...) in sorted buckets of the end and its part.

    A cell with over HUB_EDGES edges has its edges in several parts, by a hash of the other end, so that no bucket, task
    or key holds all of them. The list of such cells is at most the edges' number over HUB_EDGES.
    """

    def __init__(self, edges: DataFrame, end: str, other: str):
        parts = F.ceil(F.count("*") / HUB_EDGES).cast("int").alias("_parts")
        hubs = durable(edges.groupBy(F.col(end).alias("_hub")).agg(parts).where("_parts > 1"))
        self.end, self.hubs = end, None if hubs.isEmpty() else hubs
        if self.hubs is None:
            self.edges = bucketed(edges, end)
        else:
            cut = edges.join(hubs, edges[end] == hubs["_hub"], "left").withColumn("_part", F.pmod(F.xxhash64(other), F.coalesce("_parts", F.lit(1))).cast("int"))
            self.edges = bucketed(cut.drop("_hub", "_parts"), end, "_part")

    def meet(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows with each edge from the cell in `column`; a row at a hub meets each part of its edges."""
        if self.hubs is None:
            return rows.join(self.edges, rows[column] == self.edges[self.end])
        x = rows.join(self.hubs, rows[column] == self.hubs["_hub"], "left")
        x = x.withColumn("_at", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_hub", "_parts")
        return x.join(self.edges, (x[column] == self.edges[self.end]) & (x["_at"] == self.edges["_part"])).drop("_at", "_part")
