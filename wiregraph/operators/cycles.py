"""Strongly connected components, and the cells where pathways with recurrents begin.

Cells that only leave or only enter are trimmed first, again and again. What is left is coloured: the largest id that
reaches a cell is its colour, and the cells of a colour that reach that id back are one component (Orzan, 2004; Slota et
al., 2014). Then the rest is trimmed again. All colours are worked on at once; only ids move, each step is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import durable, forget


def _trim(edges: DataFrame) -> DataFrame:
    """The edges between cells that have others before and after them, within these edges.

    An edge's first cell has one after it and its last cell one before it, so a step asks only for the others: one job a step.
    """
    n = edges.count()
    while n:
        entered, left = edges.select(F.col("post").alias("cell")).distinct(), edges.select(F.col("pre").alias("cell")).distinct()
        kept = durable(edges.join(entered, edges["pre"] == entered["cell"], "left_semi").join(left, edges["post"] == left["cell"], "left_semi"))
        now = kept.count()
        forget(edges)
        edges = kept
        if now == n:
            break
        n = now
    return edges


def _colours(edges: DataFrame) -> DataFrame:
    """(cell, colour): the largest id from which a way leads to the cell, itself included. Colours go two connections on in each job."""
    colour = durable(edges.select(F.col("pre").alias("cell")).union(edges.select("post")).distinct().withColumn("colour", F.col("cell")))
    along = edges.select(F.col("pre").alias("cell"), "post")
    step = lambda x: x.join(along, "cell").groupBy(F.col("post").alias("cell")).agg(F.max("colour").alias("colour"))
    moving = colour
    while not moving.isEmpty():
        told = (one := step(moving)).union(step(one)).groupBy("cell").agg(F.max("colour").alias("told"))
        now = durable(colour.join(told, "cell", "left").select("cell", F.greatest("colour", "told").alias("colour"), (F.coalesce("told", "colour") > F.col("colour")).alias("new")))
        forget(colour)
        colour, moving = now.select("cell", "colour"), now.where("new").select("cell", "colour")
    return colour


def _closed(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """(cell, colour): the cells of each colour from which a way within it leads to its id, two connections back in each job."""
    from_, to = colour.select(F.col("cell").alias("pre"), "colour"), colour.select(F.col("cell").alias("post"), "colour")
    within = durable(edges.join(from_, "pre").join(to, ["post", "colour"]).select("pre", F.col("post").alias("cell"), "colour"))
    back = lambda x: x.join(within, ["cell", "colour"]).select(F.col("pre").alias("cell"), "colour").distinct()
    found = moving = durable(colour.where("cell = colour"))
    while True:
        moving = durable((one := back(moving)).union(back(one)).distinct().join(found, ["cell", "colour"], "left_anti"))
        if moving.isEmpty():
            forget(within)
            return found
        found = found.union(moving)


def strong_components(edges: DataFrame) -> DataFrame:
    """(root_id, component) of every cell of connections (pre, post): the least id of the cells that it reaches and that reach it.

    A cell that no cycle goes through is a component of its own; null ends are no cells; an empty table gives none.
    """
    pairs = durable(edges.select("pre", "post").where("pre is not null and post is not null").distinct())
    cells = pairs.select(F.col("pre").alias("root_id")).union(pairs.select("post")).distinct()
    rest, found = _trim(durable(pairs.where("pre != post"))), None
    while not rest.isEmpty():
        colour = _colours(rest)
        done = durable(_closed(rest, colour))
        found = done if found is None else found.union(done)
        from_, to = colour.select(F.col("cell").alias("pre"), "colour"), colour.select(F.col("cell").alias("post"), "colour")
        gone = done.select("cell")
        # a cycle stays within a colour
        left = rest.join(from_, "pre").join(to, ["post", "colour"]).select("pre", "post")
        left = left.join(gone, left["pre"] == gone["cell"], "left_anti").join(gone, left["post"] == gone["cell"], "left_anti")
        rest = _trim(durable(left))
    if found is None:
        return cells.withColumn("component", F.col("root_id"))
    least = found.groupBy("colour").agg(F.min("cell").alias("least"))
    named = found.join(least, "colour").select(F.col("cell").alias("root_id"), "least")
    return cells.join(named, "root_id", "left").select("root_id", F.coalesce("least", "root_id").alias("component"))


def beginnings(edges: DataFrame) -> DataFrame:
    """root_id of the cells in components that no connection enters from outside: where every way through the connections begins.

    Without cycles these are the cells that are `pre` but never `post`; with recurrents, where that rule finds none or too few,
    a cycle that nothing leads into counts as a whole.
    """
    component = durable(strong_components(edges))
    a, b = component.select(F.col("root_id").alias("pre"), F.col("component").alias("ca")), component.select(F.col("root_id").alias("post"), F.col("component").alias("cb"))
    entered = edges.select("pre", "post").distinct().join(a, "pre").join(b, "post").where("ca != cb").select(F.col("cb").alias("component")).distinct()
    return component.join(entered, "component", "left_anti").select("root_id")
