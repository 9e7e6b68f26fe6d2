"""Sets of groups as bitmaps: a row for each cell or connection and word of 64 groups, instead of one for each group.

Groups are numbered in the order of their names: group 64 * word + bit. All groups expand together, sets merge by
`bit_or`, and pairs of groups are compared by counting the bits that two bitmaps share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hubs import FromEnd
from ..functions.ranks import running
from ..functions.storage import durable
from ..schema import PATH, ROW

WORD = 64
#: Words of a bitmap over connections in one row of `shared_pairs`.
ROW_WORDS = 64


def numbered(groups: DataFrame) -> DataFrame:
    """(grp, word, bit) of every group with a name, by the order of the names."""
    names = running(groups.select("grp").where("grp is not null").distinct(), [], ["grp"], name="n")
    return durable(names.selectExpr("grp", f"(n - 1) div {WORD} as word", f"cast((n - 1) % {WORD} as int) as bit"))


def members(groups: DataFrame, names: DataFrame) -> DataFrame:
    """(node, word, bits): the groups that each cell is in."""
    return groups.join(names, "grp").groupBy(F.col("root_id").alias("node"), "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))


def bits_of(bits: str = "bits") -> Column:
    """The numbers of the bits that are set."""
    return F.expr(f"filter(sequence(0, {WORD - 1}), i -> (shiftright({bits}, i) & 1L) = 1L)")


def unpack(df: DataFrame, names: DataFrame) -> DataFrame:
    """A row for each group of a set: (word, bits) replaced by grp."""
    return df.withColumn("bit", F.explode(bits_of())).join(names, ["word", "bit"]).drop("word", "bit", "bits")


def expand(adjacency: FromEnd, start: DataFrame, max_hops: int, revisit: bool = False) -> DataFrame:
    """(node, word, bits, d): the groups that reach a cell first in d steps, or with `revisit` by any walk of d steps.

    Each hop is one join and one merge for all groups, is written, and an empty hop ends the loop.
    """
    frontier = durable(start)
    out = frontier.withColumn("d", F.lit(0))
    for hop in range(1, max_hops + 1):
        reached = adjacency.meet(frontier, "node").groupBy(F.col("dst").alias("node"), "word").agg(F.expr("bit_or(bits)").alias("bits"))
        if not revisit:
            seen = out.groupBy("node", "word").agg(F.expr("bit_or(bits)").alias("old"))
            reached = reached.join(seen, ["node", "word"], "left").selectExpr("node", "word", "bits & ~coalesce(old, 0L) as bits").where("bits != 0")
        frontier = durable(reached)
        if frontier.isEmpty():
            break
        out = out.union(frontier.withColumn("d", F.lit(hop)))
    return out


def path_sets(edges: DataFrame, start: DataFrame, max_hops: int, down: bool = True, skip_recurrents: bool = True) -> DataFrame:
    """Connection rows with `hop`, `word` and `bits`: the groups on whose pathways the row is at that hop (negative upstream)."""
    near, far = ("pre", "post") if down else ("post", "pre")
    adjacency = FromEnd(edges.select(F.col(near).alias("src"), F.col(far).alias("dst")).distinct(), "src", "dst")
    sign = 1 if down else -1
    if skip_recurrents:
        # a row is kept at hop h exactly if its ends are h - 1 and h hops from the roots
        d = expand(adjacency, start, max_hops)
        a = d.select(F.col("node").alias(near), "word", F.col("bits").alias("x"), (F.col("d") + 1).alias("d"))
        b = d.select(F.col("node").alias(far), "word", F.col("bits").alias("y"), "d")
        out = edges.join(a, near).join(b, [far, "word", "d"]).withColumn("bits", F.expr("x & y")).where("bits != 0").withColumn("hop", (F.col("d") * sign).cast("int"))
    else:
        f = expand(adjacency, start, max_hops - 1, True)
        out = edges.join(f.select(F.col("node").alias(near), "word", "bits", "d"), near).withColumn("hop", ((F.col("d") + 1) * sign).cast("int"))
    return out.select(*ROW, "hop", "word", "bits")


def path_rows(sets: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of each group, as `paths` gives them."""
    return unpack(sets, names).select(*PATH)


def hop_summary(sets: DataFrame, names: DataFrame) -> DataFrame:
    """(grp, hop, cells, synapses, n_rows) of every group, from the counts of each different set."""
    rows = sets.groupBy("hop", "word", "bits").agg(F.sum("weight").alias("synapses"), F.count("*").alias("n_rows"))
    reached = F.when(F.col("hop") > 0, F.col("post")).otherwise(F.col("pre")).alias("cell")
    cells = sets.groupBy("hop", "word", reached).agg(F.expr("bit_or(bits)").alias("bits")).groupBy("hop", "word", "bits").agg(F.count("*").alias("cells"))
    both = rows.withColumn("cells", F.lit(0).cast("long")).unionByName(cells.selectExpr("hop", "word", "bits", "0L as synapses", "0L as n_rows", "cells"))
    return unpack(both, names).groupBy("grp", "hop").agg(F.sum("cells").alias("cells"), F.sum("synapses").alias("synapses"), F.sum("n_rows").alias("n_rows"))


def common_rows(sets: DataFrame, names: DataFrame, group_a: str, group_b: str) -> DataFrame:
    """Rows of A's pathways whose pair is also on B's, with A's hop, from the sets of all groups."""
    own = lambda g: sets.join(names.where(F.col("grp") == g), "word").where("(shiftright(bits, bit) & 1L) = 1L")
    return own(group_a).join(own(group_b).select("pre", "post").distinct(), ["pre", "post"], "left_semi").select(*PATH)


def shared_pairs(sets: DataFrame, names: DataFrame) -> DataFrame:
    """(group_a, group_b, hop_a, hop_b, pairs): connected pairs of cells on the pathways of both groups, for every two groups.

    Bitmaps are turned over: connected pairs are numbered, and a row for each group, hop and stretch of 4,096 of them says
    which are the group's. Two groups meet once a stretch, not once a pair of cells, and count the bits they share. In
    pathways without recurrents a pair has one hop in each group.
    """
    per = WORD * ROW_WORDS
    each = durable(sets.groupBy("pre", "post", "hop", "word").agg(F.expr("bit_or(bits)").alias("bits")))
    number = running(each.select("pre", "post").distinct(), [], ["pre", "post"], name="n").selectExpr("pre", "post", f"(n - 1) div {per} as stretch", f"cast((n - 1) % {per} div {WORD} as int) as at", f"cast((n - 1) % {WORD} as int) as pos")
    ones = each.join(number, ["pre", "post"]).withColumn("bit", F.explode(bits_of())).select("stretch", "at", "pos", "hop", "word", "bit")
    words = ones.groupBy("stretch", "hop", "word", "bit").agg(F.array(*[F.expr(f"bit_or(if(at = {i}, shiftleft(1L, pos), 0L))") for i in range(ROW_WORDS)]).alias("m"))
    words = durable(words.withColumn("g", F.col("word") * WORD + F.col("bit")).select("stretch", "hop", "g", "m"))
    a, b = words.selectExpr("stretch", "hop hop_a", "g ga", "m x"), words.selectExpr("stretch", "hop hop_b", "g gb", "m y")
    met = a.join(b, "stretch").where("ga < gb").withColumn("pairs", F.expr("aggregate(zip_with(x, y, (p, q) -> bit_count(p & q)), 0, (s, c) -> s + c)")).where("pairs > 0")
    sums = met.groupBy("ga", "gb", "hop_a", "hop_b").agg(F.sum("pairs").alias("pairs"))
    of = names.selectExpr("grp", f"word * {WORD} + bit as g")
    return sums.join(of.withColumnsRenamed({"grp": "group_a", "g": "ga"}), "ga").join(of.withColumnsRenamed({"grp": "group_b", "g": "gb"}), "gb").select("group_a", "group_b", "hop_a", "hop_b", "pairs")


def intersections(shared: DataFrame) -> DataFrame:
    """(group_a, group_b, pairs): common pairs of every two groups that have any."""
    return shared.groupBy("group_a", "group_b").agg(F.sum("pairs").alias("pairs"))


def degree_grids(shared: DataFrame) -> DataFrame:
    """(group_a, group_b, level_a, level_b, degree) within the common pairs: each adds one to its cell before and one to its cell after."""
    ends = shared.select("group_a", "group_b", "pairs", F.explode(F.array(F.lit(1), F.lit(0))).alias("back"), "hop_a", "hop_b")
    return ends.groupBy("group_a", "group_b", (F.col("hop_a") - F.col("back")).alias("level_a"), (F.col("hop_b") - F.col("back")).alias("level_b")).agg(F.sum("pairs").alias("degree"))


def cell_squares(sets: DataFrame) -> DataFrame:
    """(cell, wa, ba, wb, any, first): the groups of word wb with which group ba of word wa shares a connection at the cell.

    For each cell and two words, a square of bits says which two groups share a connection that leaves it, and another
    one for those that enter it; squares of one cell merge by `bit_or`. Rows grow with the cells' connections and the square of
    the words, not of the groups. `first`: those with which it shares only connections that leave.
    """
    each = durable(sets.groupBy("pre", "post", "word").agg(F.expr("bit_or(bits)").alias("bits")))
    both = each.selectExpr("pre", "post", "word wa", "bits x").join(each.selectExpr("pre", "post", "word wb", "bits y"), ["pre", "post"]).where("wa <= wb")
    ends = both.select(F.explode(F.array(F.struct(F.col("pre").alias("cell"), F.lit(True).alias("leaves")), F.struct(F.col("post").alias("cell"), F.lit(False).alias("leaves")))).alias("e"), "wa", "wb", "x", "y").select("e.*", "wa", "wb", "x", "y")
    square = lambda leaves: F.array(*[F.expr(f"bit_or(if({'' if leaves else 'not '}leaves and (shiftright(x, {i}) & 1L) = 1L, y, 0L))") for i in range(WORD)])
    cells = durable(ends.groupBy("cell", "wa", "wb").agg(square(True).alias("pre"), square(False).alias("post")))
    return cells.select("cell", "wa", "wb", F.posexplode(F.arrays_zip("pre", "post")).alias("ba", "m")).selectExpr("cell", "wa", "ba", "wb", "m.pre | m.post as any", "m.pre & ~m.post as first").where("any != 0")


def _named(df: DataFrame, names: DataFrame) -> DataFrame:
    """(wa, ba) and (wb, bb) replaced by the names of the two groups."""
    a, b = names.withColumnsRenamed({"grp": "group_a", "word": "wa", "bit": "ba"}), names.withColumnsRenamed({"grp": "group_b", "word": "wb", "bit": "bb"})
    return df.join(a, ["wa", "ba"]).join(b, ["wb", "bb"]).drop("wa", "ba", "wb", "bb")


def cell_grids(sets: DataFrame, names: DataFrame, squares: DataFrame | None = None) -> DataFrame:
    """(group_a, group_b, level_a, level_b, cells, initial_cells) of the common pairs of every two groups, for downstream pathways without recurrents.

    Initial cells only leave. `squares` are of `cell_squares`, if there already.
    """
    rows = durable(cell_squares(sets)) if squares is None else squares
    ends = F.explode(F.array(F.struct(F.col("pre").alias("cell"), (F.col("hop") - 1).alias("level")), F.struct(F.col("post").alias("cell"), F.col("hop").alias("level")))).alias("e")
    levels = durable(sets.select(ends, "word", "bits").groupBy("e.cell", "e.level", "word").agg(F.expr("bit_or(bits)").alias("bits")))
    la, lb = levels.selectExpr("cell", "word wa", "level level_a", "bits la"), levels.selectExpr("cell", "word wb", "level level_b", "bits lb")
    at = rows.join(la, ["cell", "wa"]).where("(shiftright(la, ba) & 1L) = 1L").join(lb, ["cell", "wb"]).selectExpr("wa", "ba", "level_a", "wb", "level_b", "any & lb as any", "first & lb as first").where("any != 0")
    counted = at.groupBy("wa", "ba", "level_a", "wb", "level_b", "any", "first").agg(F.count("*").alias("n"))
    single = counted.withColumn("bb", F.explode(bits_of("any"))).where("wa < wb or ba < bb").withColumn("i", F.expr("if((shiftright(first, bb) & 1L) = 1L, n, 0L)"))
    sums = single.groupBy("wa", "ba", "wb", "bb", "level_a", "level_b").agg(F.sum("n").alias("cells"), F.sum("i").alias("initial_cells"))
    return _named(sums, names).select("group_a", "group_b", "level_a", "level_b", "cells", "initial_cells")


def _met(visits: DataFrame, squares: DataFrame, names: DataFrame, a: str, b: str) -> DataFrame:
    """Visits (wa, ba, cell, `a`) and (wb, bb, cell, `b`) of two groups at the cells that they have in common.

    A row for each two groups at a cell: what is multiplied and added up there is of this size.
    """
    own = visits.join(names, "grp").withColumnRenamed("root_id", "cell")
    x = own.selectExpr("cell", "word wa", "bit ba", a)
    # a cell's groups of a word stand in one row until they are picked by the bits
    y = own.groupBy("cell", F.col("word").alias("wb")).agg(F.collect_list(F.expr(f"struct(bit as bb, {b})")).alias("ys"))
    both = squares.select("cell", "wa", "ba", "wb", "any").join(x, ["cell", "wa", "ba"]).join(y, ["cell", "wb"])
    return both.withColumn("y", F.explode(F.expr("filter(ys, y -> (shiftright(any, y.bb) & 1L) = 1L and (wa < wb or ba < y.bb))"))).select("cell", "wa", "ba", "wb", a.split()[-1], "y.*")


def visit_grids(visits: DataFrame, squares: DataFrame, names: DataFrame) -> DataFrame:
    """(group_a, group_b, level_a, level_b, share): over the common cells of every two groups, products of their visits, scaled to sum 1; levels that meet only."""
    met = _met(visits.withColumn("v", F.struct("level", "p")), squares, names, "v as va", "v as vb")
    sums = met.groupBy("wa", "ba", "wb", "bb", F.col("va.level").alias("level_a"), F.col("vb.level").alias("level_b")).agg(F.sum(F.col("va.p") * F.col("vb.p")).alias("product"))
    total = sums.groupBy("wa", "ba", "wb", "bb").agg(F.sum("product").alias("total"))
    return _named(sums.join(total, ["wa", "ba", "wb", "bb"]).withColumn("share", F.try_divide("product", "total")), names).select("group_a", "group_b", "level_a", "level_b", "share")


def scores(visits: DataFrame, squares: DataFrame, names: DataFrame) -> DataFrame:
    """(group_a, group_b, root_id, score): A's visits times B's visits of each common cell, over all levels; cells that both visit only."""
    total = visits.groupBy("grp", "root_id").agg(F.sum("p").alias("p"))
    met = _met(total, squares, names, "p as pa", "p as pb").withColumn("score", F.col("pa") * F.col("pb"))
    return _named(met, names).select("group_a", "group_b", F.col("cell").alias("root_id"), "score")
