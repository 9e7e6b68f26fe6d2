"""Hard negatives by threshold joins over an inverted index (Anastasiu and Karypis, "L2AP", 2014).

Rows stand in blocks, anchors in groups; each group meets each block once a pass. In a block, postings by chunks of
dimensions leave out those at the end of a row that the norms of what remains cannot lift to the threshold. Partial
scores are accumulated chunk by chunk, pairs are dropped once partial score and remaining norms stay below it, and what
is left is scored exactly in integers. A pass finds every row at or above each anchor's threshold; anchors whose list
or windows are not filled by those go into the next pass with a lower one, down to where nothing can be missing. Of
each block and anchor only the best few leave the task, so a frequent vector costs no more than a rare one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, forget

#: Rows of a block of the index, anchors of a group, dimensions of a chunk of postings.
BLOCK, GROUP, CHUNK = 8192, 128, 8
#: Share of pairs still possible below which they go on one by one, and pairs scored exactly at once.
SPARSE, EXACT = 0.1, 50_000
#: Thresholds of the passes for positives, as shares of the anchor's own score; the last pass has none.
POSITIVE_STEPS = (0.8, 0.5, 0.3, 0.15)
#: Thresholds of the passes for negatives, as shares of the anchor's lowest positive score, before the windows' lower end.
NEGATIVE_STEPS = (0.95, 0.88)
LAST = 2**63 - 1


def pairs_at_least(a: np.ndarray, least: np.ndarray, y: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of all pairs of integer rows with a_i . y_j >= least_i, of those allowed (None: all)."""
    d = a.shape[1]
    cuts = [*range(0, d, CHUNK), d]
    fa, fy = a.astype(float), y.astype(float)
    # norms of what stands at or after each cut, a little larger than they are
    rest = lambda m: np.stack([np.sqrt((m[:, c:] ** 2).sum(1)) * (1 + 1e-9) for c in cuts], axis=1)
    ra, ry = rest(fa), rest(fy)
    # a row's postings end at the first cut after which no anchor here can reach its threshold by the rest alone
    ends = (ry * ra.max(0, initial=0.0) < least.min(initial=np.inf)).argmax(1)
    ends = np.where(ry[:, -1] * 0 < least.min(initial=np.inf), ends, len(cuts) - 1)
    floor = least[:, None] - 1e-6
    score = np.zeros((len(a), len(y)))
    alive = np.ones(score.shape, bool) if allowed is None else allowed.copy()
    cols, k = np.arange(len(y)), 0
    while k < len(cuts) - 1 and alive.mean() > SPARSE if alive.size else False:
        posted = np.flatnonzero(ends[cols] > k)
        score[:, posted] += fa[:, cuts[k] : cuts[k + 1]] @ fy[cols[posted], cuts[k] : cuts[k + 1]].T
        k += 1
        at = np.minimum(k, ends[cols])
        alive &= score + ra[:, at] * ry[cols, at] >= floor
        kept = alive.any(0)
        if kept.mean() < 0.5:
            cols, score, alive = cols[kept], score[:, kept], alive[:, kept]
    i, c = np.nonzero(alive)
    j, s = cols[c], score[i, c]
    for k in range(k, len(cuts) - 1):
        posted = np.flatnonzero(ends[j] > k)
        s[posted] += (fa[i[posted], cuts[k] : cuts[k + 1]] * fy[j[posted], cuts[k] : cuts[k + 1]]).sum(1)
        at = np.minimum(k + 1, ends[j])
        kept = s + ra[i, at] * ry[j, at] >= least[i] - 1e-6
        i, j, s = i[kept], j[kept], s[kept]
    out = [np.zeros((3, 0), np.int64)]
    for at in range(0, len(i), EXACT):
        p, q = i[at : at + EXACT], j[at : at + EXACT]
        exact = (a[p] * y[q]).sum(1)
        good = exact >= least[p]
        out.append(np.stack([p[good], q[good], exact[good]]))
    return tuple(np.concatenate(out, axis=1))


def _vectors(raw: bytes, kind: str, d: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(-1, d).astype(np.int64)


def _pack(rows: DataFrame, key: str, kind: str, extra: tuple = ()) -> DataFrame:
    """One row for each `key`: arrays of row, id and label, the vectors as bytes, and the extra columns as arrays."""

    def pack(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(list(g["v"])).astype(kind).tobytes()
        return pd.DataFrame({key: [int(k[0])], "row": [g["row"].to_numpy()], "id": [g["id"].to_numpy()], "label": [g["label"].to_numpy()], "v": [v], **{c: [list(g[c])] for c in extra}})

    kinds = dict(rows.dtypes)
    return rows.select(key, "row", "id", "label", "v", *extra).groupBy(key).applyInPandas(pack, f"{key} long, row array<long>, id array<long>, label array<long>, v binary" + "".join(f", {c} array<{kinds[c]}>" for c in extra))


class _Index:
    """The rows in blocks, their dimensions in the order of falling weight, and passes of anchors over them."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        self.rows = durable(rows.distinct().withColumn("row", F.monotonically_increasing_id()))
        seen = self.rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)).alias("most"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
        if seen["a"] != seen["b"]:
            raise ValueError(f"vectors of {seen['a']} to {seen['b']} entries")
        self.d = seen["b"] or 0
        if (seen["most"] or 0.0) >= 2.0**52:
            raise ValueError("entries too large for exact scores")
        self.kind = next(k for k, most in (("int16", 2**15), ("int32", 2**31), ("int64", 2**63)) if (seen["top"] or 0) < most)
        self.blocks_n = max(1, -(-seen["n"] // BLOCK))
        weights = self.rows.agg(*[F.sum(F.col("v")[i].cast("double") * F.col("v")[i]).alias(f"w{i}") for i in range(self.d)]).first() if self.d else []
        self.order = [int(i) for i in np.argsort([-(w or 0.0) for w in weights], kind="stable")]
        # the copies of an id are spread, whatever is frequent
        cut = self._turned(self.rows).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(self.blocks_n)))
        self.blocks = durable(_pack(cut, "block", self.kind).select("block", *[F.col(c).alias(f"b_{c}") for c in ("row", "id", "label", "v")]))

    def _turned(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("v", F.array(*[F.col("v")[i] for i in self.order])) if self.d else rows

    def meet(self, anchors: DataFrame, extra: tuple, found, schema: str) -> DataFrame:
        """What `found` gives for each group of anchors (row, id, label, v, extra) and block."""
        d, kind, n = self.d, self.kind, self.blocks_n
        few = durable(_pack(self._turned(anchors).withColumn("grp", F.floor(F.col("place") / GROUP)), "grp", kind, extra))
        every = few.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples():
                    yield found(r, _vectors(r.v, kind, d), _vectors(r.b_v, kind, d))

        parts = min(n, 4096)
        out = durable(every.repartition(parts, "block").join(self.blocks.repartition(parts, "block"), "block").mapInPandas(run, schema))
        forget(few)
        return out


def _best(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n best of each key by score, then id, with their place from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row"))).where(F.col("rank") <= n)


def _numbered(anchors: DataFrame) -> DataFrame:
    """Adds `place`: 0, 1, ..., by which anchors fall into groups; from the written partition's number and the place in it."""
    x = durable(anchors.withColumn("m", F.monotonically_increasing_id()).withColumn("p", F.shiftright("m", 33)))
    before = x.groupBy("p").agg(F.count("*").alias("n")).withColumn("start", F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)))  # one row a partition
    return durable(x.join(before.select("p", "start"), "p").withColumn("place", F.coalesce("start", F.lit(0)) + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).drop("m", "p", "start"))


def _top(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n best (score falling, id rising) of each group."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    first = np.searchsorted(g, g, side="left")
    return order[np.arange(len(g)) - first < n]


def positives(index: _Index, anchors: DataFrame, n: int) -> DataFrame:
    """(a_row, rank, row, id, score): the n best other rows of each anchor's label; passes with falling thresholds."""

    def found(r, a: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        out, mine, theirs, least = [], np.asarray(r.label), np.asarray(r.b_label), np.asarray(r.least, float)
        for label in np.unique(mine):
            p, q = np.flatnonzero(mine == label), np.flatnonzero(theirs == label)
            i, j, s = pairs_at_least(a[p], least[p], y[q])
            i, j = p[i], q[j]
            other = np.asarray(r.row)[i] != np.asarray(r.b_row)[j]
            i, j, s = i[other], j[other], s[other]
            keep = _top(i, s, np.asarray(r.b_id)[j], n)
            out.append(pd.DataFrame({"a_row": np.asarray(r.row)[i[keep]], "row": np.asarray(r.b_row)[j[keep]], "id": np.asarray(r.b_id)[j[keep]], "score": s[keep]}))
        return pd.concat(out)

    own = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    todo, done = anchors, None
    for share in (*POSITIVE_STEPS, None):
        least = F.lit(float("-inf")) if share is None else own * share
        got = index.meet(todo.withColumn("least", least), ("least",), found, "a_row long, row long, id long, score long")
        best = durable(_best(got, ["a_row"], n))
        forget(got)
        if share is not None:
            full = best.where(F.col("rank") == n).select("a_row")
            best, todo = best.join(full, "a_row", "left_semi"), durable(todo.join(full, todo["row"] == full["a_row"], "left_anti"))
        done = best if done is None else done.unionByName(best)
        if share is None or todo.isEmpty():
            break
    return durable(done)


def windows(index: _Index, anchors: DataFrame, found_positives: DataFrame, n: int, low: int) -> DataFrame:
    """(a_row, pos, rank, row, id, score): the n best rows of other labels between low % and 100 % of each positive's score."""

    def found(r, a: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        rows, ids = np.asarray(r.b_row), np.asarray(r.b_id)
        out = [pd.DataFrame({"a_row": [], "pos": [], "row": [], "id": [], "score": []}, dtype=np.int64)]
        i, j, s = pairs_at_least(a, np.asarray(r.least, float), y, np.asarray(r.label)[:, None] != np.asarray(r.b_label))
        order = np.lexsort((ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        for at, (start, end) in enumerate(zip(np.searchsorted(i, np.arange(len(a))), np.searchsorted(i, np.arange(len(a)), side="right"))):
            falling, here = -s[start:end], j[start:end]
            for pos, high in enumerate(r.scores[at], 1):
                first = int(np.searchsorted(falling, -high))
                last = min(first + n, int(np.searchsorted(falling, -(-(-low * high // 100)), side="right")))
                if last > first:
                    out.append(pd.DataFrame({"a_row": int(r.row[at]), "pos": pos, "row": rows[here[first:last]], "id": ids[here[first:last]], "score": -falling[first:last]}))
        return pd.concat(out)

    # a negative score has no window: low % of it is above it
    wanted = found_positives.where("score >= 0").groupBy("a_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    todo = durable(anchors.join(wanted, anchors["row"] == wanted["a_row"]).drop("a_row"))
    done = None
    for share in (*NEGATIVE_STEPS, None):
        bottom = F.array_min("scores")
        least = F.ceil(bottom * F.lit(low) / 100).cast("double") if share is None else bottom * F.lit(share)
        got = index.meet(todo.withColumn("least", least), ("least", "scores"), found, "a_row long, pos int, row long, id long, score long")
        best = durable(_best(got, ["a_row", "pos"], n))
        forget(got)
        if share is not None:
            # a window that is not full may have rows below the threshold; its anchor goes on
            full = best.where(F.col("rank") == n).groupBy("a_row").agg(F.count("*").alias("filled"))
            full = durable(todo.join(full, todo["row"] == full["a_row"]).where(F.col("filled") == F.size("scores")).select("a_row"))
            best, todo = best.join(full, "a_row", "left_semi"), durable(todo.join(full, todo["row"] == full["a_row"], "left_anti"))
        done = best if done is None else done.unionByName(best)
        if share is None or todo.isEmpty():
            break
    return done


def mine(rows: DataFrame, is_anchor: str, n_positives: int = 5, n_negatives: int = 5, low: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score over rows (id, label, v: array of long).

    Anchors are the rows that `is_anchor` (SQL over id) selects. An anchor's positives are its best other rows of its label; for
    each, the negatives are the best rows of another label whose score is low % to 100 % of the positive's. Best: by the
    integer inner product with the anchor, ties by id. Rows alike in id, label and vector count once. A null id sorts
    last, comes out null and is no anchor (2^63 - 1 stands for it and is reserved). Vectors of different lengths and
    scores beyond 2^52 are a ValueError. An empty table, anchors without a positive and empty windows give no rows.
    """
    index = _Index(rows.select(F.coalesce(F.col("id").cast("long"), F.lit(LAST)).alias("id"), F.col("label").cast("long").alias("label"), "v"))
    anchors = _numbered(index.rows.where(F.expr(is_anchor) & (F.col("id") != LAST)))
    best = positives(index, anchors, n_positives)
    found = windows(index, anchors, best, n_negatives, low)
    own = anchors.select(F.col("row").alias("a_row"), F.col("id").alias("anchor_id"))
    of = best.select("a_row", F.col("rank").alias("pos"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    known = lambda c: F.nullif(F.col(c), F.lit(LAST)).alias(c)
    out = found.select("a_row", "pos", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(of, ["a_row", "pos"]).join(own, "a_row")
    return out.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")


def report(embeddings: DataFrame) -> DataFrame:
    """The hard negatives of embeddings (vec_id, embedding, label), by the contract of its query.

    Rows with a null label, a null vector or a null or non-finite component take no part. Labels of ids divisible by 7
    move on by one (of ten); components become floor(256 * x). Anchors: ids divisible by 100. Other columns are not read.
    """
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    x = embeddings.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")).where(F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(x.select("id", label.alias("label"), F.transform("v", lambda c: F.floor(c.cast("double") * 256)).alias("v")), "id % 100 = 0")


#: DuckDB: every anchor's scores with all rows, by the definition.
ORACLE = """
with x as (select vec_id id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as lab, list_transform(embedding, lambda c: cast(floor(cast(c as double) * 256) as bigint)) v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select a.id anchor_id, b.id id, a.lab = b.lab same, cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) as bigint) score from x a join x b on a.id % 100 = 0 and a.id != b.id),
p as (select anchor_id, id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select p.*, s.id negative_id, s.score negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, id) r from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score)
select anchor_id, positive_id, cast(r as int) as rank, negative_id, positive_score, negative_score from n where r <= 5
"""
