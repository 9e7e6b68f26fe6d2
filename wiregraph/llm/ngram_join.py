"""Join of documents by the Jaccard similarity of their word 5-grams: a MinHash LSH forest, then exact verification.

Bawa, Condie and Ganesan, "LSH Forest" (2005): each set of shingles is a leaf of several tries, its path in a trie being
a sequence of minhash labels. Sets under a common trie node are candidates. Matched prefixes start at the full depth and
are shortened, step by step, while the recall measured on the links found so far is below the target: a link of
similarity s is found at depth d with probability p = 1 - (1 - s^d)^trees, so the links found stand for sum(1/p) links.

Sets are numbered so that those under a common node stand together, and cut into chunks. A trie node names the pairs of
chunks to compare; the sets it holds are sent to a task for each such pair. Their signatures are compared first; only
sets with a partner there that can reach the threshold are sent with their texts and compared exactly, and only counts
and a link to the least partner leave the task. Hubs of a trie or of links meet in joins of plain tables, which skew
joins split.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fit, forget, keyed, row_key, unkeyed
from .components import components
from .sharding import number_rows

WORDS, THRESHOLD = 5, 0.8
#: Tries, the lengths to which their prefixes are shortened in turn, and the recall that ends it; at the last length a pair at 0.8 is found with probability 0.9999.
TREES, DEPTHS, RECALL = 40, (12, 9, 7), 0.9999
DEPTH = DEPTHS[0]
#: Length of the prefixes by which sets are put in order, and sets in that order that form a chunk.
ORDER_DEPTH, CHUNK = 7, 256
#: Signatures reject a pair if their agreement is so many standard deviations below the threshold (2.9e-7 of pairs at it).
DEVIATIONS = 5
#: Rows of small pairs of chunks that a task gets at a time.
BIN = 400
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        m = 1 << (n - 1).bit_length()
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, x, np.uint64)])) for x in (BASE, INVERSE)]
    return _POWERS


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of `words` words (ASCII case folded, split at ASCII blanks).

    A text of fewer words, but some, has one run of all of them; an empty or null text has none.
    """
    data = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not data:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    blanks = np.flatnonzero(raw == 32)
    if len(blanks) < words - 1:
        start, end = np.zeros(1, np.int64), np.array([len(raw)])
    else:
        start = np.concatenate([[0], blanks[: len(blanks) - words + 1] + 1])
        end = np.concatenate([blanks[words - 1 :], [len(raw)]])
    h = (total[end] - total[start]) * inverse[start]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(29)))


def paths(sets: list[np.ndarray], labels: int, seed: int = 9) -> np.ndarray:
    """(documents, labels) 16-bit minhash labels."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(0, 2**31, labels, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2**32, labels, dtype=np.uint32)
    out = np.zeros((len(sets), labels), np.uint16)
    at = 0
    while at < len(sets):  # so many documents that their hashes stay in cache
        to, n = at, 0
        while to < len(sets) and (to == at or n + len(sets[to]) <= 60_000):
            n += len(sets[to])
            to += 1
        flat = (np.concatenate(sets[at:to]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[at : to - 1]])
        buf = np.empty_like(flat)
        for j in range(labels):
            np.multiply(flat, mult[j], out=buf)
            np.add(buf, add[j], out=buf)
            out[at:to, j] = np.minimum.reduceat(buf, starts) * np.uint32(0x9E3779B1) >> np.uint32(16)
        at = to
    return out


def signatures(documents: DataFrame, *, id_col="doc_id", text_col="text", trees=TREES) -> DataFrame:
    """(k_id, k_a, k_b, n, s_hi, s_lo, path): each row's number of shingles, the hash of their set and its paths in all tries.

    Ids go through Python as strings, so that pandas cannot round them where one of a batch is null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t) for t in batch["t"]]
            n = np.array([len(s) for s in sets], np.int64)
            some = [s for s in sets if len(s)]
            path = np.full(len(sets), b"", object)
            sums = np.zeros((len(sets), 2), np.int64)
            if some:
                path[n > 0] = [row.tobytes() for row in paths(some, trees * DEPTH)]
                flat, starts = np.concatenate(some), np.cumsum([0] + [len(s) for s in some[:-1]])
                other = (flat ^ (flat >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                other ^= other >> np.uint64(31)
                sums[n > 0, 0] = np.add.reduceat(other, starts).view(np.int64)
                sums[n > 0, 1] = np.add.reduceat(other * (other | np.uint64(1)), starts).view(np.int64)
            yield pd.DataFrame({"k_id": batch["k_id"], "k_a": batch["k_a"], "k_b": batch["k_b"], "n": n, "s_hi": sums[:, 0], "s_lo": sums[:, 1], "path": path})

    kind = documents.schema[id_col].dataType
    x = documents.select(*row_key(id_col, text_col), F.col(text_col).alias("t")).withColumn("k_id", F.col("k_id").cast("string"))
    return x.mapInPandas(run, "k_id string, k_a long, k_b long, n long, s_hi long, s_lo long, path binary").withColumn("k_id", F.col("k_id").cast(kind))


def found_at(similarity, depth: int, trees: int):
    """Probability that two sets of a similarity share a trie node at the depth."""
    return 1 - (1 - similarity**depth) ** trees


def _links(sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray, old: np.ndarray, threshold: Fraction, chances) -> tuple[np.ndarray, ...]:
    """(links, head, pairs, standing) of each set of a block: the weight of its partners, the least index linked to it, directly or not, the partners, and what they stand for by each of `chances`.

    `side` 0 or 1: if both occur, only pairs of different sides are compared; pairs of two `old` sets were compared before.
    Similarities are compared as integers. A column holds ones and zeros of 2^22 entries at most, so its products are exact.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    count = np.diff(np.append(first, len(flat)))
    keep = np.repeat(count > 1, count)  # a run of one document meets nothing
    row, column = row[keep], np.repeat(np.cumsum(count > 1) - 1, count)[keep]
    both = np.zeros((n, n), np.int64)
    width, columns = max(1, 4_000_000 // n), int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, columns, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        x = np.zeros((n, min(width, columns - lo)), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        both += (x @ x.T).astype(np.int64)
    union = size[:, None] + size[None, :] - both
    linked = both * threshold.denominator >= union * threshold.numerator
    np.fill_diagonal(linked, False)
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    linked &= ~(old[:, None] & old[None, :])
    head = np.arange(n)
    while True:
        least = np.minimum(head, np.where(linked, head[None, :], n).min(axis=1, initial=n))
        least = np.minimum(least, least[least])
        if (least == head).all():
            break
        head = least
    i, j = np.nonzero(linked)
    similarity = both[i, j] / union[i, j]
    standing = np.array([np.bincount(i, 1 / chance(similarity), n) for chance in chances])
    return linked @ weight, head, linked.sum(1), standing


def _nodes(sets: DataFrame, depth: int, trees: int) -> DataFrame:
    """(u, key): the trie nodes of this depth that each set is under."""
    key = F.array(*[F.xxhash64(F.lit(t), F.substring("path", 1 + t * 2 * DEPTH, 2 * depth)) for t in range(trees)])
    return sets.select("u", F.explode(key).alias("key"))


def _in_order(sets: DataFrame, trees: int) -> DataFrame:
    """The sets with `u` anew: in the order of the least set that each shares a node with, then of the first trie."""
    nodes = _nodes(sets, ORDER_DEPTH, trees)
    least = durable(nodes.groupBy("key").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).where("lo < hi").select("key", "lo"))
    # tables that grow with the documents are never broadcast
    heads = durable(nodes.join(least.hint("merge"), "key").groupBy("u").agg(F.min("lo").alias("lead")))
    x = sets.join(heads.hint("merge"), "u", "left").withColumn("lead", F.coalesce("lead", "u")).withColumnRenamed("u", "was")
    out = durable(number_rows(x, "lead", "was", name="u")[0].drop("lead", "was"))
    forget(least)
    forget(heads)
    return out


def _members(sets: DataFrame, depth: int, trees: int) -> DataFrame:
    """(u, a, b): each set under a trie node of this depth with others, and the chunks a <= b, its own among them, that the node names."""
    nodes, chunk = _nodes(sets, depth, trees), lambda c: (F.col(c) / CHUNK).cast("int")
    shared = durable(nodes.groupBy("key").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).where("lo < hi").select("key", chunk("lo").alias("lo_c"), chunk("hi").alias("hi_c")))
    held = durable(nodes.join(shared.hint("merge"), "key").withColumn("c", chunk("u")))
    wide = held.where("lo_c < hi_c")
    chunks = durable(wide.select("key", F.col("c").alias("other")).distinct())
    across = wide.select("u", "c", "key").join(chunks, "key").select("u", F.least("c", "other").alias("a"), F.greatest("c", "other").alias("b"))
    out = durable(held.where("lo_c = hi_c").select("u", F.col("c").alias("a"), F.col("c").alias("b")).unionByName(across).distinct())
    for table in (shared, held, chunks):
        forget(table)
    return out


def _pairs_of_chunks(group: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """The rows of each pair of chunks (a, b), each set once, with the side it is on."""
    for (_, b), g in group.drop_duplicates(["a", "b", "u"]).groupby(["a", "b"], sort=False):
        if len(g) > 1:
            g = g.sort_values("u")
            yield g, (g["u"].to_numpy() // CHUNK == b).astype(int)


def _screen(labels: int, threshold: Fraction):
    """The sets whose signature agrees with that of a partner nearly as the threshold asks, as a function of a group."""
    t = float(threshold)
    least = labels * (t - DEVIATIONS * (t * (1 - t) / labels) ** 0.5)

    def screen(group: pd.DataFrame) -> pd.DataFrame:
        out = [group.iloc[:0]]
        for g, side in _pairs_of_chunks(group):
            path, old = np.frombuffer(b"".join(g["path"]), np.uint16).reshape(len(g), labels), g["old"].to_numpy(bool)
            near = np.zeros(len(g), bool)
            for i in range(len(g) - 1):
                other = np.count_nonzero(path[i + 1 :] == path[i], axis=1) >= least
                if side.any() and not side.all():
                    other &= side[i + 1 :] != side[i]
                if old[i]:
                    other &= ~old[i + 1 :]
                near[i] |= other.any()
                near[i + 1 :] |= other
            out.append(g[near])
        return pd.concat(out)[["u", "a", "b", "old"]]

    return screen


def _verify(trees: int, threshold: Fraction):
    """The links of the sets that meet in pairs of chunks, as a function of a group."""
    chances = [lambda s, d=d: found_at(s, d, trees) for d in DEPTHS]
    names = ["u", "links", "head", "pairs", "standing"]

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g, side in _pairs_of_chunks(group):
            u = g["u"].to_numpy()
            links, head, pairs, standing = _links([shingles(t) for t in g["t"]], g["copies"].to_numpy(), side, g["old"].to_numpy(bool), threshold, chances)
            out += [(int(u[i]), int(links[i]), int(u[head[i]]), int(pairs[i]), standing[:, i]) for i in np.flatnonzero(pairs)]
        return pd.DataFrame({n: pd.Series([r[k] for r in out], dtype=object if n == "standing" else np.int64) for k, n in enumerate(names)})

    return verify


def forest(documents: DataFrame, sets: DataFrame, *, id_col="doc_id", text_col="text", threshold=THRESHOLD, trees=TREES, recall=RECALL) -> tuple[DataFrame, list[tuple[int, float]]]:
    """(u, links, head) rows of the sets with partners, once for each task that compared them; and the measured recall at each depth."""
    if found_at(threshold, DEPTHS[-1], trees) < recall:
        raise ValueError(f"{trees} tries find a pair at {threshold} by {DEPTHS[-1]} labels with less than {recall}: take more tries")
    exact = Fraction(threshold).limit_denominator(10_000)
    docs = documents.select(*row_key(id_col, text_col), F.col(text_col).alias("t"))
    known, found, steps = None, None, []
    for at, depth in enumerate(DEPTHS):
        members = _members(sets, depth, trees)
        if known is not None:
            now = durable(members.join(known, ["u", "a", "b"], "left").withColumn("old", F.coalesce("old", F.lit(False))))
            grown = now.where("not old").select("a", "b").distinct()
            sent = now.join(grown, ["a", "b"], "left_semi")
            forget(known)
            forget(members)
        else:
            sent = now = members.withColumn("old", F.lit(False))
        block = lambda rows: F.pmod(F.xxhash64("a", "b"), F.lit(max(1, rows // BIN))).alias("block")
        near = durable(sent.join(sets.select("u", "path"), "u").groupBy(block(sent.count())).applyInPandas(_screen(trees * DEPTH, exact), "u long, a int, b int, old boolean"))
        own = durable(near.select("u").distinct().join(sets.select("u", "copies", "r"), "u").select("u", "copies", F.col("r.k_id").alias("r_id"), F.col("r.k_a").alias("r_a"), F.col("r.k_b").alias("r_b")))
        reps = fit(own, 100)
        texts = docs.join(reps, docs["k_id"].eqNullSafe(reps["r_id"]) & (docs["k_a"] == reps["r_a"]) & (docs["k_b"] == reps["r_b"])).select("u", "copies", "t")
        new = durable(near.join(texts, "u").groupBy(block(near.count())).applyInPandas(_verify(trees, exact), "u long, links long, head long, pairs long, standing array<double>"))
        forget(own)
        forget(near)
        found = new if found is None else found.unionByName(new)
        known = now.select("u", "a", "b", F.lit(True).alias("old"))
        total = found.agg(F.sum("pairs").alias("pairs"), F.sum(F.col("standing")[at]).alias("standing")).first()
        # without links there is nothing to measure: the chance of a pair at the threshold
        steps.append((depth, total["pairs"] / total["standing"] if total["pairs"] else found_at(threshold, depth, trees)))
        if steps[-1][1] >= recall:
            break
    return found.select("u", "links", "head"), steps


def classed(documents: DataFrame, *, id_col="doc_id", text_col="text", threshold=THRESHOLD, trees=TREES, recall=RECALL) -> DataFrame:
    """(k_id, k_a, k_b, root, class_id, n_links, kept) of every row: see `join`; root is null for rows without a word, `kept` marks the rows that `keep_one` keeps."""
    sig = durable(signatures(documents, id_col=id_col, text_col=text_col, trees=trees))
    some = sig.where("n > 0")
    # null ids come last
    row = F.struct(F.col("k_id").isNull().alias("none"), "k_id", "k_a", "k_b")
    grouped = some.groupBy("s_hi", "s_lo").agg(F.count("*").alias("copies"), F.min(row).alias("r"), F.first("path").alias("path")).withColumn("first", F.substring("path", 1, 2 * DEPTH))
    sets = _in_order(number_rows(grouped, "first", "s_hi", "s_lo", name="u")[0].drop("first"), trees)
    found, _ = forest(documents, sets, id_col=id_col, text_col=text_col, threshold=threshold, trees=trees, recall=recall)
    member = components(found.select("u", F.col("head").alias("v")))
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    own = sets.select("u", "s_hi", "s_lo", "copies", "r").join(links, "u", "left").join(member, F.col("u") == member["node"], "left")
    own = durable(own.select("s_hi", "s_lo", "r", F.coalesce("component", "u").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = durable(own.groupBy("root").agg(F.min("r").alias("least")))
    own = durable(own.join(least, "root").select("s_hi", "s_lo", "root", "n_links", "least"))
    kept = F.col("k_id").eqNullSafe(F.col("least.k_id")) & (F.col("k_a") == F.col("least.k_a")) & (F.col("k_b") == F.col("least.k_b"))
    with_words = some.select("k_id", "k_a", "k_b", "s_hi", "s_lo").join(own, ["s_hi", "s_lo"]).select("k_id", "k_a", "k_b", "root", F.col("least.k_id").alias("class_id"), "n_links", kept.alias("kept"))
    none = sig.where("n = 0").select("k_id", "k_a", "k_b", F.lit(None).cast("long").alias("root"), F.col("k_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return with_words.unionByName(none)


def join(documents: DataFrame, **options) -> DataFrame:
    """(k_id, k_a, k_b, class_id, n_links) of every row: the least id linked to it, directly or through others, and its partners.

    Two rows are linked if the Jaccard similarity of their shingles reaches the threshold; rows with the same shingles
    (copies, repeated rows) are linked and are compared once for all. Null, empty and blank texts have no links and are
    a class of their own. Null ids come after all others: a class whose ids are all null has a null class_id. An empty
    table gives no rows; very long texts are compared whole; no other column is read. Candidates are never capped: the
    sets of a large node are cut into chunks and every pair of chunks is compared in a task of its own.
    """
    return classed(documents, **options).drop("root", "kept")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links of every document."""
    return join(documents).select(F.col("k_id").alias("doc_id"), "class_id", "n_links")


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each class, with its columns: the least id, of equal ones by the hash of the text; texts without words all stay.

    Rows alike in id and text are one document: one of them stays. Any column names will do; an empty table stays empty.
    """
    rows = durable(classed(documents))
    gone = rows.where("not kept").select("k_id", "k_a", "k_b")
    twice = durable(rows.where("kept and root is not null").groupBy("k_id", "k_a", "k_b").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    x = keyed(documents)
    on = lambda t: x["k_id"].eqNullSafe(t["k_id"]) & (x["k_a"] == t["k_a"]) & (x["k_b"] == t["k_b"])
    gone = fit(gone, 80)
    kept = x.join(gone, on(gone), "left_anti")
    if repeated := twice.count():
        few = fit(twice, 80, repeated)
        single = kept.join(few, on(few), "left_anti")
        kept = single.unionByName(kept.join(few, on(few), "left_semi").dropDuplicates(["k_id", "k_a", "k_b"]))
    return unkeyed(kept, documents)
