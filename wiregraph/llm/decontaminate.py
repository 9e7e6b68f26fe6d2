"""Benchmark decontamination by winnowing, in DataFrame operations only.

Schleimer, Wilkerson and Aiken, "Winnowing: Local Algorithms for Document Fingerprinting" (2003): the least
k-gram hash of each window of w consecutive k-grams is kept, so two texts that share a span of k + w - 1 words
share a fingerprint there. Windows of m words take k = min(5, m) and w = m - k + 1, which meets every one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, ascii_lower, durable, fit, keyed, row_key, same_key, unkeyed

WINDOW = 10
#: Bits of the prefilter: 8 a fingerprint, within these bounds (the literal stays below 1 MB).
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(ALNUM_WORD), F.lit(0))


def _lengths(m: int) -> tuple[int, int]:
    k = min(5, m)
    return k, m - k + 1


def _grams(k: int) -> str:
    """SQL: hashes of all k-grams of `words`, in order."""
    args = ", ".join(f"get(words, i + {j})" for j in range(k))
    return f"if(size(words) < {k}, cast(array() as array<bigint>), transform(sequence(0, size(words) - {k}), i -> xxhash64({args})))"


def _selected(w: int, grams: str) -> str:
    """SQL predicate on i: the i-th hash of `grams` is the least of one of the windows of w hashes that hold it."""
    lo, hi = f"greatest(i - {w - 1}, 0)", f"least(i, size({grams}) - {w})"
    return f"size({grams}) >= {w} and exists(sequence({lo}, {hi}), s -> get({grams}, i) = array_min(slice({grams}, s + 1, {w})))" if w > 1 else "true"


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(n, m, win): each different window of the items with a number and its length in words; and (n, item) of the items that have it."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("words")).where("size(words) > 0").withColumn("m", F.least(F.size("words"), F.lit(window)))
    held = durable(items.select("item", "m", F.explode(F.expr("transform(sequence(0, size(words) - m), i -> array_join(slice(words, i + 1, m), ' '))")).alias("win")).distinct())
    wins = durable(held.select("m", "win").distinct().withColumn("n", F.monotonically_increasing_id()))
    return wins, durable(held.join(wins, ["m", "win"]).select("n", "item"))


def _bitmap(prints: DataFrame, n: int) -> tuple[str, int]:
    """SQL: the fingerprints in an array of 64-bit words, and its number of bits, which is bounded."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 8 * n):
        bits *= 2
    cells = {r["c"]: r["b"] for r in prints.groupBy(F.expr(f"cast(pmod(h, {bits}) div 64 as int)").alias("c")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(h, 64) as int)))").alias("b")).collect()}
    return "cast(split('" + ",".join(str(cells.get(c, 0)) for c in range(bits // 64)) + "', ',') as array<bigint>)", bits


def hits(documents: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window=WINDOW) -> tuple[DataFrame, DataFrame]:
    """(k_id, k_a, k_b, start, m, n): every occurrence of a benchmark window, numbered n, in a document; and (n, item) of its items.

    The occurrence covers the document's words start .. start + m - 1. One scan of the documents makes the grams for
    windows of every length. Fingerprints of documents that cannot be in the benchmark are dropped by a bitmap of bounded
    size before rows are made of them; then fingerprints join and each hit is extended to the windows around it, whose
    words are compared. No empty or null text has hits.
    """
    spark = documents.sparkSession
    wins, of_item = benchmark_windows(benchmark, item_col, item_text_col, window)
    sizes = wins.groupBy("m").agg(F.count("*").alias("n"), F.sum(F.octet_length("win") + 80).alias("b")).collect()  # a row a length
    if not sizes:
        return spark.createDataFrame([], "k_id long, k_a long, k_b long, start int, m int, n long"), of_item
    ms, n_wins = sorted(r["m"] for r in sizes), sum(r["n"] for r in sizes)
    # a window of m words has exactly one winnowing window: its fingerprint is the least of its grams
    least = F.coalesce(*[F.when(F.col("m") == m, F.array_min(F.expr(_grams(_lengths(m)[0])))) for m in ms])
    prints = durable(wins.select("m", F.split("win", " ").alias("words")).select("m", least.alias("h")).distinct())
    bitmap, bits = _bitmap(prints, n_wins)
    docs = documents.select(*row_key(id_col, text_col), words(F.col(text_col)).alias("words"))
    ks = sorted({_lengths(m)[0] for m in ms})
    grams = docs.select("*", *[F.expr(_grams(k)).alias(f"g{k}") for k in ks])
    # the bitmap first, then the choice of the least hash: few grams are left to compare
    near = lambda k: f"getbit(get({bitmap}, cast(pmod(get(g{k}, i), {bits}) div 64 as int)), cast(pmod(get(g{k}, i), 64) as int)) = 1"
    places = grams.select("*", *[F.expr(f"if(size(g{k}) = 0, cast(array() as array<int>), filter(sequence(0, size(g{k}) - 1), i -> {near(k)}))").alias(f"p{k}") for k in ks])

    def at(m: int) -> str:
        k, w = _lengths(m)
        lo = f"greatest(i - {m - k}, 0)"
        return f"transform(filter(p{k}, i -> {_selected(w, f'g{k}')}), i -> struct({m} as m, get(g{k}, i) as h, {lo} as lo, slice(words, {lo} + 1, i + {m} - {lo}) as near))"

    found = places.select("k_id", "k_a", "k_b", F.explode(F.expr(f"concat({', '.join(map(at, ms))})")).alias("f")).select("k_id", "k_a", "k_b", "f.*")
    matched = found.join(fit(prints, 40, n_wins), ["m", "h"])
    # every span of m words around the shared gram
    spans = matched.select("k_id", "k_a", "k_b", "m", F.explode(F.expr("transform(sequence(0, size(near) - m), j -> struct(cast(lo + j as int) as start, array_join(slice(near, j + 1, m), ' ') as win))")).alias("s")).select("k_id", "k_a", "k_b", "m", "s.*").distinct()
    known = fit(wins, sum(r["b"] for r in sizes) // n_wins + 1, n_wins)
    return spans.join(known, ["m", "win"]).select("k_id", "k_a", "k_b", "start", "m", "n"), of_item


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", window=WINDOW, **columns) -> DataFrame:
    """Every row of `documents` with n_words, n_hit (words within a benchmark window), item_ids (sorted) and contaminated.

    Rows alike in id and text are judged alike and all kept; null and empty texts have no words; an empty benchmark
    hits nothing; clashing column names cannot arise, as only the id is carried. Items join once for each window that a
    document has, however often it occurs there; a null item id counts as an empty one.
    """
    key = ["k_id", "k_a", "k_b"]
    found, of_item = hits(documents, benchmark, id_col=id_col, text_col=text_col, window=window, **columns)
    hit = durable(found.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("start", "m"))).alias("spans"), F.collect_set("n").alias("wins")))
    covered = "aggregate(spans, named_struct('n', 0L, 'end', 0), (a, s) -> named_struct('n', a.n + greatest(s.start + s.m - greatest(s.start, a.end), 0), 'end', greatest(a.end, s.start + s.m)), a -> a.n)"
    weight = of_item.agg(F.count("*").alias("n"), F.sum(F.octet_length("item") + 60).alias("b")).first()
    few = fit(of_item, weight["b"] // weight["n"] + 1 if weight["n"] else 1, weight["n"])
    items = hit.select(*key, F.explode("wins").alias("n")).join(few, "n").groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    hit = hit.select(*key, F.expr(covered).alias("n_hit"))
    per_doc = hit.join(items, same_key(hit, items)).select(*[hit[c] for c in key], "n_hit", "item_ids")
    docs = documents.select(*row_key(id_col, text_col), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    joined = docs.join(per_doc, same_key(docs, per_doc), "left").select(docs["k_id"].alias(id_col), docs["k_a"], docs["k_b"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return joined.withColumn("contaminated", F.col("n_hit") > 0)


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of `decontaminate` for each document."""
    return decontaminate(documents, benchmark).select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `documents` that hold no benchmark window, with their columns.

    Null and empty texts stay, as do all rows if the benchmark is empty; repeated rows stay or go together; texts of any
    length are read whole; any column names will do; an empty table stays empty.
    """
    bad = durable(hits(documents, benchmark)[0].select("k_id", "k_a", "k_b").distinct())
    x, bad = keyed(documents), fit(bad, 80)
    return unkeyed(x.join(bad, x["k_id"].eqNullSafe(bad["k_id"]) & (x["k_a"] == bad["k_a"]) & (x["k_b"] == bad["k_b"]), "left_anti"), documents)


#: DuckDB: the contract written out plainly.
ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
wins as (select distinct item_id, m, array_to_string(w[s:s + m - 1], ' ') win from (select item_id, w, m, unnest(range(1, len(w) - m + 2)) s from (select *, least(len(w), 10) m from i where len(w) > 0))),
dw as (select doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') win from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) s from d, (select distinct m from wins) where len(w) >= m)),
h as (select doc_id, s, m, item_id from dw join wins using (m, win)),
n as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + m)) p from h) group by doc_id),
t as (select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from h group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join n using (doc_id) left join t using (doc_id)
"""
