"""Line deduplication with a log-template tree of fixed depth.

After He et al., "Drain: An Online Log Parsing Approach with Fixed Depth Tree" (2017): a line goes down the tree by its
number of tokens and then its leading tokens; tokens with a digit are masked. Within a leaf lines are grouped by the
tokens they agree in: a token that stands at its place in MIN_DOCS documents of the leaf is constant, the others are
variable fields, and lines with the same constants form a pattern. A pattern that is rare by itself joins those that
differ from it in one constant more. A pattern in MIN_DOCS documents is a template, as is a long line that recurs as it
is in a few; both stay only in the first of their documents. Counts alone decide, so the order of lines does not matter.

Only leaves and long lines that recur are looked into: a first pass counts them, a bitmap of fixed size keeps most other
lines from leaving the second, and exact joins decide. Hot leaves and lines are split by every aggregation and skew join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fit, keyed, once, row_key

#: Documents from which on a template recurs, and leading tokens of the tree.
MIN_DOCS, LEADING = 10, 3
#: Least share of the tokens of a line that are constant.
AGREE = 0.7
#: Least tokens of a long line -> documents from which on it recurs as it is; the most tokens first.
LONG = {50: 2, 20: 4}
#: Bits of the filter on recurring leaves and lines; where they fill up, more lines reach the exact join.
BITS = 1 << 22
_DIGIT = re.compile(rb"[0-9]")
VARIABLE = b"<*>"
KEY = ["k_id", "k_a", "k_b"]


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def masked(line: bytes) -> list[bytes]:
    """The tokens of a line, those with a digit masked."""
    tokens = line.split()
    return [VARIABLE if _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens


def keys_of(line: bytes, tokens: list[bytes]) -> tuple[int, int | None, int]:
    """(leaf, key of the line as it is or None if it is not long, documents from which on the latter recurs)."""
    n = len(tokens)
    need = next((docs for least, docs in LONG.items() if n >= least), 0)
    return _hash(b"%d %s" % (n, b" ".join(tokens[:LEADING]))), _hash(b"=" + b" ".join(line.split())) if need else None, need


def _scan(documents: DataFrame, id_col: str, text_col: str, of_text, schema: str) -> DataFrame:
    """The row key and what `of_text` (bytes of a text to rows) gives, by columns of the schema."""
    names = [x.split()[0] for x in schema.split(", ")]
    kind = documents.schema[id_col].dataType.simpleString()
    types = [pa.int64() if x.endswith(" long") else pa.int32() if x.endswith(" int") else pa.list_(pa.int64()) for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(batch, at, rows):
            own = [pa.array(x, t) for x, t in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(at, pa.int64())) for k in KEY] + own, [*KEY, *names])

        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for d, text in enumerate(batch.column("t")):
                found = of_text(text.as_py() or b"")
                rows += found
                at += [d] * len(found)
                if len(rows) > 20_000:
                    yield table(batch, at, rows)
                    at, rows = [], []
            if rows:
                yield table(batch, at, rows)

    return documents.select(*row_key(id_col, text_col), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"k_id {kind}, k_a long, k_b long, {schema}")


def _recurring(documents: DataFrame, id_col: str, text_col: str, min_docs: int) -> DataFrame:
    """(key): leaves, and long lines as they are, in as many documents as a template needs."""

    def of_text(text: bytes) -> list[tuple]:
        found: dict[int, int] = {}
        for line in text.split(b"\n"):
            if tokens := masked(line):
                leaf, exact, need = keys_of(line, tokens)
                found[leaf] = min_docs
                if exact is not None:
                    found[exact] = min(need, min_docs)
        return list(found.items())

    keys = _scan(documents, id_col, text_col, of_text, "key long, need int").select("key", "need")
    return durable(keys.groupBy("key").agg(F.count("*").alias("docs"), F.max("need").alias("need")).where("docs >= need").select("key"))


def _bitmap(keys: DataFrame) -> np.ndarray:
    """BITS bits, of which those of the keys are set: the same size for any input."""
    cell = F.expr(f"cast(pmod(key, {BITS}) div 64 as int)")
    cells = keys.groupBy(cell.alias("c")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(key, 64) as int)))").alias("b")).collect()
    out = np.zeros(BITS // 64, np.int64)
    for r in cells:
        out[r["c"]] = r["b"]
    return out.view(np.uint64)


def _suspects(documents: DataFrame, id_col: str, text_col: str, hot: DataFrame) -> DataFrame:
    """(row key, place, leaf, exact, line, tokens): lines whose leaf or own key may recur, with hashes of their masked tokens."""
    bits = _bitmap(hot)

    def of_text(text: bytes) -> list[tuple]:
        out = []
        for i, line in enumerate(text.split(b"\n")):
            if tokens := masked(line):
                leaf, exact, _ = keys_of(line, tokens)
                if any(k is not None and int(bits[k % BITS // 64]) >> k % 64 & 1 for k in (leaf, exact)):
                    out.append((i, leaf, exact, _hash(b" ".join(tokens)), [_hash(t) for t in tokens]))
        return out

    return durable(_scan(documents, id_col, text_col, of_text, "place int, leaf long, exact long, line long, tokens array<long>"))


def _with(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Inner join with a table of keys, broadcast if small, else split by skew joins."""
    return df.join(fit(keys, 24 + 16 * len(keys.columns)), list(on))


def patterns(suspects: DataFrame, hot: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(leaf, line, pattern) of the lines with a pattern, and (pattern, first_id) of the patterns that belong to a template."""
    leaves = suspects.select("leaf").distinct().join(hot.withColumnRenamed("key", "leaf"), "leaf", "left_semi")
    held = durable(_with(suspects, durable(leaves), "leaf").groupBy("leaf", "line", *KEY).agg(F.first("tokens").alias("tokens")))
    lines = durable(held.groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.first("tokens").alias("tokens")))
    placed = lines.select("leaf", "line", "docs", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "token"))
    constants = durable(placed.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("leaf", "at", "token"))
    fixed = durable(_with(placed, constants, "leaf", "at", "token").select("leaf", "line", "n", "at", F.xxhash64("at", "token").alias("h")))
    whole = fixed.groupBy("leaf", "line").agg(F.first("n").alias("n"), F.count("*").alias("c"), F.expr("bit_xor(h)").alias("x")).where(F.col("c") >= AGREE * F.col("n"))
    whole = durable(whole.withColumn("pattern", F.xxhash64("leaf", "x", "c")))
    of_line = whole.select("leaf", "line", "pattern")
    found = _with(held.select("leaf", "line", *KEY), of_line, "leaf", "line")
    known = durable(found.groupBy("pattern").agg(F.countDistinct(F.struct(*KEY)).alias("docs"), F.min("k_id").alias("first_id")))
    # each pattern as it is and without one of its constants, the leading tokens aside: rare ones meet what they share most with
    one = _with(fixed.where(F.col("at") >= LEADING), whole.select("leaf", "line", "x", "c", "pattern"), "leaf", "line").where(F.col("c") - 1 >= AGREE * F.col("n"))
    one = one.select("pattern", F.xxhash64("leaf", F.col("x").bitwiseXOR(F.col("h")), F.col("c") - 1).alias("wide"))
    one = durable(one.unionByName(whole.select("pattern", F.col("pattern").alias("wide"))).distinct())
    merged = one.join(known, "pattern").groupBy("wide").agg(F.sum("docs").alias("docs"), F.min("docs").alias("least"))
    merged = durable(merged.where((F.col("docs") >= min_docs) & (F.col("least") < min_docs)).select("wide"))
    of_wide = durable(_with(one, merged, "wide"))
    counted = _with(found, of_wide, "pattern").groupBy("wide").agg(F.countDistinct(F.struct(*KEY)).alias("docs"), F.min("k_id").alias("first_id")).where(F.col("docs") >= min_docs)
    both = known.where(F.col("docs") >= min_docs).select("pattern", "first_id").unionByName(of_wide.join(counted, "wide").select("pattern", "first_id"))
    return of_line, durable(both.groupBy("pattern").agg(F.min("first_id").alias("first_id")))


def dropped_lines(documents: DataFrame, *, id_col="doc_id", text_col="text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(k_id, k_a, k_b, places): the numbers of the lines of each document that recur, but in their first document."""
    hot = _recurring(documents, id_col, text_col, min_docs)
    suspects = _suspects(documents, id_col, text_col, hot)
    exact = suspects.where("exact is not null").join(fit(hot.withColumnRenamed("key", "exact"), 40), "exact", "left_semi")
    firsts = durable(exact.groupBy("exact").agg(F.min("k_id").alias("first_id")))
    as_is = _with(exact, firsts, "exact").where("not (k_id <=> first_id)").select(*KEY, "place")
    of_line, templates = patterns(suspects, hot, min_docs)
    recurring = durable(_with(of_line, templates, "pattern").select("leaf", "line", "first_id"))
    alike = _with(suspects, recurring, "leaf", "line").where("not (k_id <=> first_id)").select(*KEY, "place")
    return as_is.unionByName(alike).groupBy(*KEY).agg(F.sort_array(F.collect_set("place")).alias("places"))


def dedup(documents: DataFrame, *, id_col="doc_id", text_col="text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Every row of documents with its columns, the text without recurring lines, and n_lines and n_dropped.

    Blank lines stay where they are. Null texts stay null and have no lines; empty ones have one, blank. A row whose id is
    the least of a template's documents keeps it, as do rows repeated with that id; ids that are all null keep it too.
    Rows alike in id and text count as one document and are treated alike. A line of any length is parsed whole; one whose
    leading tokens vary without a digit is in another leaf and belongs to no template of this one. Lines with fewer than
    AGREE of their tokens constant are none's. An empty table gives no rows; columns may have any names but n_lines and
    n_dropped, with which it is a ValueError.
    """
    if clash := {"n_lines", "n_dropped"}.intersection(documents.columns):
        raise ValueError(f"columns of the result: {sorted(clash)}")
    docs = keyed(documents, id_col, text_col)
    gone = dropped_lines(documents, id_col=id_col, text_col=text_col, min_docs=min_docs)
    gone = gone.hint("merge")  # it grows with the documents, so it is never broadcast
    x = docs.join(gone, docs["k_id"].eqNullSafe(gone["k_id"]) & (docs["k_a"] == gone["k_a"]) & (docs["k_b"] == gone["k_b"]), "left")
    own = documents.columns.index(text_col)
    text = F.col(f"c_{own}")
    x = once(x, "lines", F.split(F.coalesce(text, F.lit("")), "\n"))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), places), i -> get(lines, i)), '\n')")
    x = once(x, "kept", F.when(F.col("places").isNull(), text).otherwise(kept))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size("lines")).cast("long")
    columns = [(F.col("kept") if i == own else F.col(f"c_{i}")).alias(c) for i, c in enumerate(documents.columns)]
    return x.select(*columns, n_lines.alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hash of the text that is left, for every document."""
    return dedup(documents.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def without_repeats(documents: DataFrame) -> DataFrame:
    """Documents without recurring lines; one that had lines with words and has none left goes, as all of it stands in others.

    Null, empty and very long texts, repeated rows and empty tables as in `dedup`; any column names will do.
    """
    columns = documents.columns
    named = documents.toDF(*[f"d_{i}" for i in range(len(columns))])
    text = f"d_{columns.index('text')}"
    x = dedup(named, id_col=f"d_{columns.index('doc_id')}", text_col=text)
    left = x.where(~((F.col("n_dropped") > 0) & ~F.col(text).rlike(r"[^\x20\x09-\x0D]")))
    return left.select(*[F.col(f"d_{i}").alias(c) for i, c in enumerate(columns)])
