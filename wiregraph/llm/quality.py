"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Each rule rejects a document whose rate exceeds a cutoff. Settings of all rules together are tested in fixed sequences,
from lax to strict: path k of a stratum has the k rules that reject most labelled bad documents, and at each step all of
them take the next cutoff, or the laxest one that rejects as many bad documents. Paths depend on bad documents alone, so
the tests on good ones are of fixed settings. A setting is certified if an exact binomial test on labelled good
documents rejects "more than alpha of good documents would be lost by any rule", at level delta / (strata x rules), for
it and for all laxer ones of its path: no correction over cutoffs. Of the certified settings, the one that rejects most
labelled bad documents is used, the laxest of equals; without a certified one no rule is on in that stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, durable, fit

#: Rule -> rate in tenths of a percent, over the columns of `features`.
RULES = {
    "symbols": "1000 * n_symbols div greatest(n_words, 1)",
    "exclamations": "1000 * n_exclaims div greatest(n_words, 1)",
    "duplicate_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeated_words": "1000 * n_repeat_words div greatest(n_words, 1)",
}
CUTOFFS = (20, 50, 100, 150, 200, 300, 400, 500, 700)
ALPHA, DELTA = 0.02, 0.05
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclaims", "n_lines"]


def with_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the counts in FEATURES (long) of every whole text; a null text has none of anything."""
    keep = [F.col(c) for c in df.columns]
    text = F.coalesce(F.col(text_col), F.lit(""))
    removed = lambda chars: (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")
    word = r"[^" + SPACES[1:]
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(word))
    x = df.select(*keep, F.regexp_extract_all(text, F.lit(word), F.lit(0)).alias("_words"), lines.alias("_lines"), removed("#*$%&|<>").alias("n_symbols"), removed("!").alias("n_exclaims"))
    gram = ", ".join(f"get(_words, i + {j})" for j in range(5))
    grams = F.expr(f"if(size(_words) < 6, cast(array() as array<bigint>), transform(sequence(0, size(_words) - 5), i -> xxhash64({gram})))")
    x = x.select(*keep, "n_symbols", "n_exclaims", F.size("_words").cast("long").alias("n_words"), F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"), F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), grams.alias("_grams"))
    # most texts repeat no window; only the others are sorted
    sorted_ = F.expr("if(size(array_distinct(_grams)) = size(_grams), cast(array() as array<struct<h: bigint, i: int>>), sort_array(transform(_grams, (h, i) -> struct(h, i))))")
    names = [*df.columns, "n_symbols", "n_exclaims", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    x = x.select(*names, sorted_.alias("_sorted"))
    twice = "sort_array(transform(filter(_sorted, (s, j) -> s.h = get(_sorted, j - 1).h or s.h = get(_sorted, j + 1).h), s -> s.i))"
    covered = f"aggregate({twice}, named_struct('n', 0L, 'end', 0), (a, i) -> named_struct('n', a.n + i + 5 - greatest(i, a.end), 'end', i + 5), a -> a.n)"
    return x.select(*names, F.expr(covered).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _log_tail(alpha: float) -> str:
    """SQL: log of P(at most k of n), each with probability alpha, summed exactly term by term in logarithms."""
    step = f"x.t + ln((n - i + 1) / i) + ln({alpha!r}D / {1 - alpha!r}D)"
    return f"""if(k >= {alpha!r}D * n, 0.0D, aggregate(if(k = 0, cast(array() as array<bigint>), sequence(1L, k)), named_struct('t', n * ln({1 - alpha!r}D), 's', n * ln({1 - alpha!r}D)),
        (x, i) -> named_struct('t', {step}, 's', greatest(x.s, {step}) + ln(1.0D + exp(-abs(x.s - ({step}))))), x -> x.s))"""


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", *, alpha: float = ALPHA, delta: float = DELTA, id_col="doc_id") -> DataFrame:
    """(stratum, one column per rule: cutoff or null): the certified cutoffs.

    `measured` has FEATURES and the stratum; `labels` (id, quality 0/1) is a holdout: no rule or rate was fitted to it.
    A null stratum counts as ''; without labels there are no rows. With a column text_key, texts alike in it count once
    in a stratum for each label that they have, since copies are no independent trials; without it every row counts.
    """
    known = labels.where("quality is not null").select(id_col, "quality")
    rates = [F.expr(e).alias(r) for r, e in RULES.items()]
    copy = ["text_key"] if "text_key" in measured.columns else []
    judged = measured.where(~base_failed()).select(id_col, F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), *copy, *rates).join(known, id_col).drop(id_col)
    judged = durable(judged.dropDuplicates([*copy, "stratum", "quality"]).drop(*copy) if copy else judged)
    strict = sorted(CUTOFFS, reverse=True)
    numbered = judged.select("stratum", "quality", F.expr("stack(" + str(len(RULES)) + ", " + ", ".join(f"{i}, {r}" for i, r in enumerate(RULES)) + ") as (rule, rate)"))
    bad = numbered.groupBy("stratum", "rule").agg(F.array(*[F.count_if((F.col("rate") > c) & (F.col("quality") == 0)) for c in strict]).alias("bad"))
    cuts = "array(" + ", ".join(map(str, strict)) + ")"
    steps = bad.select("stratum", "rule", F.expr("aggregate(bad, 0L, (a, b) -> a + b)").alias("weight"), F.expr(f"transform(bad, b -> if(b = 0, null, get({cuts}, cast(array_position(bad, b) as int) - 1)))").alias("steps"))
    steps = steps.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("weight"), "rule")))
    of = lambda i, c: F.max(F.when(F.col("rule") == i, F.col(c)))
    paths = durable(steps.groupBy("stratum").agg(*[of(i, c).alias(f"{c}_{r}") for i, r in enumerate(RULES) for c in ("place", "steps")]))
    strata = paths.count()
    # steps of each path that a document gets through
    through = ", ".join(f"if(place_{r} <= path, size(filter(steps_{r}, c -> c is null or {r} <= c)), {len(strict)})" for r in RULES)
    x = judged.join(fit(paths, 600, strata), "stratum").withColumn("path", F.explode(F.sequence(F.lit(1), F.lit(len(RULES))))).withColumn("through", F.expr(f"least({through})"))
    lost = [F.count_if((F.col("through") <= i) & (F.col("quality") == q)).alias(f"{name}{i}") for i in range(len(strict)) for name, q in (("k", 1), ("b", 0))]
    counts = x.groupBy("stratum", "path").agg(F.count_if(F.col("quality") == 1).alias("n"), *lost)
    tests = counts.select("stratum", "path", "n", F.expr("stack(" + str(len(strict)) + ", " + ", ".join(f"{i}, k{i}, b{i}" for i in range(len(strict))) + ") as (step, k, bad)"))
    level = math.log(delta / max(1, strata * len(RULES)))
    tests = tests.withColumn("passed", (F.col("n") > 0) & (F.expr(_log_tail(alpha)) <= F.lit(level)))
    sure = tests.withColumn("passed", F.min("passed").over(Window.partitionBy("stratum", "path").orderBy("step"))).where("passed and bad > 0")
    best = sure.groupBy("stratum").agg(F.max(F.struct("bad", -F.col("path"), -F.col("step"))).alias("b")).select("stratum", (-F.col("b.col2")).alias("path"), (-F.col("b.col3")).alias("step"))
    return best.join(paths, "stratum").select("stratum", *[F.expr(f"if(place_{r} <= path, get(steps_{r}, step), null)").alias(f"cut_{r}") for r in RULES])


def judge(measured: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """`measured` with base_failed and kept; a stratum or rule without a cutoff rejects nothing."""
    cuts = fit(cuts.withColumnRenamed("stratum", "_stratum"), 100)
    x = measured.withColumn("base_failed", base_failed())
    x = x.join(cuts, F.coalesce(x[stratum], F.lit("")) == cuts["_stratum"], "left")
    broken = F.lit(False)
    for r, e in RULES.items():
        broken = broken | F.coalesce(F.expr(e) > F.col(f"cut_{r}"), F.lit(False))
    return x.withColumn("kept", ~F.col("base_failed") & ~broken).drop("_stratum", *[f"cut_{r}" for r in RULES])


def _measured(documents: DataFrame) -> DataFrame:
    """The counts of every document under c_0, c_1, ..., with doc_id, lang and the hash of its text."""
    named = documents.toDF(*[f"c_{i}" for i in range(len(documents.columns))])
    own = lambda c: F.col(f"c_{documents.columns.index(c)}")
    return with_features(named.select("*", own("doc_id").alias("doc_id"), own("lang").alias("lang"), F.xxhash64(F.coalesce(own("text"), F.lit(""))).alias("text_key")), f"c_{documents.columns.index('text')}")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every document; the texts are read once, their counts kept as a narrow table.

    Null and empty texts have no words and fail the base; repeated rows are judged each; texts of any length are read
    whole; an empty table gives no rows; other columns are not read.
    """
    measured = durable(_measured(documents.select("doc_id", "text", "lang")).drop("c_0", "c_1", "c_2"))
    return judge(measured, durable(cutoffs(measured, labels))).select("doc_id", *FEATURES[:5], "base_failed", "kept")


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that the rules keep, with their columns; any column names will do, other cases as in `report`."""
    measured = durable(_measured(documents))
    return judge(measured, durable(cutoffs(measured, labels))).where("kept").select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(documents.columns)])
