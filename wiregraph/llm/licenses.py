"""Licence scan of paragraphs with a trained classifier, in DataFrame operations only.

A paragraph is what stands between blank lines, however its lines are wrapped. Windows of its words are scored by sparse
logistic regression over word 1- and 2-grams, trained on licence notices against a bounded sample of documents, against
notices in reverse and against single words; probabilities are calibrated on templates that were not fitted. Sentences that name a licence without granting it are rows of `unknown`. A family holds in a
window if it is likelier than `unknown` and a template of it is there too: its name as it is, and the template's 2-grams
in order. So a paragraph can hold several families. Every window that has a word of ANCHORS is scored, of every paragraph
of every document; each template has such a word, so no other window can hold one.
"""

from __future__ import annotations

import math
import zlib

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once, row_key, same_key

#: Public names of licence families, and their short identifiers.
NAMES = {
    "agpl": ["gnu affero general public license", "affero gpl"],
    "apache": ["apache license", "apache software license"],
    "bsd": ["bsd license", "bsd 2-clause license", "bsd 3-clause license", "new bsd license", "simplified bsd license", "bsd-style license"],
    "cc-by": ["creative commons attribution license", "cc by 4.0", "cc by 3.0", "creative commons attribution 4.0 international license", "creative commons attribution 3.0 unported license"],
    "cc-by-nc": ["creative commons attribution-noncommercial license", "cc by-nc 4.0", "cc by-nc 3.0", "creative commons attribution-noncommercial 4.0 international license", "creative commons attribution-noncommercial 3.0 unported license"],
    "cc-by-sa": ["creative commons attribution-sharealike license", "cc by-sa 4.0", "cc by-sa 3.0", "creative commons attribution-sharealike 4.0 international license", "creative commons attribution-sharealike 3.0 unported license"],
    "cc0": ["cc0 1.0 universal", "cc0 license", "creative commons zero license"],
    "epl": ["eclipse public license"],
    "eupl": ["european union public licence", "european union public license"],
    "gpl": ["gnu general public license", "gnu gpl"],
    "isc": ["isc license"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license", "gnu lgpl"],
    "mit": ["mit license", "mit expat license"],
    "mpl": ["mozilla public license"],
    "zlib": ["zlib license", "zlib libpng license"],
}
IDENTIFIERS = {
    "agpl": ["agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "agplv3"],
    "apache": ["apache-2.0"],
    "bsd": ["bsd-2-clause", "bsd-3-clause"],
    "cc-by": ["cc-by-4.0", "cc-by-3.0"],
    "cc-by-nc": ["cc-by-nc-4.0", "cc-by-nc-3.0"],
    "cc-by-sa": ["cc-by-sa-4.0", "cc-by-sa-3.0"],
    "cc0": ["cc0-1.0"],
    "epl": ["epl-1.0", "epl-2.0"],
    "eupl": ["eupl-1.1", "eupl-1.2"],
    "gpl": ["gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "gplv2", "gplv3"],
    "isc": ["isc"],
    "lgpl": ["lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0", "lgplv3"],
    "mit": ["mit"],
    "mpl": ["mpl-2.0"],
    "zlib": ["zlib"],
}
#: Sentences of public licence texts and of the notices that go with them; 30 words at most.
NOTICES = {
    "agpl": ["you should have received a copy of the gnu affero general public license along with this program", "under the terms of the gnu affero general public license as published by the free software foundation"],
    "apache": [
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "www.apache.org licenses license-2.0",
        "apache license version 2.0 january 2004 terms and conditions for use reproduction and distribution",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to",
    ],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "dedicated the work to the public domain by waiving all rights to the work worldwide under copyright law"],
    "epl": ["this program and the accompanying materials are made available under the terms of the eclipse public license"],
    "eupl": ["licensed under the eupl version 1.2 or as soon they will be approved by the european commission subsequent versions of the eupl"],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you should have received a copy of the gnu general public license along with this program",
        "gnu general public license version 3 29 june 2007",
        "gnu general public license version 2 june 1991",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "the software is provided as is and the author disclaims all warranties with regard to this software"],
    "lgpl": ["you should have received a copy of the gnu lesser general public license along with this library", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license version 2.0"],
    "proprietary": ["all rights reserved", "no part may be reproduced without prior written permission", "unauthorized copying of this file via any medium is strictly prohibited"],
    "zlib": [
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    ],
}
#: How notices bring a name, and an identifier.
FRAMES = ("licensed under the {}", "licensed under {}", "released under the {}", "distributed under the {}", "published under the {}", "made available under the {}", "provided under the terms of the {}", "this work is licensed under a {}", "this file is licensed under the {}", "subject to the terms of the {}", "governed by the {}")
SHORT_FRAMES = ("spdx-license-identifier {}", "license {}", "licensed under {}", "licensed under the {}", "released under {}", "{} licensed")
#: How other sentences speak of a licence that they do not grant: rows of `unknown` in training.
MENTIONS = ("not licensed under the {}", "never released under the {}", "no longer licensed under the {}", "is not available under the {}", "unlike the {}", "incompatible with the {}", "instead of the {}", "rather than the {}", "an article about the {}", "what is the {}", "the history of the {}", "compared with the {}", "lawyers discuss the {}", "previously under the {}", "neither the {} nor", "did not use the {}", "not covered by the {}", "does not accept the {}", "moved away from the {}", "a book on the {}", "a debate about the {}", "the authors of the {} wrote", "critics of the {} say", "the text of the {} was written", "a violation of the {}")
#: Words of which every template has one: windows without any are not scored.
ANCHORS = sorted(
    {"license", "licenses", "licence", "licensed", "released", "distributed", "published", "available", "provided", "subject", "governed", "spdx-license-identifier", "reserved", "reproduced", "copying"}
    | {"bsd-style", "redistribution", "redistributions", "redistribute", "permission", "warranties", "contributors", "waived", "waiving", "eupl", "mpl", "sublicense", "altered", "gnu", "gpl", "cc", "cc0", "commons"}
)
#: Words that say nothing of a licence alone; 1- and 2-grams of these only are no features.
STOP = frozenset("a all and any are as at be by for form forms free in is it may of on or part person or subject terms the this to under use via with without work you".split())
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Words of a window and between the starts of two: notices of up to 30 words stand whole in one.
WINDOW, STRIDE = 60, 30
#: Documents whose paragraphs are sampled as `unknown`; the least share of a template's 2-grams, in order, that counts as the template.
SAMPLE_DOCUMENTS, FOUND = 400, 0.75
#: Least probability of a family against `unknown`.
SURE = 0.5
#: Weight of a template in training, shared by its parts; other rows weigh 1.
WEIGHT = 24.0
TEMPERATURES = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)
UNKNOWN = "unknown"


def templates() -> list[tuple[str, str, str]]:
    """(family, name that must be there as it is or '', text) of every template."""
    out = [(f, n, frame.format(n)) for f, names in NAMES.items() for n in names for frame in FRAMES]
    out += [(f, n, frame.format(n)) for f, names in IDENTIFIERS.items() for n in names for frame in SHORT_FRAMES]
    out += [(f, n, n) for f, names in NAMES.items() for n in names]  # a title, which the classifier tells from a mention
    # a notice that names its licence must name it: those of related families differ in little else
    return out + [(f, max((n for n in NAMES.get(f, []) if n in t), key=len, default=""), t) for f, texts in NOTICES.items() for t in texts]


FAMILIES = sorted({f for f, _, _ in templates()})


def _hash(gram: str) -> int:
    """What Spark's xxhash64 gives for the string."""
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def _features() -> list[str]:
    found = set()
    for text in [*(t for _, _, t in templates()), *(m.replace("{}", "the") for m in MENTIONS)]:
        words = text.split()
        found |= {w for w in words if w not in STOP} | {f"{a} {b}" for a, b in zip(words, words[1:]) if not (a in STOP and b in STOP)}
    return sorted(found)


def _array(values, kind: str, by: str = ",") -> str:
    """SQL of a constant array, which is folded before it runs."""
    return f"cast(split('{by.join(map(str, values))}', '{by}') as array<{kind}>)"


class _Lookup:
    """SQL that turns an array of words into the sorted ids of its features, by their hashes."""

    def __init__(self, grams: list[str]):
        known = [_hash(g) for g in grams]
        assert len(set(known)) == len(grams)
        self.keys = _array(known, "bigint")

    def of(self, words: str) -> str:
        hashes = f"concat(transform({words}, w -> xxhash64(w)), if(size({words}) < 2, cast(array() as array<bigint>), transform(sequence(0, size({words}) - 2), i -> xxhash64(concat(get({words}, i), ' ', get({words}, i + 1))))))"
        return f"sort_array(array_distinct(transform(filter(transform({hashes}, h -> cast(array_position({self.keys}, h) as int)), p -> p > 0), p -> p - 1)))"


def paragraphs(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k_id, k_a, k_b, paragraph, words): the windows of each paragraph that have an anchor."""
    cut = F.split(F.coalesce(F.col(text_col), F.lit("")), r"\n[\x20\x09-\x0D]*\n")
    x = documents.select(*row_key(id_col, text_col), F.posexplode(cut).alias("paragraph", "p"))
    x = once(x, "all", F.regexp_extract_all(F.lower("p"), F.lit(WORD), F.lit(0))).drop("p")
    anchors = _array(ANCHORS, "string")
    # most paragraphs go before any window is cut
    x = x.where(F.expr(f"arrays_overlap(all, {anchors})"))
    windows = f"filter(transform(sequence(0, greatest(size(all) - 1 - {WINDOW - STRIDE}, 0), {STRIDE}), s -> slice(all, s + 1, {WINDOW})), w -> arrays_overlap(w, {anchors}))"
    return x.select("k_id", "k_a", "k_b", "paragraph", F.explode(F.expr(windows)).alias("words"))


def _shares() -> str:
    """SQL over `joined` (words between blanks) and `likely` (numbers of families): struct(k, share) of each template of these whose name is there."""
    known = templates()
    at = [FAMILIES.index(f) for f, _, _ in known]
    text, name, number = _array([t for _, _, t in known], "string", "/"), _array([f" {n} " if n else " " for _, n, _ in known], "string", "/"), _array(at, "int")
    # places of 2-grams are looked for from the last one on
    found = """aggregate(transform(sequence(0, size(t) - 2), i -> concat(' ', get(t, i), ' ', get(t, i + 1), ' ')), named_struct('at', 1, 'n', 0),
        (a, g) -> if(locate(g, joined, a.at) > 0, named_struct('at', locate(g, joined, a.at) + 1, 'n', a.n + 1), a), a -> a.n / (size(t) - 1))"""
    some = f"filter(sequence(0, {len(known) - 1}), i -> array_contains(likely, get({number}, i)) and contains(joined, get({name}, i)))"
    return f"transform({some}, i -> struct(get({number}, i) as k, element_at(transform(array(split(get({text}, i), ' ')), t -> {found}), 1) as share))"


class Model:
    """Weights of each family and of `unknown` for every feature, with a temperature."""

    def __init__(self, grams, weights, bias, temperature=1.0):
        self.grams, self.weights, self.bias, self.temperature = grams, weights, bias, temperature
        self.lookup = _Lookup(grams)

    def scored(self, df: DataFrame) -> DataFrame:
        """Adds logits (by family, `unknown` last) from the ids."""
        n = len(FAMILIES) + 1
        flat = _array([f"{self.weights[k][i]:.4g}" for i in range(len(self.grams)) for k in range(n)], "double")
        bias = _array([f"{b:.6g}" for b in self.bias], "double")
        return once(df, "logits", F.expr(f"transform(sequence(0, {n - 1}), k -> get({bias}, k) + aggregate(ids, 0.0D, (a, i) -> a + get({flat}, i * {n} + k)))"))

    def judged(self, df: DataFrame) -> DataFrame:
        """(.., family, p, share, confirmed): a row for each family that is likelier than `unknown` in a window; p is its probability among all classes."""
        n = len(FAMILIES)
        odds = f"1 / (1 + exp((get(logits, {n}) - get(logits, k)) / {self.temperature!r}D))"
        share = f"1 / aggregate(logits, 0.0D, (a, z) -> a + exp((z - get(logits, k)) / {self.temperature!r}D))"
        x = self.scored(once(df, "ids", F.expr(self.lookup.of("words"))).where("size(ids) > 0"))
        x = once(x, "likely", F.expr(f"filter(sequence(0, {n - 1}), k -> {odds} >= {SURE!r}D)")).where("size(likely) > 0")
        x = once(x, "joined", F.expr("concat(' ', array_join(words, ' '), ' ')"))
        x = once(x, "shares", F.expr(_shares()))
        x = x.withColumn("k", F.explode("likely")).withColumn("p", F.expr(share)).withColumn("family", F.expr(f"get({_array(FAMILIES, 'string')}, k)"))
        x = once(x, "share", F.expr("coalesce(array_max(transform(filter(shares, s -> s.k = k), s -> s.share)), 0.0D)"))
        return x.withColumn("confirmed", F.col("share") >= FOUND).drop("ids", "logits", "likely", "joined", "shares", "k")


def _cut(words: list[str]) -> list[list[str]]:
    """A notice, and its parts that keep 70 % of the words."""
    n = math.ceil(0.7 * len(words))
    return [words, *([words[i : i + n] for i in range(len(words) - n + 1)] if n < len(words) else [])]


def train(documents: DataFrame, *, id_col="doc_id", text_col="text", sample: int = SAMPLE_DOCUMENTS) -> Model:
    """Fits on the templates and on the paragraphs of `sample` documents: those whose ids hash lowest, by the ids alone.

    Three quarters of the templates, by hash, with all their parts, and of the other rows fit weights with which the rest
    chooses the temperature of least log loss, so that probabilities, that of `unknown` included, mean what they say on
    texts that were not fitted. Then all rows fit the weights.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    spark: SparkSession = documents.sparkSession
    grams, unknown = _features(), len(FAMILIES)
    model = Model(grams, [[0.0] * len(grams)] * (unknown + 1), [0.0] * (unknown + 1))
    made = []
    for f, _, text in dict.fromkeys(templates()):
        words, fit = text.split(), zlib.crc32(text.encode()) % 4 != 0
        parts = _cut(words)
        made += [(FAMILIES.index(f), part, fit, WEIGHT / len(parts)) for part in parts] + [(unknown, words[::-1], fit, 1.0)]
    made += [(unknown, [g], zlib.crc32(g.encode()) % 4 != 0, 1.0) for g in grams if " " not in g and g not in {i for x in IDENTIFIERS.values() for i in x}]
    made += [(unknown, frame.format(n).split(), zlib.crc32(frame.format(n).encode()) % 4 != 0, 1.0) for names in NAMES.values() for n in names for frame in MENTIONS]
    made += [(unknown, ["."], bool(i % 4), 1.0) for i in range(20)]
    known = spark.createDataFrame(made, "label int, words array<string>, fit boolean, weight double")
    few = documents.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(F.col(id_col)), id_col).limit(sample)
    texts = documents.select(id_col, text_col).join(F.broadcast(few), id_col, "left_semi")  # `sample` ids
    free = paragraphs(texts, id_col, text_col).select("words").distinct().withColumn("joined", F.expr("concat(' ', array_join(words, ' '), ' ')"))
    # sampled notices are no negatives
    free = free.withColumn("likely", F.expr(f"sequence(0, {unknown - 1})")).withColumn("share", F.expr(f"array_max(transform({_shares()}, s -> s.share))")).where("share is null or share < 0.5")
    rows = known.unionByName(free.select(F.lit(unknown).alias("label"), "words", (F.pmod(F.xxhash64("words"), F.lit(4)) != 0).alias("fit"), F.lit(1.0).alias("weight")))
    rows = once(rows, "ids", F.expr(model.lookup.of("words"))).repartition(2).cache()  # bounded by `sample`; each iteration is a job
    vector = array_to_vector(F.expr(f"transform(sequence(0, {len(grams) - 1}), i -> if(array_contains(ids, i), 1.0D, 0.0D))"))

    def fit(some: DataFrame) -> None:
        f = LogisticRegression(family="multinomial", regParam=0.0003, elasticNetParam=0.1, maxIter=60, standardization=False, weightCol="weight").fit(some.select(F.col("label").cast("double"), "weight", vector.alias("features")))
        model.weights, model.bias = [list(map(float, r)) for r in f.coefficientMatrix.toArray()], [float(b) for b in f.interceptVector.toArray()]

    fit(rows.where("fit"))
    held = model.scored(rows.where("not fit"))
    loss = [F.expr(f"avg(ln(aggregate(logits, 0.0D, (a, z) -> a + exp((z - get(logits, label)) / {t!r}D))))").alias(f"t{k}") for k, t in enumerate(TEMPERATURES)]
    found = held.agg(*loss).first()
    losses = [math.inf if found[k] is None else found[k] for k in range(len(TEMPERATURES))]
    model.temperature = TEMPERATURES[losses.index(min(losses))]
    fit(rows)
    rows.unpersist()
    return model


def scan(documents: DataFrame, model: Model | None = None, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(k_id, k_a, k_b, paragraph, family, p, share, confirmed) of every paragraph and licence family likelier than `unknown` in it.

    Null and empty texts have none; rows alike in id and text are reported alike, once; paragraphs of any length are cut
    into windows and scored whole. An empty table gives no rows; other columns are not read.
    """
    model = model or train(documents, id_col=id_col, text_col=text_col)
    found = model.judged(paragraphs(documents, id_col, text_col))
    best = F.max(F.struct("confirmed", "p", "share"))
    return found.groupBy("k_id", "k_a", "k_b", "paragraph", "family").agg(best.alias("b")).select("k_id", "k_a", "k_b", "paragraph", "family", "b.p", "b.share", "b.confirmed")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, families (confirmed, sorted, comma-joined) and counts of licence paragraphs of every document."""
    found = scan(documents).groupBy("k_id", "k_a", "k_b").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.countDistinct(F.when(F.col("confirmed"), F.col("paragraph"))).alias("n_licence"),
        F.countDistinct(F.when(~F.col("confirmed"), F.col("paragraph"))).alias("n_unconfirmed"),
    )
    cut = F.split(F.coalesce("text", F.lit("")), r"\n[\x20\x09-\x0D]*\n")
    docs = documents.select(*row_key("doc_id", "text"), F.size(F.filter(cut, lambda x: x != "")).cast("long").alias("n_paragraphs"))
    joined = docs.join(found, same_key(docs, found), "left")
    return joined.select(docs["k_id"].alias("doc_id"), "n_paragraphs", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_licence", F.lit(0)).alias("n_licence"), F.coalesce("n_unconfirmed", F.lit(0)).alias("n_unconfirmed"))
