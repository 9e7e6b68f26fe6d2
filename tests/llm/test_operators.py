"""Each operator against a plain version, on texts with nulls, blanks, ties, repeats, long words and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wiregraph.llm import bpe, class_lm, components, decontaminate, licenses, lines, ngram_join, quality, sharding, substrings, urls

EXTRA = ("k", "w", "y", "z", "u")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k_id string, words string, _id string, c_0 string, lines string"


def texts():
    random.seed(5)
    pool = ["the", "of", "and", "Zebra", "quick", "Über", "ción", "año", "row", "x1", "42", "a-b", "中文"]
    some = [" ".join(random.choice(pool) + random.choice(["", ",", "."]) for _ in range(random.randint(1, 90))) for _ in range(40)]
    out = [*some, None, "", " \n\t ", "word", "a" * 3000, "ab " * 700, some[3], some[3] + " tail", some[4].replace("the", "teh", 1), "x\n" * 30, "All rights reserved.\nfoo"]
    out += [f"boiler plate line number {i} of this very site footer here\n{some[i % 40]}" for i in range(15)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, "s", 1, *EXTRA) for i, t in enumerate(texts())]
    rows += [rows[7], (None, texts()[5], "de", "s", 1, *EXTRA), (3, "other text under an id already used", "en", "s", 1, *EXTRA)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_sharding(docs, empty):
    for n in (1, 2, 5, 64, 1000):
        assert sorted(sharding.permute(np.arange(n), n, 3)) == list(range(n))
    got = sharding.shard_documents(docs, 7).collect()
    count = Counter(r["shard"] for r in got)
    assert len(got) == docs.count() and max(count.values()) - min(count.values()) <= 1
    for s, n in count.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    again = sharding.shard_documents(docs.repartition(2), 7).collect()
    key = lambda x: Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in x)
    assert key(got) == key(again)
    text = {(r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 16) for r in docs.collect()}
    assert {(r["doc_id"], r["text_crc32"], r["size"]) for r in got} == text
    assert sharding.shard_documents(empty).count() == 0
    odd = docs.selectExpr("doc_id", "text as part", "lang as at", "source as start")
    assert sharding.shard(odd, ["doc_id"], 3).columns[:4] == odd.columns
    with pytest.raises(ValueError, match="shard"):
        sharding.shard(odd.withColumnRenamed("at", "shard"), ["doc_id"], 3)


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def test_decontamination(spark, docs, empty):
    long = next(t for t in texts() if t and len(plain_words(t)) > 30)
    items = [(1, " ".join(plain_words(long)[4:22])), (2, "x1 of"), (10, "x1 OF"), (3, None), (4, ""), (5, "nothing like that at all in here now or then again"), (6, "word")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = {}
    for i, t in items:
        w = plain_words(t)
        m = min(10, len(w))
        for s in range(len(w) - m + 1 if w else 0):
            wins.setdefault(tuple(w[s : s + m]), set()).add(str(i))
    want = []
    for r in docs.collect():
        w = plain_words(r["text"])
        hit, ids = set(), set()
        for m in {len(x) for x in wins}:
            for s in range(len(w) - m + 1):
                if (found := wins.get(tuple(w[s : s + m]))) is not None:
                    hit |= set(range(s, s + m))
                    ids |= found
        want.append((r["doc_id"], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    assert rows(decontaminate.report(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=str)
    assert sum(w[5] for w in want) > 3
    assert decontaminate.drop_contaminated(docs, bench).count() == sum(not w[5] for w in want)
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns
    assert decontaminate.report(empty, bench).count() == 0 and decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_of_a_hot_window(spark):
    """A passage that many items and most documents share, beside windows of nine other lengths, in one scan."""
    hot = " ".join(f"h{i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"a b{i} {hot} tail " + " ".join(f"w{i % m}" for m in range(1, 10))) for i in range(400)] + [(400, "clean words only")], "doc_id long, text string")
    items = [(i, f"{hot} end of item{i}") for i in range(150)] + [(1000 + m, " ".join(f"w{m}x" for _ in range(m))) for m in range(1, 10)] + [(2000, "w0 w1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found, _ = decontaminate.hits(docs, bench)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert len(got) == 401 and not got[400]["contaminated"] and got[400]["item_ids"] == []
    for i in range(400):
        tail = [i % m for m in range(1, 10)]
        pairs = {p + j for p in range(8) if tail[p : p + 2] == [0, 1] for j in (0, 1)}
        assert len(got[i]["item_ids"]) == 150 + bool(pairs) and got[i]["n_hit"] == 12 + len(pairs)


def repeats_removed(docs):
    """Rows of remove_repeats, by a table of all 50-byte strings."""
    all_rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    least = {}
    for i, b in all_rows:
        for p in range(len(b) - 49):
            least[b[p : p + 50]] = min(least.get(b[p : p + 50], 1 << 62), 1 << 61 if i is None else i)
    want = []
    for i, b in all_rows:
        g = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            g[p : p + 50] |= least[b[p : p + 50]] < (1 << 61 if i is None else i)
        want.append((i, len(b), int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()))
    return sorted(want, key=str)


def test_substrings(docs, empty):
    for _ in range(300):
        t = [random.choice([0, 1, 2, -1][: random.randint(1, 4)]) for _ in range(random.randint(0, 40))] + [-2]
        assert substrings.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])
    got = substrings.remove_repeats(docs)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats_removed(docs)
    assert rows(substrings.remove_repeats(docs, hot=3), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats_removed(docs)
    assert substrings.remove_repeats(empty).count() == 0
    # texts over many slices that share passages of 40 to 2,000 bytes, some around the ends of slices
    word = lambda n: " ".join(random.choice("abcdefgh") * random.randint(1, 3) + str(random.randint(0, 999)) for _ in range(n))
    shared = [word(400)[: random.randint(40, 2000)] for _ in range(30)]
    long = [word(2) + "".join(random.choice(shared) + word(random.randint(1, 60)) for _ in range(150)) for _ in range(3)]
    long = docs.sparkSession.createDataFrame([(i, t) for i, t in enumerate([*long, long[0][60_000:70_000], *shared])], "doc_id long, text string")
    for most in (substrings.HOT, 20):
        assert rows(substrings.remove_repeats(long, hot=most), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats_removed(long)
    # one phrase of 45 bytes with other text around it in every document
    phrase = "the same forty-five bytes stand in all of them "[:45]
    common = docs.sparkSession.createDataFrame([(i, f"{word(9)}{phrase}{word(9) if i % 3 else 'one of three endings'}") for i in range(300)], "doc_id long, text string")
    assert rows(substrings.remove_repeats(common, hot=50), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats_removed(common)


def test_substrings_memory():
    """Peaks in a task: anchors of a block of 4 MB in under 64 MB, the owners of a share of 4 MB of pieces in under 64 MB."""
    rng = np.random.default_rng(1)
    data, lengths = rng.integers(97, 123, 4_000_000, np.uint8), np.array([0, 49, 50, 51, 0, 849, *[1000] * 3999, 1])
    tracemalloc.start()
    try:
        _, _, document, first, last, _ = substrings.anchors(data, lengths)
        peaks = [tracemalloc.get_traced_memory()[1]]
        n = 52_000
        size, at = np.full(n, substrings.PIECE, np.uint8), np.full(n, substrings.SPAN - 1, np.uint8)
        data[76 * (n - 1) : 76 * n] = data[:76]
        data[76 * (n - 2) : 76 * (n - 2) + 71] = [*data[:70], 0]
        group = pd.DataFrame({"block": ["0-0"], "ids": [substrings._pack(np.arange(n)[::-1])], "places": [substrings._pack(at)], "lengths": [substrings._pack(size)], "data": [zlib.compress(data[: 76 * n].tobytes(), 1)]})
        tracemalloc.reset_peak()
        least = substrings._unpack(substrings._resolve((0,), group)["least"][0], np.int64).reshape(n, substrings.SPAN)
        peaks.append(tracemalloc.get_traced_memory()[1])
    finally:
        tracemalloc.stop()
    assert max(peaks) < 64e6, peaks
    assert np.array_equal(np.bincount(document, last - first + 1, len(lengths)), np.maximum(lengths - 49, 0))
    assert (least[1:-2] == np.arange(n)[::-1][1:-2, None]).all() and (least[[0, -1]] == 0).sum() == 2 * substrings.SPAN
    assert least[-2].tolist() == [0] * 21 + [1] * 6


def test_substrings_move_no_texts(spark, docs, monkeypatch):
    """The joins of blocks with marks and owners shuffle these, not the texts."""
    plans, write = [], substrings.durable
    monkeypatch.setattr(substrings, "durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        got = substrings.remove_repeats(docs)
    finally:
        spark.conf.set(key, old)
    assert plans[-1].count("SortMergeJoin") == 2 and plans[-1].count("Exchange ") == 2
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats_removed(docs)


def test_ids_stay_exact(spark):
    """Ids that doubles cannot hold, one null among them, in one batch: through every operator whose rows pass Python."""
    base = " ".join(f"word{i}" for i in range(80))
    made = [(9007199254740993, base), (None, "alone"), (9007199254740995, base + " more"), (9007199254740997, "quite another text")]
    x = spark.createDataFrame(made, "doc_id long, text string").coalesce(1)
    want = sorted((i for i, _ in made), key=str)
    for f in (substrings.remove_repeats, class_lm.score, lambda d: bpe.encode_decode(d, bpe.default_vocabulary()), lines.report, ngram_join.report):
        assert sorted((r["doc_id"] for r in f(x).collect()), key=str) == want
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.report(x).collect()} == {made[0][0]: (made[0][0], 1), None: (None, 0), made[2][0]: (made[0][0], 1), made[3][0]: (made[3][0], 0)}
    assert {r["doc_id"]: r["n_removed"] > 0 for r in substrings.remove_repeats(x).collect()} == {made[0][0]: False, None: False, made[2][0]: True, made[3][0]: False}


def plain_lines(docs, min_docs=lines.MIN_DOCS):
    """{row number: places of dropped lines} of [(id, text)], written out plainly; documents alike in id and text count once."""
    leaves, exact = defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for doc in set(docs):
        for i, line in enumerate((doc[1] or "").encode().split(b"\n")):
            if t := tuple(lines.masked(line)):
                leaves[len(t), t[:3]][t].add(doc)
                if len(t) >= 20:
                    exact[tuple(line.split())].add(doc)
    first = {}  # masked line -> least ids of its templates
    least = lambda ds: min((d[0] for d in ds if d[0] is not None), default=None)
    for (n, _), held in leaves.items():
        count = Counter()
        for t, ds in held.items():
            count.update({(i, w): len(ds) for i, w in enumerate(t)})
        of, found = {}, defaultdict(set)
        for t, ds in held.items():
            p = tuple((i, w) for i, w in enumerate(t) if count[i, w] >= min_docs)
            if len(p) >= lines.AGREE * n:
                of[t] = p
                found[p] |= ds
        wide = defaultdict(set)
        for p in found:
            for q in [p, *[tuple(x for x in p if x != y) for y in p if y[0] >= 3]]:
                if q == p or len(q) >= lines.AGREE * n:
                    wide[q].add(p)
        firsts = defaultdict(list)
        for p, ds in found.items():
            if len(ds) >= min_docs:
                firsts[p].append(least(ds))
        for ps in wide.values():
            ds = set().union(*[found[p] for p in ps])
            if len(ds) >= min_docs and any(len(found[p]) < min_docs for p in ps):
                for p in ps:
                    firsts[p].append(least(ds))
        for t, p in of.items():
            if p in firsts:
                first[t] = min((i for i in firsts[p] if i is not None), default=None)
    as_is = {t: least(ds) for t, ds in exact.items() if len(ds) >= (2 if len(t) >= 50 else 4)}
    out = {}
    for k, (i, text) in enumerate(docs):
        gone = set()
        for place, line in enumerate((text or "").encode().split(b"\n")):
            t = tuple(lines.masked(line))
            if t in first and first[t] != i or tuple(line.split()) in as_is and as_is[tuple(line.split())] != i:
                gone.add(place)
        out[k] = gone
    return out


def test_lines(docs, empty):
    all_rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    gone = plain_lines(all_rows)
    cut = lambda k, t: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[k])
    want = sorted(((i, cut(k, t), 0 if t is None else t.count("\n") + 1, len(gone[k])) for k, (i, t) in enumerate(all_rows)), key=str)
    got = lines.dedup(docs)
    assert rows(got, "doc_id", "text", "n_lines", "n_dropped") == want
    footers = [i for i, t in enumerate(texts()) if t and t.startswith("boiler plate")]
    assert [0 in gone[[i for i, _ in all_rows].index(i)] for i in footers] == [False] + [True] * (len(footers) - 1)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert lines.dedup(empty).count() == 0
    with pytest.raises(ValueError, match="n_lines"):
        lines.dedup(docs.withColumn("n_lines", F.lit(1)))


def made_up(n=48):
    return ["".join(x) for x in itertools.islice(itertools.product("bcdfg", "aeiou", "mnprs"), n)]


def test_lines_templates(spark):
    """Templates with varying words, strays, rare values, digits and long lines, against the plain version."""
    random.seed(12)
    w = made_up(125)
    page = lambda i: f"read more about our {w[i]} on the news page today"
    n = lambda made: sum(r["n_dropped"] for r in lines.dedup(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)).collect())
    assert n([page(i) for i in range(40)]) == 39
    assert n([*[page(i) for i in range(40)], "read more about nothing that anyone else has ever said"]) == 39
    assert n([f"read more about our {w[i]} on the {w[-i - 1]} page today" for i in range(40)]) == 39
    assert n([f"{w[i]} read more about our stories on the news page" for i in range(40)]) == 0  # another leaf each
    assert n([page(0) if i < 9 else page(1) for i in range(40)]) == 39  # a rare value joins the frequent one
    assert n([*[page(i) for i in range(5)], "\n".join(page(i) for i in range(5, 20))]) == 0  # fifteen in one document, but six documents
    kinds = [lambda: f"page {random.randint(1, 99)} of {random.randint(1, 9)}", lambda: page(random.randrange(60)), lambda: f"copyright {random.choice(w[:3])} all of the rights are reserved by {random.choice(w)}", lambda: " ".join(random.choice(w[:6]) for _ in range(random.randint(1, 8))), lambda: f"log in to see {random.choice(w[:2])} {random.choice(w[:2])} {random.choice(w[:40])} here", lambda: " ".join(w[random.randrange(4) :][:60]), lambda: " ".join(w[random.randrange(9) :][:25])]
    made = [(random.choice([i, i, i, None, 7]), "\n".join(random.choice(kinds)() for _ in range(random.randint(0, 6)))) for i in range(120)]
    made += made[:3]
    want = plain_lines(made)
    x = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(made)], "doc_id long, text string, row int").repartition(4)
    got = {r["row"]: r for r in lines.dedup(x).collect()}
    assert {k: r["n_dropped"] for k, r in got.items()} == {k: len(v) for k, v in want.items()}
    for k, gone in want.items():
        assert got[k]["text"] == "\n".join(t for p, t in enumerate(made[k][1].split("\n")) if p not in gone)
    assert sum(map(len, want.values())) > 100


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    own, other = bpe.codec(path), Tokenizer.from_file(path)
    extra = ["<|endoftext|>a <|endoftext|>", "  \n x", "don't  we'll\t\t", "thethe" * 500, "  a　b", "ééé" * 90]
    for t in [*texts(), *extra]:
        ids = other.encode(t or "", add_special_tokens=False).ids
        joined, n = own.encode(t or "")
        assert joined == ",".join(map(str, ids)) and n == len(ids)
        assert own.decode(np.array(ids, int)).decode("utf-8", "replace") == other.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(docs, path).count() == docs.count() and bpe.encode_decode(empty, path).count() == 0


def test_class_lm(docs, empty):
    all_rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b"\n"]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in all_rows if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in all_rows)
    got = class_lm.score(docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) and all(r["score"] < 0 for r in got)
    assert class_lm.score(empty).count() == 0


def test_class_lm_words_of_one_hash(spark):
    """Words whose hashes share low bits have classes of their own: scores do not change if one of them is renamed."""
    seen = {}
    a, b = next((seen[k], w) for i in range(100_000) if (k := zlib.crc32((w := f"q{i}xy").encode()) & 0x3FFFF) in seen or seen.setdefault(k, w) is None)
    random.seed(8)
    pick = lambda *x: random.choice(x)
    texts = [" ".join(f"{pick('the', 'this', 'any')} {pick('dog', 'cat', a)} {pick('runs', 'sits', b)} {pick('here', 'there')}" for _ in range(30)) for _ in range(60)]
    other = "zzz0xy"
    assert not any(other in t for t in texts)
    frame = lambda t: spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(3)
    got, renamed = ({r["doc_id"]: r["score"] for r in class_lm.score(frame(t)).collect()} for t in (texts, [t.replace(b, other) for t in texts]))
    assert got == pytest.approx(renamed)
    assert sum(got.values()) >= sum(r["score"] for r in class_lm.score(frame(texts), rounds=1).collect()) - 1e-6


def test_class_lm_score(spark):
    """The score against a class bigram model written out plainly over the classes found, and a likelihood that rises."""
    random.seed(6)
    pick = lambda *x: random.choice(x)
    made = [(i, " ".join(f"{pick('the', 'this', 'any')} {pick('dog', 'cat', 'cow', f'odd{i % 23}')} {pick('runs', 'sits')} {pick('here', 'there')}" for _ in range(random.randint(0, 20)))) for i in range(60)]
    x = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in class_lm.score(x).collect()}
    raw = class_lm.durable(class_lm.blocks(x, "doc_id", "text", class_lm.LEAST_SHARES))
    found, cells = class_lm.exchange(class_lm.durable(class_lm.numbered(raw)))
    of = {}
    for r in raw.join(found, "block").collect():
        of |= dict(zip(zlib.decompress(r["words"]).split(b" ")[:-1], np.concatenate([class_lm._unpack(d, np.int64) for d in r["classes"]]).tolist()))
    train = [[b"\n", *t.encode().split(), b"\n"] for i, t in made if zlib.crc32(str(i).encode()) % 7 != 2]
    words, pairs = Counter(w for t in train for w in t[1:]), Counter((of[a], of[b]) for t in train for a, b in zip(t, t[1:]))
    size, once, k = Counter(), Counter(), class_lm.CLASSES
    for word, n in words.items():
        size[of[word]] += n
        once[of[word]] += n == 1
    total = sum(size.values()) + 0.5 * k
    out_of = Counter()
    for (a, _), n in pairs.items():
        out_of[a] += n
    step = lambda a, b: (pairs[a, b] + class_lm.PRIOR * (size[b] + 0.5) / total) / (out_of[a] + class_lm.PRIOR)
    new = lambda c: (once[c] + 0.5) / (size[c] + 1)
    emit = lambda word: (1 - new(of[word])) * words[word] / size[of[word]] if words[word] else new(of[word])
    for i, t in made:
        seen = [b"\n", *t.encode().split(), b"\n"]
        assert got[i]["score"] == pytest.approx(sum(math.log10(step(of[a], of[b]) * emit(b)) for a, b in zip(seen, seen[1:])))
    rises = [class_lm.likelihood(class_lm.exchange(class_lm.durable(class_lm.numbered(raw)), n)[1][:k]) for n in (0, 1, 3)]
    assert rises == sorted(rises) and rises[0] < rises[-1]


#: (families that a text holds, the text)
LABELLED = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."), ("cc-by-nc", "Intro.\nLicensed under CC BY-NC 4.0."), ("mit", "Released under the MIT License."), ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", "// SPDX-License-Identifier: MIT"), ("gpl", "License: GPLv3"), ("zlib", "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"), ("eupl", "Licensed under the European Union Public Licence, version 1.2"), ("epl", "made available under the terms of the Eclipse Public License 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"), ("agpl", "released under the GNU Affero General\nPublic License"), ("cc-by,mit", "The code is released under the MIT License.\nThe text is licensed under CC BY 4.0."),
    ("proprietary", "Copyright 2020 X. All rights reserved."), ("lgpl", "distributed under the GNU Lesser General Public License"), ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."), ("mit", "filler " * 500 + "Released under the MIT License." + " more" * 400),
    ("", "Nicht mit."), ("", "the terms of public use"), ("", "the general public was under the gnu herd licensed to graze, this work of ours is a version of 3 old tales"), ("", "he is licensed to drive under the law, the apache tribe has a license, version 2.0 of the story"),
    ("", "a permission to fish on the lake is granted to members free of charge"), ("", "the public license office issues a driving license under the terms of the law"), ("", "all the rights were reserved for later"), ("", "she works at mit and drives a car with a license"), ("", "license public general gnu the under licensed is work this"), ("", ""), ("", None),
]


def test_licenses(spark, docs, empty):
    x = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(LABELLED)], "doc_id long, text string")
    model = licenses.train(docs)
    found = {(r["k_id"], r["family"]) for r in licenses.scan(x, model).where("confirmed").collect()}
    want = {(i, f) for i, (fs, _) in enumerate(LABELLED) for f in fs.split(",") if f}
    assert len(found & want) >= 0.95 * len(found) and len(found & want) >= 0.95 * len(want)  # precision and recall
    assert not {i for i, _ in found} & {i for i, (f, _) in enumerate(LABELLED) if not f}
    assert all(set(t.split()) & set(licenses.ANCHORS) and len(t.split()) <= licenses.STRIDE for _, _, t in licenses.templates())
    assert licenses.report(docs).count() == docs.count() and licenses.report(empty).count() == 0


def test_urls(spark):
    """Chains, hubs, relative links and allow precedence: against known answers and against the SQL."""
    import duckdb

    link, meta = '<html><LINK rel="canonical" href="{}"></html>', '<meta http-equiv="refresh" content="0; url={}">'
    pages = [(1, "https://a.Example.org/es/x", ""), (2, "http://b.net/1", link.format("https://a.example.org/es/x")), (3, "http://c.net/1?q", meta.format("http://b.net/1")), (4, "http://shop.com/fr/1", link.format("http://b.net/1")), (5, "http://d.net/", None), (6, None, ""), (7, "no scheme", ""), (8, "http://example.org/en/12#t", ""), (9, "http://e.net/a", link.format("/b")), (9, "http://e.net/a", link.format("/b")), (10, "http://sub.e.net/b/c?x=1", link.format("//e.net/b"))]
    pages += [(11, "http://q.com/de/1", meta.format("../x&amp;y")), (13, "HTTP://Q.COM/de/../x&y#frag", ""), (14, "http://hub.net/", ""), (30, "http://z.com/de/k", link.format("http://hub.net/#x")), (31, "http://w.net/a/b", link.format("c")), (32, "http://w.net/a/c", ""), (33, "http://w.net/a/c", link.format("http://shop.com/de/2"))]
    pages += [(40 + i, f"http://m{i}.sub{i}.net/p", link.format("http://hub.net/")) for i in range(9)]
    x = spark.createDataFrame(pages, "page_id long, url string, html string")
    names = ["page_id", "host", "path", "rule", "verdict"]
    got = rows(urls.judge_pages(x), *names)
    frame = x.toPandas()
    con = duckdb.connect()
    con.register("pages", frame)
    assert got == sorted(con.sql(f"select {', '.join(names)} from ({urls.ORACLE})").fetchall(), key=str)
    assert [r[0] for r in got if r[4] == "block" and r[3] is None] == sorted([2, 3, 14, 31, 32, 33, *range(40, 49)], key=lambda i: str((i,)))  # by links alone
    assert [r for r in got if r[0] in (4, 8)] == [(4, "shop.com", "/fr/1", "com/fr/", "allow"), (8, "example.org", "/en/12", "example.org/en/1", "block")]
    assert urls.judge_pages(x.limit(0)).count() == 0


def test_components(spark):
    random.seed(2)
    edges = [(random.randint(0, 150), random.randint(0, 150)) for _ in range(90)] + [(200, i) for i in range(201, 260)] + [(i, i + 1) for i in range(300, 340)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = sorted((x, find(x)) for x in {y for e in edges if e[0] != e[1] for y in e})
    assert rows(components.components(spark.createDataFrame(edges, "u long, v long")), "node", "component") == sorted(want, key=str)


def test_join(spark, docs, empty):
    base = [f"w{random.randint(0, 500)}" for _ in range(400)]
    near = [" ".join("zz" + str(j) if i == j * 7 % 400 else w for i, w in enumerate(base)) for j in range(600)]
    more = spark.createDataFrame([(1000 + i, t, "en", "s", 1, *EXTRA) for i, t in enumerate([*near, near[0], "one two", "One  Two"])], SCHEMA)
    x = docs.union(more)
    sets = [(r["doc_id"], frozenset(ngram_join.shingles(r["text"]).tolist())) for r in x.collect()]
    links = [sum(bool(s) and 5 * len(s & t) >= 4 * len(s | t) for _, t in sets) - bool(s) for _, s in sets]
    got = rows(ngram_join.report(x), "doc_id", "n_links")
    assert got == sorted(((i, n) for (i, _), n in zip(sets, links)), key=str)
    classes = {r["class_id"] for r in ngram_join.report(more).collect()}
    assert classes == {1000, 1601}
    assert ngram_join.keep_one(more).count() == 2 and ngram_join.keep_one(more).columns == docs.columns
    assert ngram_join.report(empty).count() == 0


def test_join_recall(spark):
    """Pairs over the whole range from 0.8 on, most of them close to it: at least 0.9 of the links, and whole classes."""
    random.seed(3)
    made = []
    for _ in range(60):
        base = [f"w{random.randint(0, 9999)}" for _ in range(200)]
        made += [" ".join(base), *[" ".join(random.choice("pqr") * 3 + str(i) if i in set(random.sample(range(200), k)) else w for i, w in enumerate(base)) for k in (1, 2, 3, 4)]]
    x = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(4)
    sets = [frozenset(ngram_join.shingles(t).tolist()) for t in made]
    links = [sum(i != j and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.report(x).collect()}
    assert all(got[i] <= n for i, n in enumerate(links)) and sum(got.values()) >= 0.9 * sum(links) > 100


def test_join_needs_tries(docs):
    with pytest.raises(ValueError, match="tries"):
        ngram_join.join(docs, trees=4)


def test_quality(spark, docs, empty):
    def plain(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        ls = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(again)

    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    want = [(r["doc_id"], *(p := plain(r["text"])), p[0] < 10 or 100 * p[4] > 20 * p[0]) for r in docs.collect()]
    got = quality.report(docs, labels)
    assert rows(got, "doc_id", *quality.FEATURES[:5], "base_failed") == sorted(want, key=str)
    assert got.where("kept and base_failed or not kept and not base_failed").count() == 0  # too few labels: no cutoff is certified
    assert quality.report(empty, labels).count() == 0
    many = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat(concat('ab', id % 17, '## c '), 1) || 'one two three four five six seven eight nine' || repeat(' zz%%', id % 3 + 5), concat('clean words one two three four five six seven nr', id)) as text", "'en' as lang")
    marks = many.selectExpr("doc_id", "if(doc_id % 3 = 0, 0, 1) as quality", "0 as toxic")
    out = quality.report(many, marks).join(marks, "doc_id").where("not base_failed").groupBy("quality").agg({"kept": "count"}).collect()
    kept = {r["quality"]: r["n"] for r in quality.report(many, marks).join(marks, "doc_id").where("kept").groupBy("quality").count().withColumnRenamed("count", "n").collect()}
    assert out and kept == {1: 4000}
    tail = lambda n, k, a: sum(math.comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1))
    for n, k in ((50, 0), (400, 1), (900, 3)):
        e = spark.sql(f"select {quality._log_tail(0.01)} as x from (select {n}L as n, {k}L as k)").first()["x"]
        assert e == pytest.approx(math.log(tail(n, k, 0.01)))


def test_quality_few_labels(spark):
    """300 good labels a stratum certify joint settings; 250 do not, and a rule that loses good documents stays off."""
    rate = lambda r: {"n_words": 1000, "word_chars": 5000, "n_symbols": r, "n_dup_lines": 0, "n_repeat_words": 0, "n_exclaims": 0, "n_lines": 10}
    made = [(s, i, q, {**rate(160 if q == 0 and i % 2 else 0), "n_exclaims": (60 if q == 0 and not i % 2 else 0), "n_dup_lines": int(i % 10 == 0)}) for s, good in (("de", 300), ("en", 300), (None, 300), ("fr", 250)) for q, n in ((1, good), (0, 40)) for i in range(n)]
    rows_ = [(k, s, q, *[m[c] for c in quality.FEATURES]) for k, (s, _, q, m) in enumerate(made)]
    x = spark.createDataFrame(rows_, "doc_id long, lang string, quality int, " + ", ".join(f"{c} long" for c in quality.FEATURES))
    cuts = {r["stratum"]: (r["cut_symbols"], r["cut_exclamations"], r["cut_duplicate_lines"]) for r in quality.cutoffs(x.drop("quality"), x.select("doc_id", "quality")).collect()}
    assert cuts == {s: (150, 50, None) for s in ("de", "en", "")}  # a null language is a stratum of its own


def test_quality_cutoffs(spark):
    """The certified settings against the tests written out plainly, on random rates; copies count once."""
    random.seed(21)
    strict, n_rules = sorted(quality.CUTOFFS, reverse=True), len(quality.RULES)
    made = [(s, q, [random.choice([0, 0, 30, 120, 260, 450]) if q == 0 or random.random() < 0.002 else 0 for _ in range(n_rules)]) for s, good in (("de", 900), ("en", 350), ("fr", 200)) for q, n in ((1, good), (0, 60)) for _ in range(n)]
    names = ["n_symbols", "n_exclaims", "n_dup_lines", "n_repeat_words"]
    table = [(k, k, s, q, 1000, 5000, r[0], r[1], r[2], min(r[3], 190), 1000) for k, (s, q, r) in enumerate(made)]
    table += [(9000 + i, 0, "de", 1, *table[0][4:]) for i in range(500)]  # copies of one text
    x = spark.createDataFrame(table, "doc_id long, text_key long, lang string, quality int, n_words long, word_chars long, n_symbols long, n_exclaims long, n_dup_lines long, n_repeat_words long, n_lines long").withColumn("n_exclaims", F.col("n_exclaims"))
    got = {r["stratum"]: tuple(r[f"cut_{n}"] for n in quality.RULES) for r in quality.cutoffs(x.drop("quality"), x.select("doc_id", "quality")).collect()}
    rates = defaultdict(list)
    for s, q, r in made:
        rates[s].append((q, [r[0], r[1], r[2], min(r[3], 190)]))
    tail = lambda n, k, a: sum(math.comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1))
    want = {}
    for s, docs in rates.items():
        bad = [[sum(r[i] > c for q, r in docs if not q) for c in strict] for i in range(n_rules)]
        order = sorted(range(n_rules), key=lambda i: (-sum(bad[i]), i))
        step = [[None if not b else next(c for c, x in zip(strict, bad[i]) if x == b) for b in bad[i]] for i in range(n_rules)]
        good, best = sum(q for q, _ in docs), None
        for path in range(1, n_rules + 1):
            for at in range(len(strict)):
                cut = {i: step[i][at] for i in order[:path] if step[i][at] is not None}
                lost = lambda label: sum(q == label and any(r[i] > c for i, c in cut.items()) for q, r in docs)  # noqa: B023, E731
                if lost(1) >= quality.ALPHA * good or tail(good, lost(1), quality.ALPHA) > quality.DELTA / (len(rates) * n_rules):
                    break
                if lost(0) and (best is None or (lost(0), -path, -at) > best[0]):
                    best = ((lost(0), -path, -at), tuple(cut.get(i) for i in range(n_rules)))
        if best:
            want[s] = best[1]
    assert names and got == want and "fr" not in want and len(want) == 2


def test_pipeline(spark, docs, tmp_path):
    """Every stage against its plain version, each on what the one before kept."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    window = " ".join(plain_words(next(t for t in texts() if t and len(plain_words(t)) > 40))[5:15])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("benchmark", spark.createDataFrame([(1, window)], "item_id long, text string")), ("labels", labels)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), [(r["doc_id"], r["text"]) for r in docs.collect()]
    seen = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def passes(t):
        w = seen(t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        return len(w) >= 10 and 100 * len({j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}) <= 20 * len(w)

    def one_of_each(found):
        sets, root = [frozenset(ngram_join.shingles(t).tolist()) for _, t in found], list(range(len(found)))
        for i, a in enumerate(sets):
            for j in range(i):
                if a and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                    root = [root[j] if r == root[i] else r for r in root]
        classes = defaultdict(list)
        for k, r in enumerate(root):
            classes[r].append(found[k])
        least = [min((d[0] is None, d[0] or 0) for d in c) for c in classes.values()]
        return [next(d for d in c if (d[0] is None, d[0] or 0) == i) for c, i in zip(classes.values(), least)]

    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = ngram_join.durable(stage(spark, now, str(tmp_path)))
        if k == 0:
            kept = [d for d in kept if passes(d[1])]
        elif k == 1:
            gone = plain_lines(kept)
            cut = [(i, "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[j]), bool(gone[j])) for j, (i, t) in enumerate(kept)]
            kept = [(i, t) for i, t, less in cut if not less or seen(t)]
        elif k == 2:
            kept = one_of_each(kept)
        else:
            kept = [d for d in kept if not f" {window} " in f" {' '.join(plain_words(d[1]))} "]
        assert now.columns == docs.columns and rows(now, "doc_id", "text") == sorted(kept, key=str)
    other = Tokenizer.from_file(bpe.default_vocabulary())
    want = sorted(((i, len(other.encode(t, add_special_tokens=False).ids)) for i, t in kept), key=str)
    assert rows(corpus_pipeline.run(spark, str(tmp_path)), "doc_id", "n_tokens") == want and len(want) > 10
