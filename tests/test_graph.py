"""The hand graph: known answers for every family of graph operators."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wiregraph.functions import hubs
from wiregraph.functions.ranks import running
from wiregraph.operators import bitmaps as B
from wiregraph.operators import connectivity as C
from wiregraph.operators import convergence as V
from wiregraph.operators import cycles as Y
from wiregraph.operators import groups as G
from wiregraph.operators import marginals as M
from wiregraph.operators import nodes as N
from wiregraph.operators import paths as P
from wiregraph.operators import stats as S
from wiregraph.operators import thresholds as T
from wiregraph.operators import walks as W
from wiregraph.plans import analyses
from wiregraph.schema import ANNOTATIONS, EDGES
from wiregraph.sources import results, tables

BASE = 720575940000000000
ROWS = [(1, 3, "X", 10, "ACH"), (1, 4, "X", 5, "GABA"), (1, 4, "Y", 6, "GABA"), (2, 4, "X", 8, "ACH"), (2, 5, "Y", 2, "GLUT"), (3, 3, "X", 2, "ACH"), (3, 4, "X", 1, "ACH"), (3, 6, "X", 6, "ACH"), (4, 6, "Y", 4, "GABA"), (4, 7, "Y", 12, "GABA"), (5, 7, "X", 3, "GLUT"), (6, 1, "Y", 7, "ACH"), (7, 8, "X", 9, "ACH")]


def cells(rows):
    return {r[0] - BASE: tuple(r[1:]) for r in rows}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(a + BASE, b + BASE, n, w, t) for a, b, n, w, t in ROWS], EDGES).cache()


@pytest.fixture(scope="module")
def annotations(spark):
    kinds = [(1, "A", None), (2, "B", None), (3, "C", None), (4, "C", None), (5, None, "D"), (6, "E", None), (7, "E", None)]
    return spark.createDataFrame([(i + BASE, c, h) for i, c, h in kinds], ANNOTATIONS)


def group(spark, **ids):
    return spark.createDataFrame([(g, i + BASE) for g, xs in ids.items() for i in xs], "grp string, root_id long")


def summary(rows):
    return {(r.grp, r.hop): (r.cells, r.synapses, r.n_rows) for r in P.hop_summary(rows).collect()}


def test_paths_and_levels(spark, edges):
    down = P.paths(edges, group(spark, A=[1, 1], B=[2]), 3)
    assert summary(down) == {("A", 1): (2, 21, 3), ("A", 2): (2, 22, 3), ("A", 3): (1, 9, 1), ("B", 1): (2, 10, 2), ("B", 2): (2, 19, 3), ("B", 3): (2, 16, 2)}
    got = cells(N.node_table(down).where("grp = 'A'").select("root_id", "level", "degree").collect())
    assert got == {1: (0, 2), 3: (1, 2), 4: (1, 3), 6: (2, 2), 7: (2, 2), 8: (3, 1)}
    both = P.paths(edges, group(spark, g=[4]), 2, upstream=True)
    assert cells(N.node_table(both).select("root_id", "level", "degree").collect()) == {4: (0, 5), 6: (1, 2), 7: (1, 2), 8: (2, 1), 1: (-1, 2), 2: (-1, 1), 3: (-1, 1)}
    rec = P.paths(edges, group(spark, r=[1]), 3, skip_recurrents=False)
    assert summary(rec) == {("r", 1): (2, 21, 3), ("r", 2): (4, 25, 5), ("r", 3): (6, 41, 7)}
    assert P.paths(edges, group(spark, none=[99]), 3).count() == 0
    with pytest.raises(ValueError):
        P.paths(edges, group(spark, A=[1]), downstream=False)


@pytest.mark.parametrize("first,score", [(True, {4: 44 / 105, 6: 0, 7: 0, 8: 0}), (False, {4: 44 / 105, 6: 17 / 140, 7: 11 / 35, 8: 11 / 35})])
def test_convergence(spark, edges, annotations, first, score):
    out = analyses.downstream_convergence(edges, group(spark, A=[1], B=[2]), "A", "B", annotations, use_inits=first, max_hops=3)
    got = cells(out["cells"].select("root_id", "level_a", "level_b", "degree", "initial").collect())
    assert got == {4: (1, 1, 2, True), 6: (2, 2, 1, False), 7: (2, 2, 2, False), 8: (3, 3, 1, False)}
    assert {k: pytest.approx(v[0]) for k, v in cells(out["score"].collect()).items()} == score
    assert out["visit_overlap"].agg(F.sum("share")).first()[0] == pytest.approx(1)
    assert out["overlap"].count() == 16


def test_walks_agree(spark, edges):
    rows = P.paths(edges, group(spark, A=[1]), 3)
    trans, starts = W.transitions(rows), group(spark, A=[1])
    exact = {(r.level, r.root_id - BASE): r.p for r in W.expected_visits(trans, starts, 3).collect()}
    assert exact == {(0, 1): 1, (1, 3): pytest.approx(10 / 21), (1, 4): pytest.approx(11 / 21), (2, 6): pytest.approx(17 / 28), (2, 7): pytest.approx(11 / 28), (3, 8): pytest.approx(11 / 28)}
    cells = group(spark, B=[6, 7, 8])
    hits = W.hits_in(W.expected_visits(trans, starts, 3, absorb=cells, per_start=False), cells)
    assert {r.level: r.p for r in W.first_hit_levels(hits).collect()} == {2: pytest.approx(1)}
    wide = {r.root_id - BASE: tuple(r)[1:] for r in W.visits_wide(W.expected_visits(trans, starts, 3, per_start=False), 3).collect()}
    assert wide[8] == (0, 0, 0, pytest.approx(11 / 28)) and wide[1] == (1, 0, 0, 0)
    last = W.transitions(rows, "last", "neuropil").where(F.col("pre") == 1 + BASE).collect()
    assert {r.post - BASE: r.p for r in last} == {3: 10 / 16, 4: 6 / 16}


def test_connectivity(spark, edges):
    s, t = group(spark, C=[3, 4]), group(spark, E=[6, 7])
    m = C.matrix(edges, s, t)
    assert {(r.transmitter, r.pre - BASE, r.post - BASE): r.synapses for r in m.collect()} == {("all", 3, 6): 6, ("all", 4, 6): 4, ("all", 4, 7): 12, ("ACH", 3, 6): 6, ("GABA", 4, 6): 4, ("GABA", 4, 7): 12}
    assert {r.transmitter: r.synapses for r in C.transmitter_totals(m, edges).collect()} == {"ACH": 6, "GABA": 16, "GLUT": 0}
    marg = C.marginals(m, edges, s, t)
    assert {(r.side, r.cell - BASE): (r.synapses, r.partners) for r in marg.where("transmitter = 'all'").collect()} == {("source", 3): (6, 1), ("source", 4): (16, 2), ("target", 6): (10, 2), ("target", 7): (12, 1)}
    rows = M.connected(m)
    examples = M.examples(rows, M.summary(rows, s, t), s, t)
    best = {r.other - BASE: (r.transmitter, r.partner - BASE, r.weight, r.strength, r.label) for r in C.strongest_partner(m, examples).where("transmitter is not null").collect()}
    assert best == {3: ("ACH", 6, 6, 0.5, f"{BASE + 6} group (10 synapses)"), 4: ("GABA", 7, 12, 1.0, f"{BASE + 7} group (12 synapses)")}
    assert {(r.pre - BASE, r.post - BASE): r.synapses for r in C.dense(m, s, t, "C", "E").collect()} == {(3, 6): 6, (3, 7): 0, (4, 6): 4, (4, 7): 12}
    assert {tuple(r)[1:] for r in C.wide(m.where("source_group = 'C'")).select("pre", str(BASE + 6), str(BASE + 7)).collect()} == {(6, 0), (4, 12)}
    assert M.examples(rows, M.summary(rows, s, t), s, t, 1).count() == 2
    back = {r.other - BASE: (r.transmitter, r.partner - BASE, r.weight) for r in C.strongest_partner(m, examples, "source").where("transmitter is not null").collect()}
    assert back == {6: ("ACH", 3, 6), 7: ("GABA", 4, 12)}
    same = C.marginals(C.matrix(edges, s, s), edges, s, s).where("transmitter = 'all' and side = 'source'")
    assert {r.cell - BASE: r.synapses for r in same.collect()} == {3: 3, 4: 0}
    exact, boot = M.stats(M.summary(rows, s, t, fill=M.all_keys(edges, s, t))), S.bootstrap_ci(rows, s, t, reps=500)
    j = exact.join(boot, M.KEYS).select(exact["mean"] == boot["mean"], boot["low"] <= boot["mean"], boot["mean"] <= boot["high"]).collect()
    assert j and all(all(r) for r in j)


def test_analyses(spark, edges, annotations):
    out = analyses.pathways(edges, group(spark, A=[1]), annotations, max_hops=3)
    assert summary(out["paths"]) == {("A", 1): (2, 21, 3), ("A", 2): (2, 22, 3), ("A", 3): (1, 9, 1)} and out["nodes"].count() == 6
    panel = analyses.connectivity_panel(edges, group(spark, C=[3, 4]), group(spark, E=[6, 7]))
    assert panel["matrix"].count() == 6 and {r.transmitter: r.synapses for r in panel["transmitters"].collect()} == {"ACH": 6, "GABA": 16, "GLUT": 0}
    assert {(r.side, r.bin): r.cells for r in panel["partners_histogram"].where("transmitter = 'all'").collect()} == {("source", 0): 2, ("target", 0): 2}
    assert panel["strongest_source"].count() == panel["strongest_target"].count() == 4 and panel["scaled"].count() == panel["order"].count() == panel["examples"].count() == 4
    assert {r.side: (r.n, r["mean"]) for r in panel["partners_stats"].where("transmitter = 'all'").collect()} == {"source": (2, 1.5), "target": (2, 1.5)}


def test_bootstrap(spark):
    """The weights by the definition; a group's interval, cells without a connection included, agrees with the closed form."""
    import hashlib
    import math

    rows = spark.sql("select 's' source_group, 't' target_group, 'all' transmitter, 'source' side, id cell, id % 7 + 1 synapses, 1L partners from range(300)")
    s, t = spark.sql("select 's' grp, id root_id from range(1000)"), spark.sql("select 't' grp, 5L root_id")
    got = S.bootstrap_ci(rows, s, t, reps=200).first()

    def drawn(rep, cell):
        u, k, at = int(hashlib.md5(f"{rep}:{cell}".encode()).hexdigest()[:8], 16) / 2**32, 0, math.exp(-1)
        while u >= at:
            k += 1
            at += math.exp(-1) / math.factorial(k)
        return k

    means = []
    for rep in range(1, 201):
        w = [drawn(rep, c) for c in range(1000)]
        means.append(sum(w[c] * (c % 7 + 1) for c in range(300)) / sum(w))
    means.sort()
    at = lambda p: means[int(p * 199)] + (p * 199 - int(p * 199)) * (means[min(199, int(p * 199) + 1)] - means[int(p * 199)])
    assert (got["n"], got["mean"], got["low"], got["high"]) == (1000, pytest.approx(sum(c % 7 + 1 for c in range(300)) / 1000), pytest.approx(at(0.005)), pytest.approx(at(0.995)))
    exact = M.stats(M.summary(rows, s, t)).first()
    assert [got["low"] - got["mean"], got["high"] - got["mean"]] == pytest.approx([exact["low"] - exact["mean"], exact["high"] - exact["mean"]], rel=0.3)


def test_kept_results(spark, edges, tmp_path):
    """A second run reads, a changed edge table, other options or other cells compute again, a killed write is never read."""
    folder, calls = str(tmp_path / "kept"), []

    def ask(edges, groups, hops=3, stop=False):
        def compute(g):
            calls.append(sorted(r[0] for r in g.select("grp").distinct().collect()))
            out = P.paths(edges, g, hops)
            return out.withColumn("hop", F.when(F.col("post") == 8 + BASE, F.raise_error(F.lit("killed")).cast("int")).otherwise(F.col("hop"))) if stop else out

        del calls[:]
        return sorted(map(str, results.kept(folder, "paths", edges, groups, {"hops": hops}, compute).collect()))

    plain = lambda e, g, hops=3: sorted(map(str, P.paths(e, g, hops).collect()))
    a, both = group(spark, **{"1": [1]}), group(spark, **{"1": [1], "b": [2], "none": [99]})
    with pytest.raises(Exception, match="killed"):
        ask(edges, a, stop=True)
    assert ask(edges, a) == plain(edges, a) and calls == [["1"]]
    assert ask(edges.repartition(3), a) == plain(edges, a) and calls == [[]]
    assert ask(edges, both) == plain(edges, both) and calls == [["b", "none"]]
    assert ask(edges, both) == plain(edges, both) and calls == [[]]
    assert ask(edges, a) == plain(edges, a)
    fewer = edges.where("weight > 1")
    assert ask(fewer, both) == plain(fewer, both) and calls == [["1", "b", "none"]]
    assert ask(edges, both, 2) == plain(edges, both, 2) and calls == [["1", "b", "none"]]
    other = group(spark, **{"1": [1, 2], "b": [2]})
    assert ask(edges, other) == plain(edges, other) and calls == [["1"]]


def test_laid_out_edges(spark, edges):
    """Neither a hop nor a level of visits moves the edges: what is shuffled is the other side alone."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by = tables.laid_out(edges)
        frontier = group(spark, A=[1, 2]).repartition(5)
        for end in ("pre", "post"):
            joined = frontier.join(by[end], frontier["root_id"] == by[end][end])
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan.replace("SelectedBucketsCount", "") or "bucketed" in plan.lower()
            assert joined.count() == edges.join(frontier, edges[end] == frontier["root_id"]).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_sources_and_groups(spark, edges, annotations, tmp_path):
    path = str(tmp_path / "c.csv")
    with open(path, "w") as f:
        f.write("a,b,c,d,e\n" + "".join(f"{a + BASE},{b + BASE},{n},{w},{t}\n" for a, b, n, w, t in ROWS))
    assert sorted(map(tuple, tables.read_connections(spark, path).collect())) == sorted(map(tuple, edges.collect()))
    with open(path, "a") as f:
        f.write("1,2,X\n")
    with pytest.raises(Exception):
        tables.read_connections(spark, path).collect()
    with pytest.raises(ValueError):
        tables.read_connections(spark, str(tmp_path / "c.txt"))
    tables.save({"e": edges.withColumn("grp", F.lit("g"))}, str(tmp_path / "out"), {"e": "grp"})
    assert tables.load(spark, str(tmp_path / "out"), "e")["e"].count() == 13
    with open(str(tmp_path / "a.tsv"), "w") as f:
        f.write("root_id\tcell_type\themibrain_type\n" + f"{1 + BASE}\tA\t\n{5 + BASE}\t\tD\n")
    assert sorted(map(tuple, tables.read_annotations(spark, str(tmp_path / "a.tsv")).collect())) == [(1 + BASE, "A", None), (5 + BASE, None, "D")]
    older = edges.union(spark.createDataFrame([(-1, 2, "X", 1, "ACH"), (3, -1, "X", 1, "ACH"), (None, 4, "X", 1, "ACH")], EDGES))
    assert tables.without_sentinel(older).count() == 13 and tables.without_sentinel(older.where("pre is null")).count() == 0
    with pytest.raises(ValueError, match="columns missing: root_id"):
        G.lookup(annotations.drop("root_id"), "A")
    spec = {"c": "C", "d": F.col("hemibrain_type") == "D", "one": 1 + BASE, "some": [2 + BASE, 2 + BASE], "df": annotations.limit(2)}
    assert {r.grp: r["count"] for r in G.resolve(annotations, spec).groupBy("grp").count().collect()} == {"c": 2, "d": 1, "one": 1, "some": 1, "df": 2}
    assert G.threshold(edges, 11, "pair").count() == 3 and G.threshold(edges, 11).count() == 1
    with pytest.raises(Exception, match="annotated twice"):
        N.node_table(P.one_hop(edges, group(spark, A=[1])), annotations.union(annotations)).collect()


def test_ranks_and_running_sums(spark):
    """Over ranges, as one sorted list would give them: a key of most rows, null keys, ties told apart by another column."""
    random.seed(2)
    rows = [("hot" if i % 3 else random.choice(["a", "b", None]), random.randint(0, 5), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(5)
    got = running(df, ["k"], [F.desc("v"), "i"], "v", "s").collect()
    for key in {r[0] for r in rows}:
        total = 0
        want = {}
        for _, v, i in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])):
            total += v
            want[i] = total
        assert {r["i"]: r["s"] for r in got if r["k"] == key} == want
    assert sorted(r["place"] for r in running(df, [], ["i"]).collect()) == list(range(1, 401))
    assert running(df.where("false"), ["k"], ["i"]).count() == 0


def test_marginals_without_zeros(spark):
    """The same means, bins, scales and examples as over zero-filled rows: cells without any connection, cells in two groups, a group of one."""
    random.seed(8)
    edges = spark.createDataFrame([(random.choice(range(0, 30, 2)), random.randrange(30), "X", random.randint(1, 9), random.choice(["p", "q", None])) for _ in range(60)], EDGES)
    s = spark.createDataFrame([("a", i) for i in range(12)] + [("b", i) for i in range(10, 30)] + [("c", 99)], "grp string, root_id long")
    m = C.matrix(edges, s, s).cache()
    rows, full, keys = M.connected(m), C.marginals(m, edges, s, s).cache(), M.all_keys(edges, s, s)
    assert keys.count() == 3 * 3 * 3 * 2 and full.count() == 33 * 3 * 3 * 2
    plain = {}
    for r in full.collect():
        plain.setdefault((r.source_group, r.target_group, r.transmitter, r.side), []).append((r.synapses, r.cell))
    for fill in (keys, None):
        summary = M.summary(rows, s, s, fill=fill).cache()
        want = {k: v for k, v in plain.items() if fill is not None or any(x for x, _ in v)}
        got = {tuple(r)[:4]: (r.n, r["mean"]) for r in M.stats(summary).collect()}
        assert got == {k: (len(v), pytest.approx(sum(x for x, _ in v) / len(v))) for k, v in want.items()}
        bins = {tuple(r)[:5]: r.cells for r in M.histogram(rows, summary, 4).collect()}
        assert bins == Counter((*k, x // 4) for k, v in want.items() for x, _ in v)
        picked = {}
        for r in M.examples(rows, summary, s, s).collect():
            picked.setdefault((r.source_group, r.target_group, "all", r.side), set()).add((r.sel_rank, r.cell, r.synapses))
        ranked = {k: sorted(v) for k, v in want.items() if k[2] == "all"}
        assert picked == {k: {(i, v[i][1], v[i][0]) for i in {round(p * (len(v) - 1)) for p in (0, 0.25, 0.5, 0.75, 1)}} for k, v in ranked.items()}
        for r in M.scaled(rows, summary).collect():
            v = [x for x, _ in plain[r.source_group, r.target_group, "all", r.side]]
            low, top = (0, max(v)) if r.side == "target" else (min(v), max(v))
            assert r.scaled == (pytest.approx((r.synapses - low) / (top - low)) if top > low else None)
    order = {(r.side, r.cell): r.position for r in M.order(rows).where("source_group = 'a' and target_group = 'b'").collect()}
    for side in ("source", "target"):
        assert [c for (x, c), _ in sorted(order.items(), key=lambda t: t[1]) if x == side] == [c for n, c in sorted(plain["a", "b", "all", side], key=lambda t: (-t[0], t[1])) if n]


def test_bitmaps_of_many_groups(spark):
    """130 groups in three words: the same rows as group by group, and the same grids as from each two groups' rows."""
    random.seed(11)
    edges = spark.createDataFrame([(random.randrange(60), random.randrange(60), random.choice("XY"), 1, "p") for _ in range(150)], EDGES).distinct().cache()
    ids = {f"g{k:03}": random.sample(range(60), random.randint(1, 3)) for k in range(130)}
    groups = spark.createDataFrame([(g, i) for g, xs in ids.items() for i in xs] + [(None, 1)], "grp string, root_id long")
    names = B.numbered(groups)
    start = B.members(groups, names)
    e = {(r.pre, r.post) for r in edges.collect()}

    def hops(roots, again):
        seen, front, out = set(roots), set(roots), {}
        for h in range(1, 4):
            rows = {(a, b) for a, b in e if a in front and (again or b not in seen)}
            front = {b for _, b in rows} - (set() if again else seen)
            out[h] = rows
            seen |= front
        return out

    plain = {(g, a, b, h) for g, xs in ids.items() for h, rows in hops(xs, False).items() for a, b in rows}
    sets = B.path_sets(edges, start, 3).cache()
    assert {(r.grp, r.pre, r.post, r.hop) for r in B.path_rows(sets, names).collect()} == plain
    again = B.path_rows(B.path_sets(edges, start, 3, skip_recurrents=False), names)
    assert {(r.grp, r.pre, r.post, r.hop) for r in again.collect()} == {(g, a, b, h) for g, xs in ids.items() for h, rows in hops(xs, True).items() for a, b in rows}
    assert {tuple(r) for r in B.hop_summary(sets, names).collect()} == {tuple(r) for r in P.hop_summary(B.path_rows(sets, names)).collect()}
    shared = B.shared_pairs(sets, names).cache()
    of = {}
    for g, a, b, h in plain:
        of.setdefault((a, b), []).append((g, h))
    degree, leaves, enters, pairs = Counter(), set(), set(), Counter()
    for (a, b), gs in of.items():
        for g, h in gs:
            for x, i in gs:
                if g < x:
                    pairs[g, x] += 1
                    degree[g, x, h - 1, i - 1] += 1
                    degree[g, x, h, i] += 1
                    leaves.add((g, x, h - 1, i - 1, a))
                    enters.add((g, x, h, i, b))
    assert {(r.group_a, r.group_b): r.pairs for r in B.intersections(shared).collect()} == pairs
    assert {tuple(r)[:4]: r.degree for r in B.degree_grids(shared).collect()} == degree
    grid = {tuple(r)[:4]: (r.cells, r.initial_cells) for r in B.cell_grids(sets, names).collect()}
    whole, first = Counter(c[:4] for c in leaves | enters), Counter(c[:4] for c in leaves - enters)
    assert grid == {k: (n, first[k]) for k, n in whole.items()}
    assert {tuple(r) for r in B.common_rows(sets, names, "g001", "g002").select("pre", "post").collect()} == {p for p, gs in of.items() if {"g001", "g002"} <= {g for g, _ in gs}}
    assert P.paths(edges, groups.where("false"), 2).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, 1)], [(1, 2), (2, 3)], [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3)], None])
def test_strong_components(spark, rows):
    random.seed(3)
    rows = [(random.randrange(40), random.randrange(40)) for _ in range(55)] if rows is None else rows
    reach = set(rows)
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    cells = {x for r in rows for x in r}
    of = {c: min([c, *(x for x in cells if (c, x) in reach and (x, c) in reach)]) for c in cells}
    df = spark.createDataFrame([*rows, *rows[:1], (None, 7)], "pre long, post long")
    assert dict(map(tuple, Y.strong_components(df).collect())) == of
    assert {r[0] for r in Y.beginnings(df).collect()} == {c for c in cells if all(of[a] == of[b] for a, b in reach if b == c)}


def test_initial_cells_with_recurrents(spark, edges):
    """On the hand graph 1 > 3, 4 > 6 > 1 is a cycle that nothing enters, and no cell is only `pre`."""
    rows = P.paths(edges, group(spark, A=[1], B=[3]), 4, skip_recurrents=False)
    common = V.edge_intersection(rows, "A", "B")
    assert V.initial_cells(common).count() == 0
    assert {r[0] - BASE for r in Y.beginnings(common).collect()} == {1, 3, 4, 6}


@pytest.mark.parametrize("per,down", [("row", True), ("row", False), ("pair", True)])
def test_every_threshold_from_one_run(spark, edges, per, down):
    random.seed(5)
    more = edges.union(spark.createDataFrame([(random.randrange(9) + BASE, random.randrange(9) + BASE, "Z", random.randint(0, 14), "GLUT") for _ in range(40)], EDGES)).distinct().cache()
    groups = group(spark, A=[1, 5], B=[2])
    rows = T.paths(more, groups, 4, down=down, per=per).cache()
    for k in (0, 4, 9, 14, 40):
        own = P.paths(G.threshold(more, k, per), groups, 4, downstream=down, upstream=not down)
        assert sorted(map(str, T.at_threshold(rows, k).collect())) == sorted(map(str, own.collect())), k
    assert T.hop_summaries(rows, [4, 9]).where("threshold = 9").drop("threshold").count() == P.hop_summary(T.at_threshold(rows, 9)).count()


def test_hubs_in_parts(spark, monkeypatch):
    """A cell with most of the edges is spread over many parts; hops, visits and thresholds come out as without."""
    monkeypatch.setattr(hubs, "HUB_EDGES", 20)
    random.seed(9)
    pairs = {(0, i) for i in range(1, 400)} | {(i, 0) for i in range(1, 400, 7)} | {(random.randrange(400), random.randrange(400)) for _ in range(200)}
    edges = spark.createDataFrame([(a, b, "X", random.randint(1, 9), "p") for a, b in sorted(pairs)], EDGES).cache()
    laid = hubs.FromEnd(edges.select("pre", "post"), "pre", "post")
    of = Counter(map(tuple, laid.edges.select("pre", "_part").collect()))
    assert len([k for k in of if k[0] == 0]) >= 15 and max(of.values()) <= 60 and sum(of.values()) == len(pairs)
    groups = spark.createDataFrame([("g", 7), ("g", 14), ("h", 3)], "grp string, root_id long")
    trans = W.transitions(edges)
    few = [P.hop_summary(P.paths(edges, groups, 3)), T.hop_summaries(T.paths(edges, groups, 3), [1, 5]), W.expected_visits(trans, groups, 3).select("start", "level", "root_id", F.round("p", 9))]
    few = [sorted(map(str, x.collect())) for x in few]
    monkeypatch.setattr(hubs, "HUB_EDGES", 10_000)
    many = [P.hop_summary(P.paths(edges, groups, 3)), T.hop_summaries(T.paths(edges, groups, 3), [1, 5]), W.expected_visits(trans, groups, 3).select("start", "level", "root_id", F.round("p", 9))]
    assert few == [sorted(map(str, x.collect())) for x in many] and all(few)


def test_all_convergences(spark, edges):
    """For three groups at once, what the analysis of each two gives, from all hits."""
    groups = group(spark, A=[1], B=[2], C=[3, 5])
    whole = analyses.all_convergences(edges, groups, 3)
    whole = {k: v.cache() for k, v in whole.items()}
    of = lambda k, a, b: whole[k].where((F.col("group_a") == a) & (F.col("group_b") == b))
    for a, b in (("A", "B"), ("A", "C"), ("B", "C")):
        own = analyses.downstream_convergence(edges, groups, a, b, use_inits=False, max_hops=3)
        grid = {(r.level_a, r.level_b): (r.cells, r.degree, r.initial_cells) for r in own["overlap"].where("cells > 0").collect()}
        degree = {(r.level_a, r.level_b): r.degree for r in of("degree", a, b).collect()}
        assert {(r.level_a, r.level_b): (r.cells, degree[r.level_a, r.level_b], r.initial_cells) for r in of("cells", a, b).collect()} == grid
        assert of("pairs", a, b).first().pairs == own["common"].select("pre", "post").distinct().count()
        scores = {r.root_id: pytest.approx(r.score) for r in own["score"].where("score > 0").collect()}
        assert {r.root_id: r.score for r in of("scores", a, b).collect()} == scores and scores
        shares = {(r.level_a, r.level_b): pytest.approx(r.share) for r in own["visit_overlap"].where("share > 0").collect()}
        assert {(r.level_a, r.level_b): r.share for r in of("visits", a, b).where("share > 0").collect()} == shares
