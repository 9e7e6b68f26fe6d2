"""The registered queries of the graph operators over the derived graphs, and their SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.storage import durable, shared_dir
from .operators import bitmaps as B
from .operators import connectivity as C
from .operators import convergence as V
from .operators import cycles as Y
from .operators import groups as G
from .operators import marginals as M
from .operators import nodes as N
from .operators import paths as P
from .operators import stats as S
from .operators import thresholds as T
from .operators import walks as W
from .plans import analyses
from .sources import derive, results, tables

THRESHOLD, HOPS = 46, 5
#: Replicates of the registered bootstraps.
BOOT_REPS = 2000
#: Hops of the queries over all types at once.
TYPE_HOPS = 3
#: Thresholds that one run of the bottleneck expansion answers.
THRESHOLDS = [30, 35, 40, 42, 44, 46, 47, 48, 49, 50]


def _spec() -> dict:
    kind, brand = F.col("cell_type"), F.col("hemibrain_type")
    return {"a": (kind == "PROMO") & (brand == "Brand#8"), "b": (kind == "LARGE") & (brand == "Brand#4")}


class _Parts:
    """What the path queries share: the thresholded part graph, the standard groups and their path sets."""

    def __init__(self, spark: SparkSession, d: str):
        self.annotations = derive.part_annotations(spark, d)
        self.all_edges = derive.connections(spark, d, "l_partkey")
        self.edges = durable(G.threshold(self.all_edges, THRESHOLD))
        self.groups = durable(G.resolve(self.annotations, _spec()))

    def paths(self, **options) -> DataFrame:
        return durable(P.paths(self.edges, self.groups, HOPS, **options))

    def nodes(self, rows: DataFrame) -> DataFrame:
        return durable(N.node_table(rows))


class _AllTypes:
    """The thresholded part graph and a group for every type and brand of parts, their path sets as bitmaps."""

    def __init__(self, spark: SparkSession, d: str):
        self.edges = durable(G.threshold(derive.connections(spark, d, "l_partkey"), THRESHOLD))
        cells = derive.part_annotations(spark, d).withColumn("kind", F.concat_ws(" ", "cell_type", "hemibrain_type"))
        self.groups = durable(G.by_type(cells, "kind"))
        self.names = B.numbered(self.groups)

    def sets(self, **options) -> DataFrame:
        return durable(B.path_sets(self.edges, B.members(self.groups, self.names), TYPE_HOPS, **options))

    def shared(self) -> DataFrame:
        return durable(B.shared_pairs(self.sets(), self.names))


def _thresholded(per: str = "row", down: bool = True):
    """The part graph's path rows for all thresholds, without a threshold before."""

    def rows(s, d):
        p = _Parts(s, d)
        return durable(T.paths(p.all_edges, p.groups, HOPS, per=per, down=down))

    return rows


def _all_convergences(s, d) -> dict:
    t = _AllTypes(s, d)
    return analyses.all_convergences(t.edges, t.groups, TYPE_HOPS)


def _all_types(f):
    return lambda s, d: f(_AllTypes(s, d))


def _own(df: DataFrame, g: str) -> DataFrame:
    return df.where(F.col("grp") == g)


class _Meeting(_Parts):
    """The two standard groups' path sets, their cells and what they have in common."""

    def __init__(self, spark: SparkSession, d: str):
        super().__init__(spark, d)
        self.rows = self.paths()
        self.cells = self.nodes(self.rows)
        self.common = durable(V.edge_intersection(self.rows, "a", "b"))
        self.shared = durable(V.intersection_nodes(self.common, _own(self.cells, "b")))
        self.top = N.max_level(self.cells)

    def visits(self, g: str, first: bool = False, per_start: bool = False) -> DataFrame:
        other = _own(self.cells, "b" if g == "a" else "a")
        return W.expected_visits(W.transitions(_own(self.rows, g)), _own(self.cells, g).where("level = 0"), HOPS, absorb=other if first else None, per_start=per_start)

    def hits(self, g: str, first: bool) -> DataFrame:
        return durable(W.hits_in(self.visits(g, first), _own(self.cells, "b" if g == "a" else "a")))


class _Panel:
    """Suppliers grouped by nation: those of one region onto those of another, or all onto all."""

    def __init__(self, spark: SparkSession, d: str, everything: bool = False):
        cells = durable(derive.supplier_annotations(spark, d))
        self.edges = durable(derive.connections(spark, d, "l_suppkey"))
        self.sources = G.by_type(cells if everything else cells.where("hemibrain_type = 'ASIA'"))
        self.targets = G.by_type(cells if everything else cells.where("hemibrain_type in ('ASIA', 'EUROPE')"))
        self.matrix = durable(C.matrix(self.edges, self.sources, self.targets))

    def marginals(self) -> DataFrame:
        return durable(C.marginals(self.matrix, self.edges, self.sources, self.targets))

    def connected(self) -> DataFrame:
        return durable(M.connected(self.matrix))

    def summary(self, rows: DataFrame, value: str = "synapses", fill: bool = True) -> DataFrame:
        return M.summary(rows, self.sources, self.targets, value, M.all_keys(self.edges, self.sources, self.targets) if fill else None)

    def examples(self) -> DataFrame:
        rows = self.connected()
        return M.examples(rows, durable(self.summary(rows)), self.sources, self.targets)


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _paths(**options):
    return lambda s, d: P.hop_summary(_Parts(s, d).paths(**options))


def _resolve(s, d):
    p = _Parts(s, d)
    spec = _spec() | {"promo": "PROMO", "one": 17, "some": [3, 5, 3, 8]}
    return G.resolve(p.annotations, spec).groupBy("grp").agg(F.count("*").alias("cells"), F.sum("root_id").alias("id_sum"))


def _wide(s, d):
    m = _Meeting(s, d)
    v = W.visits_wide(m.visits("a"), HOPS)
    return _r(v, *[f"v{i}" for i in range(HOPS + 1)])


def _level_totals(s, d):
    m = _Meeting(s, d)
    parts = [W.level_totals(m.visits(g), m.shared).select(F.lit(g).alias("grp"), "level", "total", "scaled") for g in "ab"]
    return _r(parts[0].unionByName(parts[1]), "total", "scaled")


def _visit_query(first: bool, all_hits: bool):
    def query(s, d):
        m = _Meeting(s, d)
        v = m.visits("a", first, per_start=True)
        if first or all_hits:
            v = W.hits_in(v, _own(m.cells, "b"))
        return _r(v, "p").where("p > 0")

    return query


def _strongest(side: str):
    def query(s, d):
        p = _Panel(s, d)
        return _r(C.strongest_partner(p.matrix, durable(p.examples()), side), "strength")

    return query


def _marginal_stats(value: str):
    return _panel(lambda p: _r(M.stats(p.summary(p.connected(), value)), "mean", "low", "high"))


def _histogram(width: int, value: str = "synapses", everything: bool = False):
    def query(s, d):
        p = _Panel(s, d, everything)
        rows = p.connected()
        return M.histogram(rows, p.summary(rows, value, not everything), width, value)

    return query


def _convergence(s, d):
    p = _Parts(s, d)
    return _r(analyses.downstream_convergence(p.edges, p.groups, "a", "b", max_hops=HOPS)["score"], "score")


def _connectivity(s, d):
    p = _Panel(s, d)
    out = analyses.connectivity_panel(p.edges, p.sources, p.targets)
    both = [_r(out[f"{v}_stats"], "mean", "low", "high").select(F.lit(v).alias("value"), "*") for v in ("synapses", "partners")]
    return both[0].unionByName(both[1])


def _meeting(f):
    return lambda s, d: f(_Meeting(s, d))


def _panel(f):
    return lambda s, d: f(_Panel(s, d))


def _pair_thresholded(s, d):
    e = derive.connections(s, d, "l_suppkey")
    return G.collapse(G.threshold(e, 150, per="pair"))


def _from_csv(s, d):
    """The part graph as an older export, with a sentinel for cells without a partner and other names in the header, read back."""
    e = derive.connections(s, d, "l_partkey")
    lone = e.select("pre").distinct().selectExpr("pre", "-1L as post", "'' as neuropil", "1L as weight", "'' as transmitter")
    path = f"{shared_dir(s)}/{uuid.uuid4().hex}.csv"
    e.unionByName(lone).toDF("a", "b", "c", "d", "e").write.option("header", True).csv(path)
    return tables.without_sentinel(tables.read_connections(s, path))


def _from_tsv(s, d):
    path = f"{shared_dir(s)}/{uuid.uuid4().hex}.tsv"
    derive.part_annotations(s, d).write.option("header", True).option("sep", "\t").csv(path)
    return tables.read_annotations(s, path)


def _kept(s, d):
    """Path rows of one group computed and kept, then asked for with both: the first is read, the second computed."""
    p, folder = _Parts(s, d), f"{shared_dir(s)}/{uuid.uuid4().hex}"
    ask = lambda groups: results.kept(folder, "paths", p.edges, groups, {"hops": HOPS}, lambda g: P.paths(p.edges, g, HOPS))
    ask(_own(p.groups, "a"))
    return ask(p.groups)


def queries() -> dict:
    return {
        "edges_thresholded": lambda s, d: G.threshold(derive.connections(s, d, "l_partkey"), THRESHOLD),
        "pair_thresholded": _pair_thresholded,
        "lookup_group": lambda s, d: G.lookup(derive.part_annotations(s, d), "PROMO"),
        "resolve_groups": _resolve,
        "paths_downstream": _paths(),
        "paths_upstream": _paths(downstream=False, upstream=True),
        "paths_both": _paths(upstream=True),
        "paths_recurrent": _paths(skip_recurrents=False),
        "one_hop": lambda s, d: P.one_hop((p := _Parts(s, d)).edges, p.groups),
        "path_edges": lambda s, d: _Parts(s, d).paths(),
        "hop_summary": lambda s, d: P.hop_summary(P.one_hop((p := _Parts(s, d)).all_edges, p.groups)),
        "path_size": lambda s, d: P.path_size(_Parts(s, d).paths()),
        "node_levels": lambda s, d: N.levels(_Parts(s, d).paths()),
        "node_levels_both": lambda s, d: N.levels(_Parts(s, d).paths(upstream=True)),
        "node_degree": lambda s, d: N.degrees(_Parts(s, d).paths()),
        "node_info": lambda s, d: N.node_table((p := _Parts(s, d)).paths(), p.annotations),
        "level_profile": _meeting(lambda m: N.level_profile(m.cells, m.top)),
        "edge_intersection": _meeting(lambda m: m.common),
        "all_intersections": _meeting(lambda m: V.all_intersections(m.rows)),
        "initial_cells": _meeting(lambda m: V.initial_cells(m.common)),
        "intersection_nodes": _meeting(lambda m: m.shared),
        "level_overlap": _meeting(lambda m: V.level_overlap(m.shared, m.top).select("level_a", "level_b", "cells", "degree")),
        "level_overlap_initial": _meeting(lambda m: V.level_overlap(m.shared, m.top).select("level_a", "level_b", "initial_cells", "initial_degree")),
        "overlap_marginals": _meeting(lambda m: V.overlap_marginals(V.level_overlap(m.shared, m.top))),
        "transition_probs": lambda s, d: _r(W.transitions(_own(_Parts(s, d).paths(), "a")), "p"),
        "cumulative_weights": lambda s, d: W.cumulative(W.transitions(_own(_Parts(s, d).paths(), "a"))).drop("p"),
        "expected_visits": _visit_query(False, False),
        "first_hits": _visit_query(True, False),
        "all_hits": _visit_query(False, True),
        "visits_wide": _wide,
        "visit_level_totals": _level_totals,
        "visit_overlap": _meeting(lambda m: _r(V.visit_overlap(m.hits("a", False), m.hits("b", False), m.shared, m.top), "share")),
        "convergence_score": _meeting(lambda m: _r(V.convergence_score(m.hits("a", False), m.hits("b", False), m.shared), "score")),
        "type_share": _meeting(lambda m: W.type_share(m.visits("a"), m.annotations)),
        "type_composition": _meeting(lambda m: V.type_composition(m.shared, m.annotations)),
        "visit_overlap_first": _meeting(lambda m: _r(V.visit_overlap(m.hits("a", True), m.hits("b", True), m.shared, m.top), "share")),
        "convergence_score_first": _meeting(lambda m: _r(V.convergence_score(m.hits("a", True), m.hits("b", True), m.shared), "score")),
        "first_hit_levels": _meeting(lambda m: _r(W.first_hit_levels(m.hits("a", True)), "p")),
        "type_share_hits": _meeting(lambda m: W.type_share(m.visits("a"), m.annotations, cells=_own(m.cells, "b"))),
        "collapse_last": lambda s, d: G.collapse(G.threshold(derive.connections(s, d, "l_suppkey"), 30), "last", "neuropil"),
        "analysis_pathways": lambda s, d: analyses.pathways((p := _Parts(s, d)).edges, p.groups, p.annotations, max_hops=HOPS)["nodes"],
        "analysis_convergence": _convergence,
        "analysis_connectivity": _connectivity,
        "paths_all_types": _all_types(lambda t: B.hop_summary(t.sets(), t.names)),
        "paths_all_types_upstream": _all_types(lambda t: B.hop_summary(t.sets(down=False), t.names)),
        "paths_all_types_recurrent": _all_types(lambda t: B.hop_summary(t.sets(skip_recurrents=False), t.names)),
        "all_types_intersections": _all_types(lambda t: B.intersections(t.shared())),
        "all_types_degree_grids": _all_types(lambda t: B.degree_grids(t.shared())),
        "all_types_cell_grids": _all_types(lambda t: B.cell_grids(t.sets(), t.names)),
        "all_types_visit_grids": lambda s, d: _r(_all_convergences(s, d)["visits"], "share"),
        "all_types_scores": lambda s, d: _r(_all_convergences(s, d)["scores"], "score").where("score > 0"),
        "common_rows_of_types": _all_types(lambda t: B.common_rows(t.sets(), t.names, "LARGE Brand#4", "PROMO Brand#8")),
        "strong_components": lambda s, d: Y.strong_components(_Parts(s, d).edges),
        "initial_cells_recurrent": lambda s, d: Y.beginnings(durable(V.edge_intersection(_Parts(s, d).paths(skip_recurrents=False), "a", "b"))),
        "beginnings_of_graph": lambda s, d: Y.beginnings(_Parts(s, d).edges),
        "paths_by_threshold": lambda s, d: T.hop_summaries(_thresholded()(s, d), THRESHOLDS),
        "paths_by_threshold_upstream": lambda s, d: T.hop_summaries(_thresholded(down=False)(s, d), THRESHOLDS),
        "paths_by_pair_threshold": lambda s, d: T.hop_summaries(_thresholded("pair")(s, d), THRESHOLDS),
        "threshold_after_paths": lambda s, d: T.at_threshold(_thresholded()(s, d), THRESHOLD),
        "connections_from_csv": _from_csv,
        "annotations_from_tsv": _from_tsv,
        "kept_paths": _kept,
        "connectivity_matrix": _panel(lambda p: C.of_all(p.matrix).where("source_group = 'NATION_12' and target_group = 'NATION_13'")),
        "connectivity_panel": _panel(lambda p: C.of_all(p.matrix)),
        "connectivity_by_transmitter": _panel(lambda p: p.matrix),
        "connectivity_marginals": _panel(lambda p: p.marginals()),
        "connectivity_dense": _panel(lambda p: C.dense(p.matrix, p.sources, p.targets, "NATION_12", "NATION_13")),
        "transmitter_totals": _panel(lambda p: C.transmitter_totals(p.matrix, p.edges)),
        "matrix_order": _panel(lambda p: C.order(p.marginals())),
        "scaled_totals": _panel(lambda p: _r(M.scaled(p.marginals(), p.summary(p.connected())), "scaled")),
        "example_cells": _panel(lambda p: p.examples()),
        "strongest_partner": _strongest("target"),
        "strongest_source_partner": _strongest("source"),
        "marginal_stats": _marginal_stats("synapses"),
        "partner_stats": _marginal_stats("partners"),
        "partner_histogram": _histogram(3, "partners"),
        "marginal_histogram": _histogram(25),
        "panel_all_types": lambda s, d: _r(M.stats((p := _Panel(s, d, True)).summary(p.connected(), fill=False)), "mean", "low", "high"),
        "panel_all_histogram": _histogram(2, "partners", True),
        "panel_all_marginals": lambda s, d: _Panel(s, d, True).connected(),
        "panel_all_examples": lambda s, d: _Panel(s, d, True).examples(),
        "panel_all_scaled": lambda s, d: _r(M.scaled(rows := (p := _Panel(s, d, True)).connected(), p.summary(rows, fill=False)), "scaled"),
        "bootstrap_ci": _panel(lambda p: _r(S.bootstrap_ci(p.connected(), p.sources, p.targets, reps=BOOT_REPS), "mean", "low", "high")),
        "bootstrap_ci_partners": _panel(lambda p: _r(S.bootstrap_ci(p.connected(), p.sources, p.targets, "partners", reps=BOOT_REPS), "mean", "low", "high")),
    }


_LEAD = "lead({k}) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"
_EDGES = "select pre, post, neuropil, cast(sum(q) as bigint) weight, transmitter from (select {k} pre, " + _LEAD + " post, l_returnflag neuropil, l_linestatus transmitter, cast(l_quantity as bigint) q from lineitem) where post is not null group by pre, post, neuropil, transmitter"


def _parts_sql(groups: str, hops: int) -> str:
    return f"""with recursive e0 as ({_EDGES.format(k="l_partkey")}), e as (select * from e0 where weight >= {THRESHOLD}),
g as ({groups}),
wd as (select grp, root_id node, 0 hop from g union select grp, post, hop + 1 from wd join e on node = pre where hop < {hops}),
wu as (select grp, root_id node, 0 hop from g union select grp, pre, hop + 1 from wu join e on node = post where hop < {hops}),
dd as (select grp, node, min(hop) d from wd group by all), du as (select grp, node, min(hop) d from wu group by all),
p as (select a.grp, pre, post, neuropil, weight, transmitter, b.d as hop from e join dd a on pre = a.node join dd b on post = b.node and a.grp = b.grp and b.d = a.d + 1),
pu as (select a.grp, pre, post, neuropil, weight, transmitter, -b.d as hop from e join du a on post = a.node join du b on pre = b.node and a.grp = b.grp and b.d = a.d + 1),
pb as (select * from p union all select * from pu),
pr as (select grp, pre, post, neuropil, weight, transmitter, w.hop + 1 as hop from e join wd w on pre = node where w.hop < {hops})
"""


_PARTS = _parts_sql("select 'a' grp, p_partkey root_id from part where p_type = 'PROMO' and p_brand = 'Brand#8' union select 'b', p_partkey from part where p_type = 'LARGE' and p_brand = 'Brand#4'", HOPS)
_TYPES = _parts_sql("select p_type || ' ' || p_brand grp, p_partkey root_id from part", TYPE_HOPS)


def _nodes(p: str, name: str) -> str:
    key = "case when hop > 0 then abs(hop) else 1000 + abs(hop) end"
    return f"""{name}1 as (select grp, pre root_id, arg_min(hop, {key}) h from {p} group by all), {name}2 as (select grp, post root_id, arg_min(hop, {key}) h from {p} group by all),
{name}d as (select grp, root_id, count(*) degree from (select distinct grp, pre, post, x root_id from (select grp, pre, post, pre x, 0 s from {p} union select grp, pre, post, post, 1 from {p} where pre != post) union all select distinct grp, pre, post, pre from {p} where pre = post) group by all),
{name} as (select grp, root_id, cast(coalesce(case when a.h > 0 then a.h - 1 else a.h end, case when b.h > 0 then b.h else b.h + 1 end) as int) as level, degree from {name}1 a full join {name}2 b using (grp, root_id) join {name}d using (grp, root_id))
"""


def _summary(p: str) -> str:
    return f"select grp, hop, count(distinct case when hop > 0 then post else pre end) cells, cast(sum(weight) as bigint) synapses, count(*) n_rows from {p} group by grp, hop"


_MEET = _PARTS + "," + _nodes("p", "n") + """, common as (select * from p where grp = 'a' and (pre, post) in (select (pre, post) from p where grp = 'b')),
""" + _nodes("common", "c") + """, top as (select max(level) t from n), initial as (select distinct pre root_id from common where pre not in (select post from common)),
shared as (select c.root_id, c.level level_a, n.level level_b, c.degree, c.root_id in (select root_id from initial) as initial from c join n on n.grp = 'b' and n.root_id = c.root_id),
grid as (select cast(a as int) level_a, cast(b as int) level_b from (select unnest(range(t + 1)) a from top), (select unnest(range(t + 1)) b from top)),
tr as (select grp, pre, post, w weight, w / sum(w) over (partition by grp, pre) prob from (select grp, pre, post, cast(sum(weight) as bigint) w from p group by all))
"""


def _visits(name: str, g: str, first: bool) -> str:
    other = "b" if g == "a" else "a"
    out = [f"{name}0 as (select root_id as start, root_id, 1.0::double p from n where grp = '{g}' and level = 0)"]
    for i in range(1, HOPS + 1):
        stop = f" and {name}{i - 1}.root_id not in (select root_id from n where grp = '{other}')" if first and i > 1 else ""
        out.append(f"{name}{i} as (select start, post root_id, sum(p * prob) p from {name}{i - 1} join tr on tr.grp = '{g}' and pre = {name}{i - 1}.root_id where true{stop} group by all)")
    out.append(f"{name} as (" + " union all ".join(f"select start, {i} as level, root_id, p from {name}{i}" for i in range(HOPS + 1)) + ")")
    return ", ".join(out)


_VISITS = _MEET + "," + _visits("va", "a", False) + "," + _visits("vb", "b", False) + "," + _visits("fa", "a", True) + "," + _visits("fb", "b", True) + """,
ha as (select * from va where level = 0 or root_id in (select root_id from n where grp = 'b')), hb as (select * from vb where level = 0 or root_id in (select root_id from n where grp = 'a')),
hf as (select * from fa where level = 0 or root_id in (select root_id from n where grp = 'b')), hg as (select * from fb where level = 0 or root_id in (select root_id from n where grp = 'a'))
"""


def _panel_sql(sources: str, targets: str) -> str:
    return f"""with e as ({_EDGES.format(k="l_suppkey")}), cells as (select s_suppkey root_id, n_name grp, r_name region from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
s as (select grp source_group, root_id pre from cells where {sources}), t as (select grp target_group, root_id post from cells where {targets}),
x as (select source_group, target_group, transmitter, pre, post, weight from e join s using (pre) join t using (post)),
m as (select source_group, target_group, transmitter, pre, post, cast(sum(weight) as bigint) synapses from x group by all union all select source_group, target_group, 'all', pre, post, cast(sum(weight) as bigint) from x group by all),
kinds as (select distinct transmitter from e union select 'all'),
cell as (select source_group, tg.target_group, transmitter, 'source' side, pre as cell from s, (select distinct target_group from t) tg, kinds union all select sg.source_group, target_group, transmitter, 'target', post from t, (select distinct source_group from s) sg, kinds),
found as (select source_group, target_group, transmitter, 'source' side, pre as cell, sum(synapses) synapses, count(*) filter (synapses > 0) partners from m group by all union all select source_group, target_group, transmitter, 'target', post, sum(synapses), count(*) filter (synapses > 0) from m group by all),
mg as (select cell.*, cast(coalesce(synapses, 0) as bigint) synapses, cast(coalesce(partners, 0) as bigint) partners from cell left join found using (source_group, target_group, transmitter, side, cell)),
rk as (select *, row_number() over (partition by source_group, target_group, side order by synapses, cell) - 1 r, count(*) over (partition by source_group, target_group, side) n from mg where transmitter = 'all'),
ex as (select source_group, target_group, side, cell, synapses, cast(r as int) sel_rank from rk where r in (round_even(0.0 * (n - 1), 0), round_even(0.25 * (n - 1), 0), round_even(0.5 * (n - 1), 0), round_even(0.75 * (n - 1), 0), round_even(1.0 * (n - 1), 0)))
"""


_PANEL, _PANEL_ALL = _panel_sql("region = 'ASIA'", "region in ('ASIA', 'EUROPE')"), _panel_sql("true", "true")


def _overlap(a: str, b: str) -> str:
    return _VISITS + f", o as (select a.level level_a, b.level level_b, sum(a.p * b.p) x from (select root_id, level, sum(p) p from {a} group by all) a join (select root_id, level, sum(p) p from {b} group by all) b using (root_id) where root_id in (select root_id from shared) group by all) select level_a, level_b, round(coalesce(x, 0) / (select sum(x) from o), 6) as share from grid left join o using (level_a, level_b)"


def _score(a: str, b: str) -> str:
    return _VISITS + f"select root_id, round(coalesce((select sum(p) from {a} where {a}.root_id = shared.root_id), 0) * coalesce((select sum(p) from {b} where {b}.root_id = shared.root_id), 0), 6) score from shared"


def _stats(value: str, panel: str = _PANEL, more: str = "") -> str:
    half = f"{M.Z99} * stddev_pop({value}) / sqrt(count(*))"
    return panel + f"select {more}source_group, target_group, transmitter, side, count(*) n, round(avg({value}), 6) mean, round(avg({value}) - {half}, 6) low, round(avg({value}) + {half}, 6) high from mg group by all"


_REACH = ", cells as (select pre root_id from e union select post from e), reach as (select pre a, post b from e union select a, post from reach join e on pre = b)"
_BEGIN = " select root_id from cells where not exists (select 1 from reach r where r.b = root_id and not exists (select 1 from reach q where q.a = r.b and q.b = r.a))"


def _by_threshold(strength: str, near: str, far: str) -> str:
    """Every threshold expanded by itself."""
    groups = _PARTS[_PARTS.index("g as (") :].split("\nwd as")[0].rstrip(",")
    return f"""with recursive e0 as ({_EDGES.format(k="l_partkey")}), s as (select *, {strength} strength from e0), ks as (select unnest({THRESHOLDS}) k), {groups},
ek as (select k, s.* from s join ks on strength >= k), w as (select k, grp, root_id node, 0 hop from g, ks union select w.k, grp, {far}, hop + 1 from w join ek on node = {near} and w.k = ek.k where hop < {HOPS}),
d as (select k, grp, node, min(hop) d from w group by all), p as (select e.k, a.grp, pre, post, weight, b.d hop from ek e join d a on a.k = e.k and e.{near} = a.node join d b on b.k = e.k and b.grp = a.grp and e.{far} = b.node and b.d = a.d + 1)
select cast(k as int) threshold, grp, cast({'hop' if near == 'pre' else '-hop'} as int) hop, count(distinct {far}) cells, cast(sum(weight) as bigint) synapses, count(*) n_rows from p group by k, grp, hop"""


_EACH = ", each_ as (select distinct grp, pre, post, hop from p), both_ as (select a.grp group_a, b.grp group_b, a.pre, a.post, a.hop hop_a, b.hop hop_b from each_ a join each_ b on a.pre = b.pre and a.post = b.post and a.grp < b.grp) "
def _boot(value: str) -> str:
    weight = " + ".join(f"cast(u >= {w} as int)" for w in S.WEIGHTS)
    return _PANEL + f""", reps as (select unnest(range(1, {BOOT_REPS} + 1)) rep), w as (select cell, rep, {weight} w from (select cell, rep, ('0x' || substr(md5(rep || ':' || cell), 1, 8))::bigint u from (select distinct cell from mg), reps)),
ms as (select source_group, target_group, transmitter, side, rep, sum(w * {value}) / nullif(sum(w), 0) m from mg join w using (cell) group by all),
q as (select source_group, target_group, transmitter, side, quantile_cont(m, {(1 - 0.99) / 2}) low, quantile_cont(m, {1 - (1 - 0.99) / 2}) high from ms group by all)
select source_group, target_group, transmitter, side, count(*) n, round(avg({value}), 6) mean, round(any_value(low), 6) low, round(any_value(high), 6) high from mg join q using (source_group, target_group, transmitter, side) group by all having sum(synapses) > 0"""


_WALKS = ", ".join(f"v{i} as (select v{i - 1}.grp, post root_id, sum(p * prob) p from v{i - 1} join tr on tr.grp = v{i - 1}.grp and pre = root_id group by all)" for i in range(1, TYPE_HOPS + 1))
_COMMON = ", cc as (select distinct group_a, group_b, unnest([pre, post]) as cell from both_), tr as (select grp, pre, post, w / sum(w) over (partition by grp, pre) prob from (select grp, pre, post, sum(weight) w from p group by all)), v0 as (select distinct g.grp, root_id, 1.0::double p from g join p on p.grp = g.grp and pre = root_id), " + _WALKS + ", v as (" + " union all ".join(f"select grp, cast({i} as int) as level, root_id, p from v{i}" for i in range(TYPE_HOPS + 1)) + ") "
_ONLY = "select source_group, target_group, transmitter, side from mg group by all having sum(synapses) > 0"


def _partner(mine: str, theirs: str, side: str) -> str:
    keys = "source_group, target_group"
    return _PANEL + f""", sel as (select {keys}, cell {mine}, synapses total, sel_rank from ex where side = '{side}'), sx as (select m.*, total, sel_rank from m join sel using ({keys}, {mine}) where synapses > 0),
best as (select {keys}, {theirs} other, transmitter, {mine} partner, synapses weight, total from sx where transmitter != 'all' and (source_group, target_group, {theirs}) not in (select (source_group, target_group, {mine}) from sel) qualify row_number() over (partition by {keys}, {theirs} order by synapses desc, transmitter, sel_rank) = 1),
both_ as (select * from best union all select {keys}, {mine}, null, {mine}, total, total from sel), top as (select {keys}, max(synapses) top from sx where transmitter = 'all' group by all)
select {keys}, other, transmitter, partner, weight, round(weight / nullif(top, 0), 6) strength, partner || ' group (' || total || ' synapses)' as label from both_ left join top using ({keys})"""


def oracle_sql() -> dict[str, str]:
    keys = "source_group, target_group"
    return {
        "edges_thresholded": _PARTS + "select * from e",
        "pair_thresholded": f"with e as ({_EDGES.format(k='l_suppkey')}) select pre, post, cast(sum(weight) as bigint) weight from e group by pre, post having sum(weight) >= 150",
        "lookup_group": "select distinct p_partkey root_id from part where p_type = 'PROMO'",
        "resolve_groups": _PARTS + "select grp, count(*) cells, cast(sum(root_id) as bigint) id_sum from (select * from g union all select 'promo', p_partkey from part where p_type = 'PROMO' union all values ('one', 17), ('some', 3), ('some', 5), ('some', 8)) group by grp",
        "paths_downstream": _PARTS + _summary("p"),
        "paths_upstream": _PARTS + _summary("pu"),
        "paths_both": _PARTS + _summary("pb"),
        "paths_recurrent": _PARTS + _summary("pr"),
        "one_hop": _PARTS + "select grp, pre, post, neuropil, weight, transmitter, 1 hop from e join g on pre = root_id",
        "path_edges": _PARTS + "select * from p",
        "hop_summary": _PARTS + ", o as (select grp, e0.*, 1 hop from e0 join g on pre = root_id)" + _summary("o"),
        "path_size": _PARTS + "select grp, count(distinct x) cells, count(*) // 2 n_rows from (select grp, unnest([pre, post]) x from p) group by grp",
        "node_levels": _PARTS + "," + _nodes("p", "n") + "select grp, root_id, level from n",
        "node_levels_both": _PARTS + "," + _nodes("pb", "n") + "select grp, root_id, level from n",
        "node_degree": _PARTS + "," + _nodes("p", "n") + "select grp, root_id, degree from n",
        "node_info": _PARTS + "," + _nodes("p", "n") + "select grp, root_id, level, degree, p_type cell_type, p_brand hemibrain_type from n left join part on root_id = p_partkey",
        "level_profile": _MEET + "select gl.grp, cast(l as int) as level, count(root_id) cells, cast(coalesce(sum(degree), 0) as bigint) degree from (select grp, unnest(range(t + 1)) l from (select distinct grp from n), top) gl left join n on n.grp = gl.grp and n.level = l group by gl.grp, l",
        "edge_intersection": _MEET + "select * from common",
        "all_intersections": _MEET + "select 'a' group_a, 'b' group_b, count(*) pairs from (select distinct pre, post from common)",
        "initial_cells": _MEET + "select root_id from initial",
        "intersection_nodes": _MEET + "select * from shared",
        "level_overlap": _MEET + "select level_a, level_b, count(root_id) cells, cast(coalesce(sum(degree), 0) as bigint) degree from grid left join shared using (level_a, level_b) group by all",
        "level_overlap_initial": _MEET + "select level_a, level_b, count(root_id) initial_cells, cast(coalesce(sum(degree), 0) as bigint) initial_degree from grid left join (select * from shared where initial) using (level_a, level_b) group by all",
        "overlap_marginals": _MEET + ", o as (select level_a, level_b, count(root_id) cells, coalesce(sum(degree), 0) degree from grid left join shared using (level_a, level_b) group by all) select 'a' side, level_a as level, cast(sum(cells) as bigint) cells, cast(sum(degree) as bigint) degree from o group by level_a union all select 'b', level_b, cast(sum(cells) as bigint), cast(sum(degree) as bigint) from o group by level_b",
        "transition_probs": _MEET + "select pre, post, weight, round(prob, 6) p from tr where grp = 'a'",
        "cumulative_weights": _MEET + "select pre, post, weight, cast(sum(weight) over w as bigint) cum_hi, cast(sum(weight) over w - weight as bigint) cum_lo from tr where grp = 'a' window w as (partition by pre order by post rows unbounded preceding)",
        "expected_visits": _VISITS + "select start, level, root_id, round(p, 6) p from va where round(p, 6) > 0",
        "first_hits": _VISITS + "select start, level, root_id, round(p, 6) p from hf where round(p, 6) > 0",
        "all_hits": _VISITS + "select start, level, root_id, round(p, 6) p from ha where round(p, 6) > 0",
        "visits_wide": _VISITS + "select root_id, " + ", ".join(f"round(coalesce(sum(p) filter (level = {i}), 0), 6) v{i}" for i in range(HOPS + 1)) + " from va group by root_id",
        "visit_level_totals": _VISITS + ", lt as (select 'a' grp, level, sum(p) total from va where root_id in (select root_id from shared) group by level union all select 'b', level, sum(p) from vb where root_id in (select root_id from shared) group by level) select grp, level, round(total, 6) total, round(total / max(total) over (partition by grp), 6) scaled from lt",
        "visit_overlap": _overlap("ha", "hb"),
        "convergence_score": _score("ha", "hb"),
        "type_share": _VISITS + ", ty as (select p_type cell_type, sum(p) n from va join part on root_id = p_partkey where p_type is not null group by p_type) select cell_type, round(n / (select sum(n) from ty), 6) as share from ty order by 2 desc, 1 limit 11",
        "type_composition": _MEET + "select level_a, level_b, coalesce(p_type, p_brand) cell_type, cast(sum(degree) as bigint) degree from shared join part on root_id = p_partkey group by all",
        "connectivity_matrix": _PANEL + f"select {keys}, pre, post, synapses from m where transmitter = 'all' and source_group = 'NATION_12' and target_group = 'NATION_13'",
        "connectivity_panel": _PANEL + f"select {keys}, pre, post, synapses from m where transmitter = 'all'",
        "connectivity_by_transmitter": _PANEL + "select * from m",
        "connectivity_marginals": _PANEL + "select * from mg",
        "connectivity_dense": _PANEL + "select pre, post, cast(coalesce(synapses, 0) as bigint) synapses from (select pre, post from (select pre from s where source_group = 'NATION_12'), (select post from t where target_group = 'NATION_13')) left join (select pre, post, synapses from m where transmitter = 'all' and source_group = 'NATION_12' and target_group = 'NATION_13') using (pre, post)",
        "transmitter_totals": _PANEL + f"select {keys}, transmitter, cast(coalesce(sum(synapses), 0) as bigint) synapses from (select * from (select distinct {keys} from m), (select transmitter from kinds where transmitter != 'all')) left join m using ({keys}, transmitter) group by all",
        "matrix_order": _PANEL + f"select {keys}, side, cell, synapses, cast(row_number() over (partition by {keys}, side order by synapses desc, cell) as int) as position from mg where transmitter = 'all'",
        "scaled_totals": _PANEL + f"select {keys}, side, cell, synapses, round(case when side = 'target' then synapses / nullif(max(synapses) over w, 0) else (synapses - min(synapses) over w) / nullif(max(synapses) over w - min(synapses) over w, 0) end, 6) scaled from mg where transmitter = 'all' window w as (partition by {keys}, side)",
        "example_cells": _PANEL + "select * from ex",
        "strongest_partner": _partner("post", "pre", "target"),
        "strongest_source_partner": _partner("pre", "post", "source"),
        "marginal_stats": _stats("synapses"),
        "partner_stats": _stats("partners"),
        "partner_histogram": _PANEL + f"select {keys}, transmitter, side, cast(partners // 3 as bigint) bin, count(*) cells from mg group by all",
        "analysis_connectivity": _stats("synapses", more="'synapses' as value, ") + " having sum(synapses) > 0 union all select 'partners', * from (" + _stats("partners") + " having sum(synapses) > 0)",
        "paths_all_types": _TYPES + _summary("p"),
        "paths_all_types_upstream": _TYPES + _summary("pu"),
        "paths_all_types_recurrent": _TYPES + _summary("pr"),
        "all_types_intersections": _TYPES + _EACH + "select group_a, group_b, count(*) pairs from both_ group by all",
        "all_types_degree_grids": _TYPES + _EACH + "select group_a, group_b, cast(hop_a - back as int) level_a, cast(hop_b - back as int) level_b, count(*) degree from both_, (select unnest([0, 1]) back) group by all",
        "all_types_cell_grids": _TYPES + _EACH + "select group_a, group_b, cast(level_a as int) level_a, cast(level_b as int) level_b, count(*) cells, count(*) filter (leaves and not enters) initial_cells from (select group_a, group_b, cell, level_a, level_b, bool_or(leaves) leaves, bool_or(not leaves) enters from (select group_a, group_b, pre as cell, hop_a - 1 level_a, hop_b - 1 level_b, true leaves from both_ union all select group_a, group_b, post, hop_a, hop_b, false from both_) group by all) group by group_a, group_b, level_a, level_b",
        "all_types_visit_grids": _TYPES + _EACH + _COMMON + ", o as (select group_a, group_b, a.level level_a, b.level level_b, sum(a.p * b.p) x from cc join v a on a.grp = group_a and a.root_id = cell join v b on b.grp = group_b and b.root_id = cell group by all) select group_a, group_b, level_a, level_b, round(x / sum(x) over (partition by group_a, group_b), 6) as share from o",
        "all_types_scores": _TYPES + _EACH + _COMMON + "select * from (select group_a, group_b, cell root_id, round(a.p * b.p, 6) score from cc join (select grp, root_id, sum(p) p from v group by all) a on a.grp = group_a and a.root_id = cell join (select grp, root_id, sum(p) p from v group by all) b on b.grp = group_b and b.root_id = cell) where score > 0",
        "common_rows_of_types": _TYPES + "select * from p where grp = 'LARGE Brand#4' and (pre, post) in (select (pre, post) from p where grp = 'PROMO Brand#8')",
        "strong_components": _PARTS + _REACH + "select root_id, least(root_id, coalesce(min(r.a), root_id)) component from cells left join (select x.a, x.b from reach x join reach y on x.a = y.b and x.b = y.a) r on r.b = root_id group by root_id",
        "beginnings_of_graph": _PARTS + _REACH + _BEGIN,
        "initial_cells_recurrent": _PARTS + ", c as (select distinct pre, post from pr where grp = 'a' and (pre, post) in (select (pre, post) from pr where grp = 'b'))" + _REACH.replace(" from e", " from c").replace(" join e ", " join c ") + _BEGIN,
        "paths_by_threshold": _by_threshold("weight", "pre", "post"),
        "paths_by_threshold_upstream": _by_threshold("weight", "post", "pre"),
        "paths_by_pair_threshold": _by_threshold("sum(weight) over (partition by pre, post)", "pre", "post"),
        "threshold_after_paths": _PARTS + "select * from p",
        "bootstrap_ci": _boot("synapses"),
        "bootstrap_ci_partners": _boot("partners"),
        "connections_from_csv": f"with e as ({_EDGES.format(k='l_partkey')}) select pre, post, neuropil, weight, transmitter from e",
        "annotations_from_tsv": "select p_partkey root_id, p_type cell_type, p_brand hemibrain_type from part",
        "kept_paths": _PARTS + "select * from p",
        "panel_all_types": _stats("synapses", _PANEL_ALL) + " having sum(synapses) > 0",
        "panel_all_histogram": _PANEL_ALL + f"select {keys}, transmitter, side, cast(partners // 2 as bigint) bin, count(*) cells from mg where ({keys}, transmitter, side) in ({_ONLY.replace('select ', 'select (', 1).replace(' from', ') from', 1)}) group by all",
        "panel_all_marginals": _PANEL_ALL + "select * from mg where synapses > 0",
        "panel_all_examples": _PANEL_ALL + "select * from ex",
        "panel_all_scaled": _PANEL_ALL + f"select * from (select {keys}, side, cell, synapses, round(case when side = 'target' then synapses / nullif(max(synapses) over w, 0) else (synapses - min(synapses) over w) / nullif(max(synapses) over w - min(synapses) over w, 0) end, 6) scaled from mg where transmitter = 'all' window w as (partition by {keys}, side)) where synapses > 0",
        "analysis_pathways": _PARTS + "," + _nodes("p", "n") + "select grp, root_id, level, degree, p_type cell_type, p_brand hemibrain_type from n left join part on root_id = p_partkey",
        "analysis_convergence": _score("hf", "hg"),
        "convergence_score_first": _score("hf", "hg"),
        "visit_overlap_first": _overlap("hf", "hg"),
        "first_hit_levels": _VISITS + "select level, round(sum(p), 6) p from hf where level > 0 group by level",
        "type_share_hits": _VISITS + ", ty as (select p_type cell_type, sum(p) n from ha join part on root_id = p_partkey where p_type is not null group by p_type) select cell_type, round(n / (select sum(n) from ty), 6) as share from ty order by 2 desc, 1 limit 11",
        "collapse_last": f"with e as ({_EDGES.format(k='l_suppkey')}) select pre, post, weight from e where weight >= 30 qualify row_number() over (partition by pre, post order by neuropil desc, transmitter desc, weight desc) = 1",
        "marginal_histogram": _PANEL + f"select {keys}, transmitter, side, cast(synapses // 25 as bigint) bin, count(*) cells from mg group by all",
    }
