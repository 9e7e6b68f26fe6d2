"""The three analyses from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.storage import durable
from ..operators import bitmaps as B
from ..operators import connectivity as C
from ..operators import convergence as V
from ..operators import marginals as M
from ..operators import nodes as N
from ..operators import paths as P
from ..operators import walks as W
from ..sources.results import kept


def pathways(edges: DataFrame, groups: DataFrame, annotations: DataFrame | None = None, *, keep: str | None = None, **options) -> dict[str, DataFrame]:
    """Path rows, cells and hop summary of every group; with a folder to `keep` them in, rows of groups computed before are read."""
    if keep is None:
        rows = durable(P.paths(edges, groups, **options))
    else:
        rows = kept(keep, "paths", edges, groups, options, lambda g: P.paths(edges, g, **options))
    return {"paths": rows, "nodes": N.node_table(rows, annotations), "hops": P.hop_summary(rows)}


def downstream_convergence(edges: DataFrame, groups: DataFrame, group_a: str, group_b: str, annotations: DataFrame | None = None, *, use_inits: bool = True, **options) -> dict[str, DataFrame]:
    """Where the downstream pathways of two groups meet: common rows, cells, level grids, visits and scores.

    With use_inits only a walk's first hit in the other group's cells counts. The groups may be the same.
    """
    rows = durable(P.paths(edges, groups, downstream=True, **options))
    nodes = durable(N.node_table(rows))
    top = N.max_level(nodes)
    own = lambda df, g: df.where(df["grp"] == g)
    common = durable(V.edge_intersection(rows, group_a, group_b))
    cells = durable(V.intersection_nodes(common, own(nodes, group_b)))
    visits = {}
    for g, other in ((group_a, group_b), (group_b, group_a)):
        near = own(nodes, other).select("root_id")
        v = W.expected_visits(W.transitions(own(rows, g)), own(nodes, g).where("level = 0"), top, absorb=near if use_inits else None, per_start=False)
        visits[g] = durable(W.hits_in(v, near))
    out = {"paths": rows, "nodes": nodes, "common": common, "cells": cells, "profile": N.level_profile(nodes, top), "overlap": V.level_overlap(cells, top)}
    out["visit_overlap"] = V.visit_overlap(visits[group_a], visits[group_b], cells, top)
    out["score"] = V.convergence_score(visits[group_a], visits[group_b], cells)
    if annotations is not None:
        out["types"] = V.type_composition(cells, annotations)
    return out


def all_convergences(edges: DataFrame, groups: DataFrame, max_hops: int = 5) -> dict[str, DataFrame]:
    """What any two groups' downstream pathways have in common, for all groups in one run, without recurrents.

    Common pairs of cells, grids of cells, initial cells and degree by the two levels, grids of visits and scores, from
    all hits, as `downstream_convergence` gives them for two groups with use_inits=False.
    """
    names = B.numbered(groups)
    sets = durable(B.path_sets(edges, durable(B.members(groups, names)), max_hops))
    shared, squares = durable(B.shared_pairs(sets, names)), durable(B.cell_squares(sets))
    visits = durable(W.group_visits(B.path_rows(sets, names), groups, max_hops))
    out = {"paths": sets, "names": names, "pairs": B.intersections(shared), "degree": B.degree_grids(shared), "cells": B.cell_grids(sets, names, squares)}
    return out | {"visits": B.visit_grids(visits, squares, names), "scores": B.scores(visits, squares, names)}


def connectivity_panel(edges: DataFrame, sources: DataFrame, targets: DataFrame, *, synapse_bin: int = 25, partner_bin: int = 3) -> dict[str, DataFrame]:
    """Every pair of groups in one call: matrices, marginals, totals, order, scales, intervals and histograms of synapses and
    partners on both sides, example cells and strongest partners from both sides.

    Cells without a connection are counted, not written; pairs of groups without any connection have no rows.
    """
    m = durable(C.matrix(edges, sources, targets))
    rows = durable(M.connected(m))
    out = {"matrix": m, "marginals": rows, "transmitters": C.transmitter_totals(m, edges), "order": M.order(rows)}
    for value, width in (("synapses", synapse_bin), ("partners", partner_bin)):
        s = durable(M.summary(rows, sources, targets, value))
        out |= {f"{value}_stats": M.stats(s), f"{value}_histogram": M.histogram(rows, s, width, value)}
        if value == "synapses":
            out |= {"scaled": M.scaled(rows, s), "examples": (examples := durable(M.examples(rows, s, sources, targets)))}
    return out | {"strongest_target": C.strongest_partner(m, examples), "strongest_source": C.strongest_partner(m, examples, "source")}
