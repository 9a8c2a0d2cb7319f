"""A tree over fate probabilities and a given time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ramify.operators import fit, project
from ramify.plans.graph import PrincipalGraph


def fates_tree(fates: DataFrame, time: str, probabilities: list[str], n_nodes: int, method: str = "ppt", lam: float = 100.0, auto_root: bool = False, root_params: dict | None = None, reassign: bool = False, **options) -> tuple[DataFrame, PrincipalGraph]:
    """(cells with r and, once rooted, t, seg, edge, milestones; the graph).

    The tree is learned on the probabilities' projection and ``time`` (see ``fate_vectors``). With
    ``auto_root`` the node with the largest mean time, or as ``root_params`` (tips_only, least) say,
    becomes the root and cells get pseudotimes; with ``reassign``, which roots too, ``time`` then
    takes the place of t, and nodes and segments follow.
    """
    if method not in ("ppt", "epg"):
        raise ValueError("method must be ppt or epg")
    rows = fit.fate_vectors(fates, time, probabilities)
    graph = fit.tree(rows, n_nodes, lam=lam, **options) if method == "ppt" else fit.elastic_graph(rows, n_nodes, **options)
    cells = fit.soft_assign(rows, graph.nodes, graph.sigma) if method == "ppt" else fit.edge_assign(rows, graph)
    if not (auto_root or reassign):
        return cells, graph
    graph = graph.rooted(project.root_by_value(cells, graph, time, **(root_params or {})))
    placed = project.pseudotime(cells, graph)[0]
    cells = cells.join(placed.select("cell", "t", "seg", "edge", "milestones"), "cell")
    return project.reassign_time(cells, graph, time) if reassign else (cells, graph)
