"""Projection of arriving rows onto a frozen graph: stateless, so each micro-batch is one narrow stage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ramify.operators.fit import soft_assign
from ramify.operators.project import map_cells
from ramify.plans.graph import PrincipalGraph


def project_stream(rows: DataFrame, graph: PrincipalGraph) -> DataFrame:
    """Batch or streaming rows (cell, x) plus t, seg, edge."""
    return map_cells(soft_assign(rows, graph.nodes, graph.sigma), graph).drop("r")
