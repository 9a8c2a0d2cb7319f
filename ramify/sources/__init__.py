"""Reading and writing of the engine's tables."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.plans.graph import PrincipalGraph, Segment


def long_expression(df: DataFrame, cell: str, features: list[str]) -> DataFrame:
    """(cell, gene, value) of a wide table, zeros left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("gene"), F.col(f).cast("double").alias("value")) for f in features]))
    return df.select(F.col(cell).alias("cell"), pairs.alias("p")).select("cell", "p.gene", "p.value").where("value != 0")


def write_layer(expr: DataFrame, path: str, layer: str) -> None:
    """Adds a layer of (cell, gene, value); readers prune by layer."""
    expr.withColumn("layer", F.lit(layer)).write.mode("append").partitionBy("layer").parquet(path)


def read_layer(spark: SparkSession, path: str, layer: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("layer") == layer).drop("layer")


def save_graph(spark: SparkSession, graph: PrincipalGraph, path: str) -> None:
    """One row: a graph has a few thousand nodes at most."""
    plain = {
        "adjacency": [list(map(int, e)) for e in graph.edges], "nodes": graph.nodes.tolist(), "method": graph.method, "sigma": graph.sigma, "lam": graph.lam,
        "root": graph.root, "root2": graph.root2, "meeting": graph.meeting, "time": None if graph.time is None else graph.time.tolist(),
        "seg": list(graph.seg), "segments": [[s.n, s.start, s.end, s.d] for s in graph.segments], "milestones": graph.milestones,
    }
    spark.createDataFrame([(json.dumps(plain),)], "graph string").coalesce(1).write.mode("overwrite").parquet(path)


def load_graph(spark: SparkSession, path: str) -> PrincipalGraph:
    p = json.loads(spark.read.parquet(path).first()[0])
    nodes = np.array(p["nodes"])
    adjacency = np.zeros((nodes.shape[1],) * 2, int)
    for a, b in p["adjacency"]:
        adjacency[a, b] = adjacency[b, a] = 1
    return PrincipalGraph(adjacency, nodes, p["method"], p["sigma"], p["lam"], p["root"], p["root2"], p["meeting"], None if p["time"] is None else np.array(p["time"]), tuple(p["seg"]), tuple(Segment(*s) for s in p["segments"]), p["milestones"])
