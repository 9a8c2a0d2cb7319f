"""Domain views over the generated tables: vectors, counts, time-line, hierarchy, mappings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.plans.graph import PrincipalGraph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, x (array of double), cluster."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("cluster"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, gene, batch, value: sparse counts of customers by brand, batch the market segment.

    The tables joined grow with the input, so none is broadcast, however small its file: the rows would pass through the driver.
    """
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = line.join(part.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).join(cust.hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_custkey").alias("cell"), F.col("p_brand").alias("gene"), F.col("c_mktsegment").alias("batch")).agg(F.sum("l_quantity").alias("value"))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, t (seconds from the first event), seg, value, cov (A or B), user_id."""
    events = read(spark, sf_dir, "events")
    first = events.agg(F.min(F.unix_micros(F.to_timestamp("ts"))).alias("t0"))
    t = (F.unix_micros(F.to_timestamp("ts")) - F.col("t0")) / 1e6
    return events.crossJoin(F.broadcast(first)).select(F.col("event_id").alias("cell"), t.alias("t"), F.col("event_type").alias("seg"), "value", F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("cov"), "user_id")


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map_id, cell, t, seg: five mappings of each user."""
    return timeline(spark, sf_dir).select((F.col("cell") % 5).cast("int").alias("map_id"), F.col("user_id").alias("cell"), "t", "seg", "value")


def hierarchy(spark: SparkSession, sf_dir: str) -> tuple[list[int], list[tuple[int, int, float]]]:
    """Nodes and edges of world (-1), regions (0..) and nations (100..); 31 nodes whatever the scale."""
    regions = [r[0] for r in read(spark, sf_dir, "region").select("r_regionkey").orderBy("r_regionkey").collect()]
    nations = [(r[0], r[1]) for r in read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()]
    return [-1, *regions, *(100 + n for n, _ in nations)], [(-1, r, 1.0) for r in regions] + [(r, 100 + n, 2.0) for n, r in nations]


def hierarchy_graph(spark: SparkSession, sf_dir: str) -> tuple[PrincipalGraph, list[int]]:
    """The hierarchy as a graph on a line of coordinates that give its edge lengths; and node names."""
    names, edges = hierarchy(spark, sf_dir)
    at = {v: i for i, v in enumerate(names)}
    k = len(names)
    adjacency, nodes = np.zeros((k, k), int), np.zeros((k, k))
    for a, b, w in edges:
        adjacency[at[a], at[b]] = adjacency[at[b], at[a]] = 1
        nodes[:, at[b]] = nodes[:, at[a]]
        nodes[at[b], at[b]] = w
    return PrincipalGraph(adjacency, nodes), names
