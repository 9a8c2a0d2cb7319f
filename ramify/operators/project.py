"""Projection of rows onto a rooted graph: pseudotime, segments, milestones, paths."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ramify.operators.relational import between_open, uniform
from ramify.plans.graph import PrincipalGraph, Segment


def neighbour_table(df: DataFrame, graph: PrincipalGraph, rule: str = "nearest") -> DataFrame:
    """v0, v1, t0, t1, seg: each node with its neighbour (the nearest, or the first listed)."""
    rows, w = [], graph.weights()
    for v in range(len(w)):
        around = np.flatnonzero(w[v])
        if len(around):
            u = int(around[np.argmin(w[v, around])]) if rule == "nearest" else int(around[0])
            rows.append((v, u, float(graph.time[v]), float(graph.time[u]), graph.seg[u] if v in graph.forks else graph.seg[v]))
    return df.sparkSession.createDataFrame(rows, "v0 int, v1 int, t0 double, t1 double, seg string")


def map_cells(assigned: DataFrame, graph: PrincipalGraph, rule: str = "nearest", draw: int | None = None) -> DataFrame:
    """``assigned`` (column r) plus t, seg, edge. Map-only: the node table has K rows and is broadcast.

    The node is the one with the largest weight (the first on ties), or drawn by weight where
    ``draw`` gives a seed.
    """
    if draw is None:
        v0 = F.array_position("r", F.array_max("r")) - 1
    else:
        # Inverse CDF: the first node at which the running sum passes a uniform draw.
        u = uniform(draw, F.col("cell"))
        step = lambda acc, w: F.struct((acc["s"] + w).alias("s"), (acc["n"] + F.when(acc["s"] + w <= u, 1).otherwise(0)).alias("n"))
        v0 = F.least(F.aggregate("r", F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), step)["n"], F.size("r") - 1)
    rows = assigned.withColumn("v0", v0.cast("int")).join(F.broadcast(neighbour_table(assigned, graph, rule)), "v0")
    r0, r1 = F.get("r", F.col("v0")), F.get("r", F.col("v1"))
    return rows.withColumn("t", (F.col("t0") * r0 + F.col("t1") * r1) / (r0 + r1)).withColumn("edge", F.concat_ws("|", "v0", "v1")).drop("v0", "v1", "t0", "t1")


def pseudotime(assigned: DataFrame, graph: PrincipalGraph, n_map: int = 1, seed: int = 1, rule: str = "nearest") -> tuple[DataFrame, DataFrame]:
    """(cells with t, seg, edge, milestones; all mappings)."""
    if n_map == 1:
        one = map_cells(assigned, graph, rule)
        return with_milestones(one, graph), one.select(F.lit(0).alias("map_id"), "cell", "t", "seg", "edge")
    maps = [map_cells(assigned, graph, rule, draw=seed + m).select(F.lit(m).alias("map_id"), "cell", "t", "seg", "edge") for m in range(n_map)]
    every = maps[0]
    for m in maps[1:]:
        every = every.union(m)
    first = map_cells(assigned, graph, rule).select("cell", "edge")
    return with_milestones(consolidate(every, graph.segments, graph.root, set(graph.tips), dict(enumerate(graph.time.tolist()))).join(first, "cell"), graph), every


def consolidate(maps: DataFrame, segments: tuple[Segment, ...], root: int, tips: set[int], time: dict[int, float]) -> DataFrame:
    """cell, t (mean), t_sd, seg (most votes, the least on ties), moved where t lies outside of the
    segment to the most voted other segment whose open interval holds it; none: stays."""
    spark = maps.sparkSession
    stats = maps.groupBy("cell").agg(F.avg("t").alias("t"), F.stddev_pop("t").alias("t_sd"))
    votes = maps.groupBy("cell", "seg").agg(F.count("*").alias("n"))
    top = votes.groupBy("cell").agg(F.max_by("seg", F.struct("n", -F.col("seg").cast("int"))).alias("seg"))
    out = stats.join(top, "cell")
    ranges = spark.createDataFrame([(s.n, time[s.start], time[s.end], s.start != root, s.end not in tips or s.end == root) for s in segments], "seg string, lo double, hi double, checks_lo boolean, checks_hi boolean")
    inside = between_open(out.select("cell", "t"), "t", ranges.select(F.col("seg").alias("other"), "lo", "hi"), "lo", "hi")
    ahead = inside.join(votes.select("cell", F.col("seg").alias("other"), "n"), ["cell", "other"])
    own = out.join(F.broadcast(ranges), "seg").select("cell", F.col("seg").alias("own"), ((F.col("checks_lo") & (F.col("t") < F.col("lo"))) | (F.col("checks_hi") & (F.col("t") > F.col("hi")))).alias("outside"))
    moves = own.where("outside").join(ahead, "cell").where("other != own").groupBy("cell").agg(F.max_by("other", F.struct("n", -F.col("other").cast("int"))).alias("moved"))
    return out.join(moves, "cell", "left").withColumn("seg", F.coalesce("moved", "seg")).drop("moved")


def milestone_of(t, low, high, start, end):
    """``start`` in the first half of a segment, ``end`` in the second, null right in the middle."""
    half = (high - low) / 2
    return F.when(t - low < half, start).when(t - low > half, end)


def with_milestones(cells: DataFrame, graph: PrincipalGraph) -> DataFrame:
    names = {v: k for k, v in graph.milestones.items()}
    ends = cells.sparkSession.createDataFrame([(s.n, names.get(s.start, str(s.start)), names.get(s.end, str(s.end))) for s in graph.segments], "seg string, _from string, _to string")
    low = cells.groupBy("seg").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    rows = cells.join(F.broadcast(low.join(F.broadcast(ends), "seg")), "seg", "left")  # a row for each segment
    return rows.withColumn("milestones", milestone_of(F.col("t"), F.col("_lo"), F.col("_hi"), F.col("_from"), F.col("_to"))).drop("_lo", "_hi", "_from", "_to")


def rename_milestones(cells: DataFrame, graph: PrincipalGraph, names: dict[str, str]) -> tuple[DataFrame, PrincipalGraph]:
    table = cells.sparkSession.createDataFrame(list(names.items()), "milestones string, _new string")
    return cells.join(F.broadcast(table), "milestones", "left").withColumn("milestones", F.coalesce("_new", "milestones")).drop("_new"), graph.renamed(names)


def unroll_circle(cells: DataFrame, graph: PrincipalGraph) -> tuple[DataFrame, PrincipalGraph]:
    """The second arc turned round and put behind the first; one segment ``0`` remains."""
    top = cells.where("seg = '0'").agg(F.max("t").alias("_m"))
    turned = cells.crossJoin(F.broadcast(top)).withColumn("_u", F.when(F.col("seg") == "0", F.col("_m") - F.col("t")))
    span = turned.agg(F.max("_u").alias("_s"), F.max(F.when(F.col("seg") != "0", F.col("t"))).alias("_end"))
    rows = turned.crossJoin(F.broadcast(span)).withColumn("t", F.coalesce(F.col("_u") + F.col("_end"), "t")).drop("_m", "_u", "_s", "_end")
    high = rows.agg(F.max("t").alias("_h"))
    a, b = (list(graph.milestones) + ["a", "b"])[:2]
    rows = rows.crossJoin(F.broadcast(high)).withColumn("milestones", F.when(F.col("t") <= F.col("_h") / 2, a).otherwise(b)).withColumn("seg", F.lit("0")).drop("_h")
    g = replace(graph, root2=None, segments=(Segment("0", graph.root, graph.segments[0].start, sum(s.d for s in graph.segments)),), seg=("0",) * len(graph.seg))
    return rows, g


def node_means(assigned: DataFrame, value: str) -> DataFrame:
    """node, value: R-weighted mean of a column over the rows whose value isn't null."""
    rows = assigned.where(F.col(value).isNotNull()).select(F.posexplode("r").alias("node", "w"), F.col(value).alias("v"))
    return rows.groupBy("node").agg((F.sum(F.col("w") * F.col("v")) / F.when(F.sum("w") != 0, F.sum("w"))).alias("value"))


def reassign_time(assigned: DataFrame, graph: PrincipalGraph, time: str) -> tuple[DataFrame, PrincipalGraph]:
    """t becomes the column ``time``; node times become its R-weighted means, segment lengths their differences."""
    means = {r["node"]: r["value"] for r in node_means(assigned, time).collect()}  # a row per node
    at = np.array([means.get(v, np.nan) for v in range(len(graph.degree))], float)
    at = np.where(np.isnan(at), graph.time, at)
    segments = tuple(replace(s, d=float(abs(at[s.end] - at[s.start]))) for s in graph.segments)
    return assigned.withColumn("t", F.col(time).cast("double")), replace(graph, time=at, segments=segments)


def root_by_value(assigned: DataFrame, graph: PrincipalGraph, value: str, tips_only: bool = False, least: bool = False) -> int:
    """The node with the largest (or least) mean value; the first on ties."""
    rows = node_means(assigned, value).where(F.col("value").isNotNull())
    if tips_only:
        rows = rows.where(F.col("node").isin(graph.tips))
    order = [F.col("value").asc() if least else F.col("value").desc(), F.col("node")]
    return rows.orderBy(*order).first()["node"]


def path_cells(cells: DataFrame, graph: PrincipalGraph, start: str, ends: list[str], include_root: bool = False) -> DataFrame:
    """Cells on the segments from one milestone to each of others, with ``branch`` ("start_end");
    a cell on several paths appears once for each. An opposite direction gives no cells."""
    spark = cells.sparkSession
    a = graph.milestones[start]
    rows = [(f"{start}_{e}", s.n) for e in ends for s in graph.segment_path(a, graph.milestones[e])]
    table = spark.createDataFrame(rows, "branch string, seg string")
    out = cells.join(F.broadcast(table), "seg")
    if include_root:
        touch = F.array_contains(F.split("edge", r"\|"), str(a))
        more = cells.where(touch).crossJoin(F.broadcast(spark.createDataFrame([(f"{start}_{e}",) for e in ends], "branch string")))
        out = out.unionByName(more.select(*out.columns)).dropDuplicates(["cell", "branch"])
    return out


def subset(cells: DataFrame, graph: PrincipalGraph, start: str, ends: list[str], mode: str = "extract", t_min: float | None = None, t_max: float | None = None) -> DataFrame:
    """Cells on the paths (extract), off them (substract), or in an open range of time (pseudotime)."""
    if mode == "pseudotime":
        return cells.where((F.col("t") > (t_min if t_min is not None else -np.inf)) & (F.col("t") < (t_max if t_max is not None else np.inf)))
    on = path_cells(cells, graph, start, ends).select("cell").distinct()
    return cells.join(on, "cell", "left_semi" if mode == "extract" else "left_anti")


def subset_graph(graph: PrincipalGraph, start: str, ends: list[str], mode: str = "extract") -> PrincipalGraph:
    """The nodes on the paths, or those that aren't; old names stay, and a root is found again."""
    on = sorted({v for e in ends for v in graph.path(graph.milestones[start], graph.milestones[e])})
    keep = [v for v in range(len(graph.degree)) if (v in on) == (mode == "extract")]
    if mode == "extract" and graph.milestones[start] != graph.root and len(keep) > 2:
        keep.remove(graph.milestones[start])
    g, groups = graph.kept(np.array(keep))
    old = [x[0] for x in groups]
    root = old.index(graph.root) if graph.root in old else int(np.argmin(graph.time[old]))
    return g.rooted(root)


def dendrogram(cells: DataFrame, graph: PrincipalGraph, crowd: float = 1.0, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(cells with x and y, segments of the drawing); the jitter comes from a hash of the cell."""
    place = graph.layout()
    spark = cells.sparkSession
    table = spark.createDataFrame([(n, x) for n, x in place.items()], "seg string, _x double")
    jitter = (uniform(seed, F.col("cell")) - 0.5) * 0.8 * 0.5 * crowd
    rows = cells.join(F.broadcast(table), "seg").withColumn("x", F.col("_x") + jitter).withColumn("y", -F.col("t")).drop("_x")
    lines = []
    for s in graph.segments:
        x, y0, y1 = place[s.n], -float(graph.time[s.start]), -float(graph.time[s.end])
        lines.append((s.n, x, x, y0, y1))
        lines += [(s.n, x, place[c.n], y1, y1) for c in graph.segments if c.start == s.end]
    return rows, spark.createDataFrame(lines, "seg string, x0 double, x1 double, y0 double, y1 double")


def slide_windows(time: np.ndarray, mass: np.ndarray, shared: list[int], branches: list[list[int]], size: float) -> list[tuple[str, list[int]]]:
    """Windows of nodes with a mass of about ``size`` along a fork: before it, across it into each
    branch, and on each branch. Neighbouring windows share their border node."""
    out: list[tuple[str, list[int]]] = []
    stack = [("pre", shared + [v for b in branches for v in b], -np.inf)]
    while stack:
        where, nodes, begin = stack.pop(0)
        row = sorted((v for v in nodes if time[v] >= begin), key=lambda v: (time[v], v))
        total = np.cumsum([mass[v] for v in row])
        over = np.flatnonzero(total > size)
        if not len(over):
            if len(row) and total[-1] > size / 2:
                out.append((where, row))
            continue
        window = row[: over[0]]
        if not window:
            raise ValueError("size is below the mass of one node")
        out.append((where, window))
        if len(window) == 1:
            continue
        end = max(time[v] for v in window)
        if where == "pre" and any(v in b for b in branches for v in window):
            for i, b in enumerate(branches):
                inside = [time[v] for v in window if v in b]
                stack.append((f"branch{i + 1}", b, max(inside) if inside else end))
        else:
            stack.append((where, nodes, end))
    return out


def window_weights(assigned: DataFrame, windows: list[tuple[str, list[int]]], hard: bool = False) -> DataFrame:
    """cell, window, w: the weight of each cell in each window (sum of R, or 0/1 by the largest)."""
    best = F.array_position("r", F.array_max("r")) - 1
    one = lambda nodes: best.isin(nodes).cast("double") if hard else sum((F.get("r", F.lit(v)) for v in nodes), F.lit(0.0))
    weights = F.array(*[one(nodes) for _, nodes in windows])
    return assigned.select("cell", F.posexplode(weights).alias("window", "w")).where("w > 0")


def running_mass(nodes: DataFrame, size: float) -> DataFrame:
    """node, time, mass plus ``window``: nodes in order of time, cut whenever the running mass passes ``size``."""
    w = Window.partitionBy(F.lit(1)).orderBy("time", "node").rowsBetween(Window.unboundedPreceding, 0)  # K rows
    return nodes.withColumn("cumulative", F.sum("mass").over(w)).withColumn("window", F.floor(F.col("cumulative") / size).cast("int"))
