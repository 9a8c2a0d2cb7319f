"""Principal graphs: soft principal trees and elastic trees, curves and circles, learned over all rows.

Rows stay on the executors. A step sends the nodes out and gets back, from each partition, sums
whose size depends on the graph only; the driver solves for new nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.plans.graph import PrincipalGraph, minimum_spanning_tree, pairwise


def resolve_rep(tables: dict[str, DataFrame], use_rep: str | None, ndims: int | None, n_features: int) -> tuple[str, DataFrame]:
    """The table of vectors by name, X_ in front of it, or else X for few features and X_pca for many."""
    if use_rep and use_rep not in tables and f"X_{use_rep}" in tables:
        use_rep = f"X_{use_rep}"
    if not use_rep or use_rep not in tables:
        use_rep = "X" if n_features < 50 or ndims is None else "X_pca"
    df = tables[use_rep]
    return use_rep, df if ndims is None or use_rep == "X" else df.withColumn("x", F.slice("x", 1, ndims))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def soft(x: np.ndarray, nodes: np.ndarray, sigma: float, metric: str = "euclidean") -> np.ndarray:
    """Row-normalised exp(-distance / sigma); rows out of reach of all nodes become zero."""
    r = np.exp(-pairwise(x.T, nodes, metric) / sigma)
    total = r.sum(axis=1, keepdims=True)
    return np.divide(r, total, out=np.zeros_like(r), where=total > 0)


def soft_assign(reps: DataFrame, nodes: np.ndarray, sigma: float, metric: str = "euclidean") -> DataFrame:
    """``reps`` plus r, the soft assignment of each row to the nodes; map-only, nodes broadcast."""
    sent = reps.sparkSession.sparkContext.broadcast(nodes)

    @F.pandas_udf("array<double>")
    def assign(x: pd.Series) -> pd.Series:
        return pd.Series(list(soft(_matrix(x), sent.value, sigma, metric))) if len(x) else pd.Series([], dtype=object)

    return reps.withColumn("r", assign("x"))


def _sums(reps: DataFrame, nodes: np.ndarray, sigma: float, weight: str | None, metric: str = "euclidean") -> tuple[np.ndarray, np.ndarray]:
    """Column sums of R, and X'R; one row of K * (d + 1) numbers from each partition, added up by position."""
    sent = reps.sparkSession.sparkContext.broadcast(nodes)
    d, k = nodes.shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d + 1, k))
        for f in frames:
            if len(f):
                x = _matrix(f["x"])
                r = soft(x, sent.value, sigma, metric)
                if weight:
                    r = r * f[weight].to_numpy()[:, None]
                total += np.vstack([r.sum(axis=0), x.T @ r])
        yield pd.DataFrame({"i": np.arange(total.size), "s": total.ravel()})

    rows = reps.select("x", *([weight] if weight else [])).mapInPandas(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros((d + 1) * k)
    for row in rows:
        out[row["i"]] = row["s"]
    out = out.reshape(d + 1, k)
    return out[0], out[1:]


def starting_nodes(reps: DataFrame, k: int, seed: int) -> np.ndarray:
    """``k`` rows in order of a hash of the seed and the row's cell."""
    rows = reps.orderBy(F.xxhash64(F.lit(seed), "cell"), "cell").limit(k).select("x").collect()
    return np.array([r["x"] for r in rows], float).T


def default_nodes(n: int, most: int) -> int:
    return most if 2 * n > most else max(2, n // 2)


def tree(reps: DataFrame, n_nodes: int | None = None, sigma: float = 0.1, lam: float = 1.0, steps: int = 50, err_cut: float = 5e-3, init: np.ndarray | None = None, seed: int = 1, weight: str | None = None, metric: str = "euclidean") -> PrincipalGraph:
    """A soft principal tree (Mao et al. 2015): alternate soft assignment, spanning tree, and a linear solve for the nodes.

    ``metric`` measures rows against nodes and nodes against each other.
    """
    reps = reps.cache()
    try:
        k = n_nodes or default_nodes(reps.count(), 2000)
        nodes = init if init is not None else starting_nodes(reps, k, seed)
        adjacency = minimum_spanning_tree(pairwise(nodes))
        for _ in range(steps):
            mass, moved = _sums(reps, nodes, sigma, weight, metric)
            adjacency = minimum_spanning_tree(pairwise(nodes, metric=metric))
            laplace = np.diag(adjacency.sum(axis=0)) - adjacency
            new = np.linalg.solve((lam * laplace + np.diag(mass + 1e-12)).T, moved.T).T
            gap = np.abs(new - nodes).max() / max(1e-12, np.abs(nodes).max())
            nodes = new
            if gap < err_cut:
                break
        return PrincipalGraph(minimum_spanning_tree(pairwise(nodes, metric=metric)), nodes, "ppt", sigma, lam)
    finally:
        reps.unpersist()


def explore_sigma(reps: DataFrame, n_nodes: int, sigmas: list[float], steps: int = 1, seed: int = 1, second_round: bool = False, metric: str = "euclidean") -> tuple[float, list[tuple[float, float]]]:
    """Mean distance to the nearest node for each sigma, and the sigma at the knee of that curve."""
    start, found = starting_nodes(reps, n_nodes, seed), []
    for sigma in sigmas:
        g = tree(reps, n_nodes, sigma=sigma, steps=steps, init=start, metric=metric)
        found.append((sigma, mean_gap(reps, g.nodes, metric)))
    best = knee([s for s, _ in found], [v for _, v in found])
    if second_round:
        more = explore_sigma(reps, n_nodes, list(np.linspace(best, best / 5, 5)), steps, seed, metric=metric)
        return more[0], found + more[1]
    return best, found


def mean_gap(reps: DataFrame, nodes: np.ndarray, metric: str = "euclidean") -> float:
    """Mean distance to the nearest node."""
    sent = reps.sparkSession.sparkContext.broadcast(nodes)

    @F.pandas_udf("double")
    def near(x: pd.Series) -> pd.Series:
        return pd.Series(pairwise(_matrix(x).T, sent.value, metric).min(axis=1)) if len(x) else pd.Series([], dtype=float)

    return reps.select(near("x").alias("d")).agg(F.avg("d")).first()[0] or 0.0


def knee(sigmas: list[float], scores: list[float]) -> float:
    """The point farthest from the chord between the first and the last, on its near side."""
    x, y = np.arange(len(scores), dtype=float), np.array(scores, float)
    chord = np.array([x[-1] - x[0], y[-1] - y[0]])
    rel = np.column_stack([x - x[0], y - y[0]])
    away = (chord[0] * rel[:, 1] - chord[1] * rel[:, 0]) / max(1e-12, np.hypot(*chord))
    return sigmas[int(np.argmax(np.abs(away)))]


def convert_to_soft(reps: DataFrame, graph: PrincipalGraph, sigma: float, lam: float, steps: int = 1) -> PrincipalGraph:
    """Soft steps on a fixed topology."""
    nodes, b = graph.nodes, graph.adjacency
    laplace = np.diag(b.sum(axis=0)) - b
    for _ in range(steps):
        mass, moved = _sums(reps, nodes, sigma, None)
        nodes = np.linalg.solve((lam * laplace + np.diag(mass + 1e-12)).T, moved.T).T
    return replace(graph, nodes=nodes, method="ppt", sigma=sigma, lam=lam)


# --- elastic graphs ---


def _hard_sums(reps: DataFrame, options: list[np.ndarray], radius: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each candidate's nodes: rows per node, their sums, and the sum of squared distances; one job for all."""
    sent = reps.sparkSession.sparkContext.broadcast(options)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = [np.zeros((o.shape[0] + 1, o.shape[1])) for o in sent.value]
        errors = np.zeros(len(totals))
        for f in frames:
            if len(f):
                x = _matrix(f["x"])
                for c, nodes in enumerate(sent.value):
                    d = pairwise(x.T, nodes)
                    near = d.argmin(axis=1)
                    least = d[np.arange(len(x)), near]
                    errors[c] += float(np.minimum(least, radius) @ np.minimum(least, radius))
                    inside = least <= radius
                    r = np.zeros_like(d)
                    r[np.flatnonzero(inside), near[inside]] = 1
                    totals[c] += np.vstack([r.sum(axis=0), x.T @ r])
        for c, t in enumerate(totals):
            flat = np.append(t.ravel(), errors[c])
            yield pd.DataFrame({"c": c, "i": np.arange(len(flat)), "s": flat})

    rows = reps.select("x").mapInPandas(run, "c int, i int, s double").groupBy("c", "i").agg(F.sum("s").alias("s")).collect()
    flats = [np.zeros((o.shape[0] + 1) * o.shape[1] + 1) for o in options]
    for row in rows:
        flats[row["c"]][row["i"]] = row["s"]
    out = []
    for flat, o in zip(flats, options, strict=True):
        table = flat[:-1].reshape(o.shape[0] + 1, o.shape[1])
        out.append((table[0], table[1:], float(flat[-1])))
    return out


def _elastic(adjacency: np.ndarray, lam: float, mu: float) -> np.ndarray:
    """Quadratic form of stretched edges and of stars that bend (a node away from its neighbours' mean)."""
    k = len(adjacency)
    m = lam * (np.diag(adjacency.sum(axis=0)) - adjacency).astype(float)
    for v in range(k):
        around = np.flatnonzero(adjacency[v])
        if len(around) > 1:
            star = np.zeros(k)
            star[v], star[around] = 1.0, -1.0 / len(around)
            m += mu * np.outer(star, star)
    return m


def _grown(adjacency: np.ndarray, nodes: np.ndarray, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Graphs with one node more: an edge cut in two, or (trees, and the ends of curves) a node added."""
    k, out = len(adjacency), []
    for a, b in np.argwhere(np.triu(adjacency)):
        grown = np.zeros((k + 1, k + 1), int)
        grown[:k, :k] = adjacency
        grown[a, b] = grown[b, a] = 0
        grown[a, k] = grown[k, a] = grown[b, k] = grown[k, b] = 1
        out.append((grown, np.column_stack([nodes, (nodes[:, a] + nodes[:, b]) / 2])))
    degree = adjacency.sum(axis=0)
    for v in range(k) if kind != "circle" else ():
        if kind == "curve" and degree[v] > 1:
            continue
        grown = np.zeros((k + 1, k + 1), int)
        grown[:k, :k] = adjacency
        grown[v, k] = grown[k, v] = 1
        around = np.flatnonzero(adjacency[v])
        ahead = 2 * nodes[:, v] - nodes[:, around].mean(axis=1)
        out.append((grown, np.column_stack([nodes, ahead])))
    return out


def elastic_graph(reps: DataFrame, n_nodes: int, kind: str = "tree", lam: float = 0.01, mu: float = 0.1, radius: float = float("inf"), seed: int = 1, refine: int = 3, at_once: int = 32, extend: bool = False) -> PrincipalGraph:
    """An elastic graph (Albergante et al. 2020): of all graphs with one node more keep the one with the least energy.

    All candidates of a round are measured, ``at_once`` of them in a job. ``extend`` adds a node beyond each tip.
    """
    reps = reps.cache()
    try:
        n = reps.count()
        start = {"tree": 2, "curve": 2, "circle": 3}[kind]
        adjacency = np.ones((start, start), int) - np.eye(start, dtype=int)
        nodes = starting_nodes(reps, start, seed)

        def settled(b: np.ndarray, f: np.ndarray, sums: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
            mass, moved, _ = sums
            return np.linalg.solve(np.diag(mass / n + 1e-12) + _elastic(b, lam, mu), moved.T / n).T

        for _ in range(refine):
            nodes = settled(adjacency, nodes, _hard_sums(reps, [nodes], radius)[0])
        while nodes.shape[1] < n_nodes:
            options = _grown(adjacency, nodes, kind)
            found = []
            for at in range(0, len(options), at_once):
                some = options[at : at + at_once]
                sums = _hard_sums(reps, [f for _, f in some], radius)
                moved = [settled(b, f, s) for (b, f), s in zip(some, sums, strict=True)]
                scored = _hard_sums(reps, moved, radius)
                found += [(s[2] / n + float(np.trace(f @ _elastic(b, lam, mu) @ f.T)), b, f) for (b, _), f, s in zip(some, moved, scored, strict=True)]
            _, adjacency, nodes = min(found, key=lambda x: x[0])
        graph = PrincipalGraph(adjacency, nodes, "epg", lam=lam)
        return extend_leaves(reps, graph) if extend else graph
    finally:
        reps.unpersist()


def extend_leaves(reps: DataFrame, graph: PrincipalGraph, share: float = 0.5) -> PrincipalGraph:
    """A node more beyond each tip that has rows there, on the line of the tip's edge.

    Of the rows that are nearest to the tip and beyond it along that line, the new node stands at
    the quantile ``share`` of how far they reach; a row per tip reaches the driver.
    """
    tips = [(v, int(np.flatnonzero(graph.adjacency[v])[0])) for v in graph.tips]
    ways = {v: graph.nodes[:, v] - graph.nodes[:, u] for v, u in tips}
    sent = reps.sparkSession.sparkContext.broadcast((graph.nodes, ways))

    def beyond(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, way = sent.value
        for f in frames:
            if len(f):
                x = _matrix(f["x"])
                near = pairwise(x.T, nodes).argmin(axis=1)
                for v, w in way.items():
                    far = (x[near == v] - nodes[:, v]) @ w / max(1e-12, float(np.sqrt(w @ w)))
                    yield pd.DataFrame({"tip": v, "far": far[far > 0]})

    rows = reps.select("x").mapInPandas(beyond, "tip int, far double").groupBy("tip").agg(F.percentile("far", F.lit(share)).alias("far")).collect()
    reach = {r["tip"]: r["far"] for r in rows}
    adjacency, nodes = graph.adjacency, graph.nodes
    for v, _ in tips:
        if v in reach:
            k, w = len(adjacency), ways[v]
            adjacency = np.pad(adjacency, ((0, 1), (0, 1)))
            adjacency[v, k] = adjacency[k, v] = 1
            nodes = np.column_stack([nodes, graph.nodes[:, v] + w / max(1e-12, float(np.sqrt(w @ w))) * reach[v]])
    return PrincipalGraph(adjacency, nodes, graph.method, graph.sigma, graph.lam)


def edge_assign(reps: DataFrame, graph: PrincipalGraph) -> DataFrame:
    """``reps`` plus r for a hard graph: each row's weights on the two nodes of its nearest edge, the nearer one's larger."""
    sent = reps.sparkSession.sparkContext.broadcast((graph.nodes, graph.edges))

    @F.pandas_udf("array<double>")
    def assign(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        nodes, edges = sent.value
        rows = _matrix(x)
        a, b = nodes[:, [e[0] for e in edges]], nodes[:, [e[1] for e in edges]]
        along = b - a
        u = np.clip(((rows @ along) - (a * along).sum(axis=0)) / np.maximum(1e-12, (along * along).sum(axis=0)), 0, 1)
        gap = ((rows[:, :, None] - a[None] - u[:, None, :] * along[None]) ** 2).sum(axis=1)
        near = (gap <= gap.min(axis=1, keepdims=True) * (1 + 1e-9)).argmax(axis=1)  # edges that meet in the nearest point tie: the first
        d = pairwise(rows.T, nodes)
        r = np.zeros_like(d)
        ends = np.array(edges)[near]
        i = np.arange(len(rows))
        total = d[i, ends[:, 0]] + d[i, ends[:, 1]]
        for side in (0, 1):
            r[i, ends[:, side]] = 1 - np.divide(d[i, ends[:, side]], total, out=np.full(len(rows), 0.5), where=total > 0)
        return pd.Series(list(r))

    return reps.withColumn("r", assign("x"))


def fate_vectors(fates: DataFrame, time: str, probabilities: list[str]) -> DataFrame:
    """Vectors for a tree of fates: one probability and time for two fates, else a circular projection and time."""
    if len(probabilities) == 2:
        return fates.withColumn("x", F.array(F.col(probabilities[0]).cast("double"), F.col(time).cast("double")))
    turn = [2 * np.pi * i / len(probabilities) for i in range(len(probabilities))]
    c, s = (sum(F.col(p) * float(f(a)) for p, a in zip(probabilities, turn, strict=True)) for f in (np.cos, np.sin))
    return fates.withColumn("x", F.array(c.cast("double"), s.cast("double"), F.col(time).cast("double")))


def regroup(df: DataFrame, groups: list[list[int]], mean: bool = True) -> DataFrame:
    """r with one place for each group of old nodes, row-normalised."""
    parts = [sum((F.get("r", F.lit(i)) for i in g), F.lit(0.0)) / (len(g) if mean else 1) for g in groups]
    total = F.aggregate("_r", F.lit(0.0), lambda a, v: a + v)
    return df.withColumn("_r", F.array(*parts)).withColumn("_t", total).withColumn("r", F.transform("_r", lambda v: F.when(F.col("_t") > 0, v / F.col("_t")).otherwise(0.0))).drop("_r", "_t")


def nodes_from(df: DataFrame, k: int, dims: int) -> np.ndarray:
    """Nodes as R-weighted means of x (columns x and r)."""
    sums = df.select(F.posexplode("r").alias("node", "w"), "x").where("w > 0").select("node", "w", F.posexplode("x").alias("dim", "v"))
    rows = sums.groupBy("node", "dim").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m")).collect()  # k * dims rows
    out = np.zeros((dims, k))
    for r in rows:
        out[r["dim"], r["node"]] = r["m"]
    return out


def simplify(df: DataFrame, graph: PrincipalGraph, n_nodes: int = 10) -> tuple[DataFrame, PrincipalGraph]:
    groups = graph.simplified_groups(n_nodes)
    out = regroup(df, groups)
    nodes = nodes_from(out, len(groups), len(graph.nodes))
    old = [g[0] for g in groups]
    stones = {k: old.index(v) for k, v in graph.milestones.items()}
    g = PrincipalGraph(minimum_spanning_tree(pairwise(nodes)), nodes, graph.method, graph.sigma, graph.lam, milestones=stones)
    return out, g.rooted(old.index(graph.root))


def attach(a: DataFrame, ga: PrincipalGraph, b: DataFrame, gb: PrincipalGraph, linkage: tuple[int, int] | None = None) -> tuple[DataFrame, PrincipalGraph]:
    """Rows of both, R block-diagonal; linked by an edge, or by a new spanning tree; then one soft solve."""
    if ga.method != "ppt" or gb.method != "ppt":
        raise ValueError("both trees must be of method ppt")
    ka, kb = ga.nodes.shape[1], gb.nodes.shape[1]
    left = a.withColumn("r", F.concat("r", F.array_repeat(F.lit(0.0), kb)))
    right = b.withColumn("r", F.concat(F.array_repeat(F.lit(0.0), ka), "r"))
    both = left.unionByName(right, allowMissingColumns=True)
    nodes = nodes_from(both, ka + kb, len(ga.nodes))
    adjacency = minimum_spanning_tree(pairwise(nodes))
    if linkage:
        adjacency = np.zeros((ka + kb, ka + kb), int)
        adjacency[:ka, :ka], adjacency[ka:, ka:] = ga.adjacency, gb.adjacency
        i, j = linkage[0], ka + linkage[1]
        adjacency[i, j] = adjacency[j, i] = 1
    g = convert_to_soft(both, PrincipalGraph(adjacency, nodes, "ppt", ga.sigma, ga.lam), ga.sigma, ga.lam)
    return soft_assign(both.drop("r"), g.nodes, g.sigma), g
