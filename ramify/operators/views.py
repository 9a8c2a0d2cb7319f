"""The data behind each plot, and accessors of results; always DataFrames, never figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ramify.operators.relational import equal_width_bin, min_max
from ramify.plans.graph import PrincipalGraph


def node_projection(assigned: DataFrame, embedding: str) -> DataFrame:
    """node, dim, x: nodes in another embedding, as R-weighted means."""
    rows = assigned.select(F.posexplode("r").alias("node", "w"), F.col(embedding).alias("e")).where("w > 0").select("node", "w", F.posexplode("e").alias("dim", "v"))
    return rows.groupBy("node", "dim").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("x"))


def graph_edges(spark, graph: PrincipalGraph) -> DataFrame:
    return spark.createDataFrame([(a, b, float(graph.weights()[a, b])) for a, b in graph.edges], "src int, dst int, w double")


def edge_values(node_values: DataFrame, edges: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """src, dst, value: mean of both ends; values beyond given percentiles are clamped."""
    if low is not None or high is not None:
        cuts = node_values.agg(F.percentile("value", F.lit((low or 0) / 100)).alias("_a"), F.percentile("value", F.lit((100 if high is None else high) / 100)).alias("_b"))
        node_values = node_values.crossJoin(F.broadcast(cuts)).select("node", F.greatest("_a", F.least("_b", "value")).alias("value"))
    a, b = (node_values.select(F.col("node").alias(k), F.col("value").alias(f"_{k}")) for k in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", ((F.col("_src") + F.col("_dst")) / 2).alias("value"))


def arrow_values(cells: DataFrame, value: str) -> DataFrame:
    """node, value: mean over the cells whose edge touches the node."""
    return cells.select(F.explode(F.split("edge", r"\|").cast("array<int>")).alias("node"), value).groupBy("node").agg(F.avg(value).alias("value"))


def arrow_places(graph: PrincipalGraph) -> list[tuple[str, int, int]]:
    """segment, node, next node: the edge at half of each segment's length."""
    out = []
    for s in graph.segments:
        path = graph.path(s.start, s.end)
        half = (graph.time[s.start] + graph.time[s.end]) / 2
        i = next((i for i in range(1, len(path)) if graph.time[path[i]] >= half), len(path) - 1)
        out.append((s.n, path[i - 1], path[i]))
    return out


def milestone_gradient(cells: DataFrame) -> DataFrame:
    """``cells`` plus progress along the segment, 0 to 1."""
    return cells.withColumn("progress", min_max("t", "seg"))


def binned_meta(cells: DataFrame, category: str, n: int = 20) -> DataFrame:
    """bin, category, share: composition of each equal-width bin of t; combinations that don't occur have share 0."""
    span = cells.agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    rows = cells.crossJoin(F.broadcast(span)).withColumn("bin", equal_width_bin(F.col("t"), F.col("_a"), F.col("_b"), n))
    counts = rows.groupBy("bin", category).agg(F.count("*").alias("n"))
    grid = counts.select("bin").distinct().crossJoin(F.broadcast(counts.select(category).distinct()))
    filled = grid.join(counts, ["bin", category], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = filled.groupBy("bin").agg(F.sum("n").alias("total"))
    return filled.join(total, "bin").select("bin", category, (F.col("n") / F.col("total")).alias("share"))


def binned_matrix(cells: DataFrame, expr: DataFrame, n: int = 10, norm: str = "minmax") -> DataFrame:
    """seg, bin, gene, value: mean of each bin of each segment, scaled by gene; ``expr`` has its zeros."""
    span = cells.groupBy("seg").agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    rows = cells.join(F.broadcast(span), "seg").withColumn("bin", equal_width_bin(F.col("t"), F.col("_a"), F.col("_b"), n)).select("cell", "seg", "bin")
    means = rows.join(expr, "cell").groupBy("seg", "bin", "gene").agg(F.avg("value").alias("value"))
    w = Window.partitionBy("gene")
    if norm == "minmax":
        return means.withColumn("value", min_max("value", "gene"))
    return means.withColumn("value", F.col("value") / F.max("value").over(w)) if norm == "max" else means


def trend_order(fitted: DataFrame, cells: DataFrame, how: str = "quantile", q: float = 0.8, threshold: float = 0.8) -> DataFrame:
    """gene, place: mean time of the cells where the feature is high (above its q-quantile, or scaled above a threshold)."""
    rows = fitted.join(cells.select("cell", "t"), "cell")
    if how == "quantile":
        cut = fitted.groupBy("gene").agg(F.percentile("fitted", F.lit(q)).alias("_c"))
        high = rows.join(cut, "gene").where(F.col("fitted") > F.col("_c"))
    elif how == "max":
        high = rows.withColumn("_s", min_max("fitted", "gene")).where(F.col("_s") > threshold)
    else:
        first = trend_order(fitted, cells).orderBy("place", "gene").limit(1).select(F.col("gene").alias("lead"))
        lead = fitted.join(F.broadcast(first), F.col("gene") == F.col("lead")).select("cell", F.col("fitted").alias("_l"))
        pairs = fitted.join(lead, "cell")
        if how == "spearman":
            from ramify.operators.relational import average_rank

            pairs = pairs.withColumn("_x", average_rank("fitted", "gene")).withColumn("_y", average_rank("_l", "gene"))
        else:
            pairs = pairs.withColumns({"_x": F.col("fitted"), "_y": F.col("_l")})
        return pairs.groupBy("gene").agg((-F.corr("_x", "_y")).alias("place"))
    return high.groupBy("gene").agg(F.avg("t").alias("place"))


def single_trend(cells: DataFrame, expr: DataFrame, fitted: DataFrame, gene: str) -> DataFrame:
    """cell, t, seg, value, fitted of one feature, in order of time."""
    mine = expr.where(F.col("gene") == gene).select("cell", "value")
    rows = cells.select("cell", "t", "seg").join(mine, "cell", "left").join(fitted.where(F.col("gene") == gene).select("cell", "fitted"), "cell", "left")
    return rows.withColumn("value", F.coalesce("value", F.lit(0.0))).orderBy("t")


def mean_trajectory(fitted: DataFrame, cells: DataFrame, n: int = 50) -> DataFrame:
    """seg, bin, value: mean of all features over bins of t."""
    span = cells.groupBy("seg").agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    rows = cells.join(F.broadcast(span), "seg").withColumn("bin", equal_width_bin(F.col("t"), F.col("_a"), F.col("_b"), n))
    return rows.hint("merge").join(fitted, "cell").groupBy("seg", "bin").agg(F.avg("fitted").alias("value"))  # a row a cell is too much to broadcast


def top_features(stats: DataFrame, by: str, n: int, least: bool = False) -> DataFrame:
    order = F.col(by).asc() if least else F.col(by).desc()
    return stats.orderBy(order, "gene").limit(n)


def association_points(stats: DataFrame) -> DataFrame:
    """gene, A, fdr, signi; an fdr of zero becomes the least positive one."""
    least = stats.where("fdr > 0").agg(F.min("fdr").alias("_l"))
    return stats.crossJoin(F.broadcast(least)).select("gene", "A", F.when(F.col("fdr") == 0, F.col("_l")).otherwise(F.col("fdr")).alias("fdr"), "signi")


def fork_points(fork: DataFrame, branches: list[str]) -> DataFrame:
    return fork.where("fdr < 0.05").select("gene", "fdr", *branches)


def fork_stats(fork: DataFrame, module: str | None = None, branch: str | None = None) -> DataFrame:
    for column, wanted in (("module", module), ("branch", branch)):
        if wanted is not None:
            fork = fork.where(F.col(column) == wanted)
    return fork


def get_slide_cors(cors: DataFrame, branch: str, geneset_branch: str) -> DataFrame:
    return cors.where((F.col("branch") == branch) & (F.col("geneset") == geneset_branch))


def modules(dense: DataFrame, cells: DataFrame, fork: DataFrame) -> DataFrame:
    """cell, branch, module, value: mean of each module's features; ``fork`` has gene, branch, module."""
    rows = dense.join(cells.select("cell"), "cell", "left_semi").join(F.broadcast(fork.select("gene", "branch", "module")), "gene")
    return rows.groupBy("cell", "branch", "module").agg(F.avg("value").alias("value"))


def smoothed(values: DataFrame, edges: DataFrame) -> DataFrame:
    """cell, value: sum over neighbours by edge weight (src, dst, w)."""
    return edges.join(values.select(F.col("cell").alias("dst"), "value"), "dst").groupBy(F.col("src").alias("cell")).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def repulsion(cors: DataFrame) -> DataFrame:
    """window, score: |corr of group codes with each set's correlations, averaged|; columns window, grp (0/1), cor_a, cor_b."""
    both = (F.corr(F.col("grp").cast("double"), "cor_a") + F.corr(1 - F.col("grp").cast("double"), "cor_b")) / 2
    return cors.groupBy("window").agg(F.abs(both).alias("score"))


def inclusion_cdf(inclusions: DataFrame, n: int, top: float) -> DataFrame:
    """gene, at, share: of the mappings, those that include the gene by then, on an even grid."""
    grid = inclusions.sparkSession.createDataFrame([(i * top / (n - 1),) for i in range(n)], "at double")
    return inclusions.crossJoin(F.broadcast(grid)).groupBy("gene", "at").agg(F.avg((F.col("inclusion_t") <= F.col("at")).cast("double")).alias("share"))


def synchro_curves(synchro: DataFrame, knots: int = 10) -> DataFrame:
    """run, branch, which, t, fit, se: smooths of the three correlations; a few windows per group."""
    import numpy as np
    import pandas as pd

    from ramify.functions.splines import gam

    def curve(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t")
        out = []
        for which in ("corAA", "corBB", "corAB"):
            g = gam(f["t"].to_numpy(), f[which].to_numpy(), knots, shrink=True)
            out += [(key[0], key[1], which, float(t), float(v), float(s)) for t, v, s in zip(f["t"], g.fitted, np.asarray(g.band()), strict=True)]
        return pd.DataFrame(out, columns=["run", "branch", "which", "t", "fit", "se"])

    return synchro.groupBy("run", "branch").applyInPandas(curve, "run string, branch string, which string, t double, fit double, se double")
