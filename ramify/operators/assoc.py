"""Tests and smooth fits of features along a graph.

``cells`` is (cell, t, seg, ...), ``expr`` sparse (cell, gene, value). Fits are made of sums (see
``features``), so that neither a feature's cells nor the table of cells meet in one task.
``per_feature`` is for kernels of any other kind: there a feature's group holds its non-zero rows,
and the cells it lacks are restored inside the group from the cells' table, which is sent to every
task when it is small and joined otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.functions import numerics as num
from ramify.functions.splines import SumFit, anova_p, fit_sums, group_terms
from ramify.operators.features import Features, Key, collected, gam_sums
from ramify.scratch import saved

#: Cells that are sent to all tasks at most; beyond, zeros are restored by a join.
BROADCAST_CELLS = 2_000_000


def per_feature(expr: DataFrame, cells: DataFrame, columns: list[str], kernel: Callable[[str, pd.DataFrame], list[tuple]], schema: str, keys: list[str] | None = None) -> DataFrame:
    """Runs ``kernel(gene, frame of columns and y)`` for each gene over all cells."""
    spark = expr.sparkSession
    keep = cells.select("cell", *columns, *(keys or []))
    small = keep.count() <= BROADCAST_CELLS
    table = spark.sparkContext.broadcast(keep.toPandas().sort_values("cell").reset_index(drop=True)) if small else None
    names = schema.split(", ")

    def with_zeros(gene: str, frame: pd.DataFrame) -> pd.DataFrame:
        if table is None:
            return frame.assign(y=frame["value"].fillna(0.0)).sort_values("cell")
        every = table.value
        y = frame.groupby("cell")["value"].sum()
        return every.assign(y=every["cell"].map(y).fillna(0.0).to_numpy())

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = kernel(key[0], with_zeros(key[0], frame))
        return pd.DataFrame(rows, columns=[n.split()[0] for n in names])

    if small:
        rows = expr.select("gene", "cell", "value")
    else:
        rows = expr.select("gene").distinct().crossJoin(keep).join(expr.select("gene", "cell", "value"), ["gene", "cell"], "left")
    return rows.groupBy("gene").applyInPandas(run, schema)


def association_sums(keys: dict[str, Key], by: dict[str, tuple[np.ndarray, float]]) -> tuple[float, list[float]]:
    """(p, coefficients of all segments): splines of each segment against the mean of all."""
    deviance, df_resid, beta = 0.0, 0.0, []
    for name, key in keys.items():
        fit, coefficients = gam_sums(key, *by[name])
        deviance += fit.deviance
        df_resid += key.n - fit.edf
        beta += coefficients.tolist()
    n, yy = sum(k.n for k in keys.values()), sum(v for _, v in by.values())
    null, df0 = yy - sum(xy[0] for xy, _ in by.values()) ** 2 / n, n - 1
    df = df_resid - len(keys)
    if deviance <= 1e-12 + 1e-11 * yy or df <= 0 or df0 - df <= 0:  # nothing is left, but for rounding
        return 1.0, beta
    return num.f_sf((null - deviance) / (df0 - df) / (deviance / df), df0 - df, df), beta


def test_association(expr: DataFrame, maps: DataFrame, k: int = 5, fdr_cut: float = 1e-4, a_cut: float = 1.0, st_cut: float = 0.8) -> DataFrame:
    """gene, p_val, A, fdr, st, signi; ``maps`` (map_id, cell, t, seg) holds one or more mappings."""
    out = None
    for (m,) in maps.select("map_id").distinct().orderBy("map_id").collect():
        f = Features(expr, maps.where(F.col("map_id") == m), "seg", k)
        keys = f.keys
        stats = saved(f.fits(lambda by, keys=keys: association_sums(keys, by), "p_val double, beta array<double>"), "association")
        spans = f.ranges(collected(stats, list(keys), {n: x.size for n, x in keys.items()})).groupBy("gene").agg((F.max("high") - F.min("low")).alias("A"))
        one = bonferroni_over(stats.select("gene", "p_val").join(spans, "gene"), "p_val", "fdr", expr).withColumn("map_id", F.lit(m))
        out = one if out is None else out.union(one)
    return apply_filters(out, fdr_cut, a_cut, st_cut)


def bonferroni_over(stats: DataFrame, p: str, out: str, expr: DataFrame) -> DataFrame:
    """Bonferroni over the features of ``expr``, so that the fits behind ``stats`` run once."""
    n = expr.select("gene").distinct().count()
    return stats.withColumn(out, F.least(F.col(p) * n, F.lit(1.0)))


def apply_filters(stats: DataFrame, fdr_cut: float = 1e-4, a_cut: float = 1.0, st_cut: float = 0.8, key: str = "gene") -> DataFrame:
    """Medians over mappings, the share of mappings that pass, and whether it exceeds ``st_cut``."""
    passes = ((F.col("fdr") < fdr_cut) & (F.col("A") > a_cut)).cast("double")
    out = stats.groupBy(key).agg(F.median("p_val").alias("p_val"), F.median("A").alias("A"), F.median("fdr").alias("fdr"), F.avg(passes).alias("st"))
    return out.withColumn("signi", F.col("st") > st_cut)


def test_association_covariate(expr: DataFrame, cells: DataFrame, group: str, **options) -> DataFrame:
    """The test within each group; columns are prefixed by the group, signi holds if any group's does."""
    out = None
    for (g,) in cells.select(group).distinct().orderBy(group).collect():
        mine = cells.where(F.col(group) == g)
        maps = mine.select(F.lit(0).alias("map_id"), "cell", "t", "seg")
        one = test_association(expr.join(mine.select("cell"), "cell", "left_semi"), maps, **options)
        one = one.select("gene", *[F.col(c).alias(f"{g}_{c}") for c in ("p_val", "A", "fdr", "st", "signi")])
        out = one if out is None else out.join(one, "gene", "full")
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in out.columns if c.endswith("_signi")]
    signi = flags[0]
    for f in flags[1:]:
        signi = signi | f
    return out.withColumn("signi", signi)


def fit_features(expr: DataFrame, paths: DataFrame, gamma: float = 1.5, knots: int = 10) -> DataFrame:
    """gene, cell, fitted: a shrinkage spline on each branch (columns cell, t, branch), averaged over branches."""
    f = Features(expr, paths, "branch", knots, shrink=True)
    keys = f.keys
    stats = f.fits(lambda by: ([v for name, key in keys.items() for v in gam_sums(key, *by[name], gamma)[1]],), "beta array<double>")

    def of(name: str, part: pd.DataFrame, genes: list[str], values: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"gene": np.repeat(genes, len(part)), "cell": np.tile(part["cell"].to_numpy(), len(genes)), "fitted": values[0].T.ravel()})

    coefficients = collected(stats, list(keys), {n: x.size for n, x in keys.items()})
    return f.curves(coefficients, "gene string, cell long, fitted double", of).groupBy("gene", "cell").agg(F.avg("fitted").alias("fitted"))


def linearity_labels(path: DataFrame, low: float = 20, high: float = 80) -> DataFrame:
    """``path`` plus part: progenitors below the low percentile of t, progenies above the high one, bridge between."""
    cuts = path.agg(F.percentile("t", F.lit(low / 100)).alias("_a"), F.percentile("t", F.lit(high / 100)).alias("_b"))
    part = F.when(F.col("t") < F.col("_a"), "progenitors").when(F.col("t") > F.col("_b"), "progenies").otherwise("bridge")
    return path.crossJoin(F.broadcast(cuts)).withColumn("part", part).drop("_a", "_b")


def linearity_deviation(expr: DataFrame, path: DataFrame, low: float = 20, high: float = 80) -> DataFrame:
    """gene, rss: mean Pearson residual of bridge cells as mixtures of both ends, over the gene's spread.

    The two-regressor fits are closed forms of sums by cell; zeros drop out of all of them.
    """
    parts = linearity_labels(path, low, high).select("cell", "part")
    rows = expr.join(parts, "cell")
    n = parts.groupBy().agg(F.count_if(F.col("part") == "progenitors").alias("na"), F.count_if(F.col("part") == "progenies").alias("nb"), F.count_if(F.col("part") == "bridge").alias("nx"), F.count("*").alias("n"))
    end = lambda p: F.sum(F.when(F.col("part") == p, F.col("value")).otherwise(0.0))
    genes = rows.groupBy("gene").agg(end("progenitors").alias("sa"), end("progenies").alias("sb"), F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("ss")).crossJoin(F.broadcast(n))
    var = F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) ** 2
    genes = genes.select("gene", (F.col("sa") / F.col("na")).alias("a"), (F.col("sb") / F.col("nb")).alias("b"), F.when(var > 0, F.sqrt(var)).otherwise(1.0).alias("sd"), "nx")
    whole = genes.agg(F.sum(F.col("a") ** 2).alias("aa"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("b") ** 2).alias("bb"), F.count("*").alias("g"))
    bridge = rows.where("part = 'bridge'").join(genes, "gene")
    sums = bridge.groupBy("cell").agg(F.sum(F.col("a") * F.col("value")).alias("ax"), F.sum(F.col("b") * F.col("value")).alias("bx"), F.sum(F.col("value") ** 2).alias("xx")).crossJoin(F.broadcast(whole))
    det = F.col("aa") * F.col("bb") - F.col("ab") ** 2
    u, v = (F.col("bb") * F.col("ax") - F.col("ab") * F.col("bx")) / det, (F.col("aa") * F.col("bx") - F.col("ab") * F.col("ax")) / det
    fits = sums.select("cell", u.alias("u"), v.alias("v"), F.sqrt((F.col("xx") - u * F.col("ax") - v * F.col("bx")) / (F.col("g") - 2)).alias("s"))
    # Sum of (x - u a - v b) / s over bridge cells, zeros of x included.
    scale = fits.agg(F.sum(F.col("u") / F.col("s")).alias("us"), F.sum(F.col("v") / F.col("s")).alias("vs"))
    seen = bridge.join(fits, "cell").groupBy("gene").agg(F.sum(F.col("value") / F.col("s")).alias("xs"))
    out = genes.join(seen, "gene", "left").crossJoin(F.broadcast(scale))
    total = F.coalesce("xs", F.lit(0.0)) - F.col("a") * F.col("us") - F.col("b") * F.col("vs")
    return out.select("gene", (total / F.col("nx") / F.col("sd")).alias("rss"))


class GroupModels:
    """y ~ [s(t)] + [s(t, by = group)] + group for all features, from sums of (1, columns of one smooth) by group."""

    def __init__(self, keys: dict[str, Key]):
        self.sizes = {name: k.size for name, k in keys.items()}
        self.names, self.n = list(keys), sum(k.n for k in keys.values())
        sums, size = [(k.n, k.xx) for k in keys.values()], next(iter(keys.values())).size
        self.whole = np.zeros((size * len(sums), size * len(sums)))
        for i, (_, xx) in enumerate(sums):
            self.whole[i * size : (i + 1) * size, i * size : (i + 1) * size] = xx
        smooth = next(iter(keys.values())).smooth
        self.parts = {which: group_terms(sums, smooth.penalty if smooth else None, *which) for which in ((True, True), (True, False), (False, False))}

    def fit(self, by: dict[str, tuple[np.ndarray, float]], shared: bool = True, own: bool = True) -> tuple[SumFit, list[float]]:
        """(fit, coefficients of all groups' raw columns)."""
        turn, terms = self.parts[shared, own]
        xy, yy = np.concatenate([by[n][0] for n in self.names]), sum(by[n][1] for n in self.names)
        fit = fit_sums(turn.T @ self.whole @ turn, turn.T @ xy, yy, self.n, terms)
        return fit, (turn @ fit.beta).tolist()


def covariate_p(models: GroupModels, by: dict[str, tuple[np.ndarray, float]], trend: bool = False) -> float:
    """Amplitude: p of the second group's main effect. Trend: full model against one without the interaction."""
    full = models.fit(by)[0]
    return anova_p(full, models.fit(by, own=False)[0]) if trend else full.p_value(1)


def nested_p(models: GroupModels, by: dict[str, tuple[np.ndarray, float]]) -> tuple[float, float]:
    """(shared, specific): s(t) and group against group alone; the full model against the shared one."""
    full, shared, null = models.fit(by)[0], models.fit(by, own=False)[0], models.fit(by, shared=False, own=False)[0]
    return anova_p(shared, null), anova_p(full, shared)


def fold_changes(expr: DataFrame, cells: DataFrame, group: str, log_base: float | None = None) -> DataFrame:
    """gene, group, lfc: log2 of mean expression in the group over that of all other cells."""
    lb = float(np.log(log_base)) if log_base else 1.0
    rows = expr.join(cells.select("cell", F.col(group).alias("group")), "cell")
    n = cells.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("all_n"))
    grid = rows.select("gene").distinct().crossJoin(F.broadcast(n.crossJoin(F.broadcast(whole))))
    sums = rows.groupBy("gene", "group").agg(F.sum("value").alias("s"))
    total = rows.groupBy("gene").agg(F.sum("value").alias("all_s"))
    j = grid.join(sums, ["gene", "group"], "left").join(total, "gene").withColumn("s", F.coalesce("s", F.lit(0.0)))
    one = F.expm1(F.col("s") / F.col("n") * lb) + 1e-9
    rest = F.expm1((F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n")) * lb) + 1e-9
    return j.select("gene", "group", F.log2(one / rest).alias("lfc"))


def test_covariate(expr: DataFrame, cells: DataFrame, group: str, trend: bool = False, nested: bool = False, fdr_cut: float = 0.01, log_base: float | None = None) -> DataFrame:
    """gene, p, fdr (or those of shared and specific), amplitude A, cov_signi; NaN p counts as 1."""
    f = Features(expr, cells.where(F.col(group).isNotNull()), group, 5, common=True)
    models = GroupModels(f.keys)

    def kernel(by: dict[str, tuple[np.ndarray, float]]) -> tuple:
        p = nested_p(models, by) if nested else (covariate_p(models, by, trend), 1.0)
        return (*(float(np.nan_to_num(v, nan=1.0)) for v in p), models.fit(by)[1])

    stats = saved(f.fits(kernel, "p double, p_specific double, beta array<double>"), "covariate")
    spans = f.ranges(collected(stats, models.names, models.sizes)).withColumn("A", F.col("high") - F.col("low"))
    spans = (spans.where(F.col("key") == models.names[0]) if trend or nested else spans).groupBy("gene").agg(F.max("A").alias("A"))
    rows = stats.drop("beta").join(spans, "gene").orderBy("gene").toPandas()  # a row per feature
    if nested:
        rows["fdr"], rows["fdr_specific"] = (np.minimum(1, num.bh(rows[c].to_numpy())) for c in ("p", "p_specific"))
        rows["cov_signi"] = ((rows["fdr"] < fdr_cut) | (rows["fdr_specific"] < fdr_cut)).astype(int)
    else:
        rows["fdr"] = num.bonferroni(rows["p"].to_numpy())
        rows = rows.drop(columns="p_specific")
        rows["cov_signi"] = (rows["fdr"] < fdr_cut).astype(int)
    return expr.sparkSession.createDataFrame(rows)


def trend_covariate(expr: DataFrame, cells: DataFrame, group: str, k: int = 5) -> DataFrame:
    """gene, cell, full, reduced: fitted values with and without the interaction of time and group."""
    f = Features(expr, cells.where(F.col(group).isNotNull()), group, k, common=True)
    models = GroupModels(f.keys)
    stats = saved(f.fits(lambda by: (models.fit(by)[1], models.fit(by, own=False)[1]), "beta array<double>, reduced array<double>"), "trend")
    both = [collected(stats, models.names, models.sizes, c) for c in ("beta", "reduced")]
    coefficients = {g: {n: np.stack([x[g][n] for x in both]) for n in models.names} for g in both[0]}

    def of(name: str, part: pd.DataFrame, genes: list[str], values: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"gene": np.repeat(genes, len(part)), "cell": np.tile(part["cell"].to_numpy(), len(genes)), "full": values[0].T.ravel(), "reduced": values[1].T.ravel()})

    return f.curves(coefficients, "gene string, cell long, full double, reduced double", of)


def moran_i(values: DataFrame, edges: DataFrame) -> DataFrame:
    """gene, morans_I, p: over an edge table (src, dst, w); normal approximation under randomisation of signs.

    ``values`` is (gene, cell, value), zeros included.
    """
    mean = values.groupBy("gene").agg(F.avg("value").alias("_m"), F.count("*").alias("n"))
    z = values.join(mean, "gene").withColumn("z", F.col("value") - F.col("_m"))
    below = z.groupBy("gene").agg(F.sum(F.col("z") ** 2).alias("zz"), F.first("n").alias("n"))
    w = edges.agg(F.sum("w").alias("W"), F.sum(F.col("w") ** 2).alias("W2"))
    pairs = edges.join(z.select("gene", F.col("cell").alias("src"), F.col("z").alias("za")), "src").join(z.select("gene", F.col("cell").alias("dst"), F.col("z").alias("zb")), ["gene", "dst"])
    top = pairs.groupBy("gene").agg(F.sum(F.col("w") * F.col("za") * F.col("zb")).alias("top"))
    j = top.join(below, "gene").crossJoin(F.broadcast(w)).withColumn("morans_I", F.col("n") / F.col("W") * F.col("top") / F.col("zz"))
    score = (F.col("morans_I") + 1 / (F.col("n") - 1)) / F.sqrt(2 * F.col("W2") / F.col("W") ** 2)

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(num.normal_sf, na_action="ignore")

    return j.select("gene", "morans_I", tail(score).alias("p"))  # a row per gene


def test_association_monocle3(expr: DataFrame, cells: DataFrame, edges: DataFrame, q_cut: float = 1e-4) -> DataFrame:
    """gene, morans_I, p, q (Benjamini-Hochberg), signi."""
    from ramify.operators.preprocess import dense_slice
    from ramify.operators.relational import bh_adjusted

    dense = dense_slice(expr, cells, expr)
    return bh_adjusted(moran_i(dense, edges), "p", "q").withColumn("signi", F.col("q") < q_cut)


def cluster_features(fitted: DataFrame, k: int = 5, resolution: float = 1.0, rounds: int = 20) -> DataFrame:
    """gene, clusters: communities of the cosine neighbour graph of the features' profiles.

    Similarities are one self-join by cell; of each gene only its k neighbours reach the driver.
    """
    norm = fitted.groupBy("gene").agg(F.sqrt(F.sum(F.col("fitted") ** 2)).alias("norm"))
    unit = fitted.join(norm, "gene").where("norm > 0").select("gene", "cell", (F.col("fitted") / F.col("norm")).alias("u"))
    pairs = unit.join(unit.select(F.col("gene").alias("other"), "cell", F.col("u").alias("v")), "cell").where("gene != other")
    sim = pairs.groupBy("gene", "other").agg(F.round(F.sum(F.col("u") * F.col("v")), 9).alias("s"))
    from pyspark.sql import Window

    top = sim.withColumn("r", F.row_number().over(Window.partitionBy("gene").orderBy(F.desc("s"), "other"))).where(F.col("r") <= k)
    rows = top.select("gene", "other", "s").orderBy("gene", "other").collect()
    genes = sorted({r["gene"] for r in fitted.select("gene").distinct().collect()})
    labels = communities(genes, [(r["gene"], r["other"], max(0.0, r["s"])) for r in rows], resolution, rounds)
    return fitted.sparkSession.createDataFrame(list(labels.items()), "gene string, clusters int")


def communities(nodes: list[str], edges: list[tuple[str, str, float]], resolution: float, rounds: int) -> dict[str, int]:
    """Greedy modularity: each node in turn moves to the neighbouring community with the best gain."""
    w: dict[str, dict[str, float]] = {v: {} for v in nodes}
    for a, b, s in edges:
        w[a][b] = w[a].get(b, 0) + s
        w[b][a] = w[b].get(a, 0) + s
    degree = {v: sum(w[v].values()) for v in nodes}
    total = sum(degree.values()) or 1.0
    own = {v: i for i, v in enumerate(nodes)}
    mass = {i: degree[v] for v, i in own.items()}
    for _ in range(rounds):
        moved = False
        for v in nodes:
            mass[own[v]] -= degree[v]
            near: dict[int, float] = {own[v]: 0.0}
            for u, s in w[v].items():
                near[own[u]] = near.get(own[u], 0.0) + s
            best = max(sorted(near), key=lambda c: near[c] - resolution * degree[v] * mass[c] / total)
            moved |= best != own[v]
            own[v] = best
            mass[best] += degree[v]
        if not moved:
            break
    order = {c: i for i, c in enumerate(sorted(set(own.values()), key=lambda c: (-sum(x == c for x in own.values()), c)))}
    return {v: order[c] for v, c in own.items()}


