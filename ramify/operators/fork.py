"""Bifurcation analysis: what differs between branches, where it rises, and when."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.functions.splines import anova_p
from ramify.operators.assoc import GroupModels, bonferroni_over
from ramify.operators.features import Features, collected, gam_sums, line_sums
from ramify.operators.relational import only_once, value_windows
from ramify.scratch import saved


def branch_cells(paths: DataFrame, rescale: bool = False) -> DataFrame:
    """Cells on exactly one path (cell, t, branch); ``rescale``: t from 0 to 1 on each branch."""
    rows = only_once(paths.select("cell", "t", "branch"), "cell")
    if rescale:
        from ramify.operators.relational import min_max

        rows = rows.withColumn("t", min_max("t", "branch"))
    return rows


def branch_effects(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """gene, branch, mean, effect: mean minus the largest mean of the gene, over times that all branches reach."""
    ends = cells.groupBy("branch").agg(F.max("t").alias("m")).agg(F.min("m").alias("_end"))
    inside = cells.crossJoin(F.broadcast(ends)).where(F.col("t") <= F.col("_end")).select("cell", "branch")
    n = inside.groupBy("branch").agg(F.count("*").alias("n"))
    grid = expr.select("gene").distinct().crossJoin(F.broadcast(n))
    sums = expr.join(inside, "cell").groupBy("gene", "branch").agg(F.sum("value").alias("s"))
    means = grid.join(sums, ["gene", "branch"], "left").select("gene", "branch", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"))
    top = means.groupBy("gene").agg(F.max("mean").alias("top"))
    return means.join(top, "gene").select("gene", "branch", "mean", (F.col("mean") - F.col("top")).alias("effect"))


def test_fork(expr: DataFrame, paths: DataFrame, rescale: bool = False) -> DataFrame:
    """gene, de_p (branch main effect), inter_p (interaction), fdr, effect of each branch, branch, up_A, up_p, signi_p, signi_fdr.

    ``paths``: (cell, t, branch) of whole root-to-tip paths, shared cells once for each.
    """
    cells = branch_cells(paths, rescale)
    f = Features(expr, cells, "branch", 5, common=True)
    models = GroupModels(f.keys)
    branches = models.names

    def kernel(by: dict[str, tuple[np.ndarray, float]]) -> tuple:
        full = models.fit(by)[0]
        p = full.p_value(1)
        return 1.0 if np.isnan(p) else p, anova_p(full, models.fit(by, own=False)[0])

    tested = bonferroni_over(f.fits(kernel, "de_p double, inter_p double"), "de_p", "fdr", expr)
    effects = branch_effects(expr, cells)
    wide = effects.groupBy("gene").pivot("branch", branches).agg(F.first("effect"))
    best = effects.groupBy("gene").agg(F.max_by("branch", F.struct("effect", F.col("branch"))).alias("branch"))

    lines = Features(expr, paths, "branch", 0)
    keys = lines.keys
    slope = lines.fits(lambda by: tuple(list(v) for v in zip(*(line_sums(key, *by[name]) for name, key in keys.items()), strict=True)), "a array<double>, p array<double>")
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, keys)).alias("branch"), "a", "p")).alias("e")
    up = slope.select("gene", each).select("gene", "e.branch", F.col("e.a").alias("up_A"), F.col("e.p").alias("up_p"))
    out = tested.join(wide, "gene").join(best, "gene").join(up, ["gene", "branch"])
    return out.withColumn("signi_p", (F.col("de_p") < 0.05).cast("int")).withColumn("signi_fdr", (F.col("fdr") < 0.05).cast("int"))


def summarise_maps(forks: DataFrame, branches: list[str]) -> DataFrame:
    """Medians of effects, p and fdr, means of flags, over mappings (column map_id)."""
    middle = [F.median(c).alias(c) for c in ("de_p", "fdr", "up_A", "up_p", *branches)]
    return forks.groupBy("gene").agg(*middle, *[F.avg(c).alias(c) for c in ("signi_p", "signi_fdr")])


def branch_specific(fork: DataFrame, branches: list[str], effect: float, stf_cut: float = 0.7, up_a: float = 0.0, up_p: float = 0.05) -> DataFrame:
    """Rows that pass and belong to exactly one branch (effect within ``effect`` of the best), and that branch."""
    passed = fork.where((F.col("up_A") > up_a) & (F.col("up_p") < up_p) & (F.col("signi_fdr") > stf_cut))
    near = [F.col(f"`{b}`") + effect >= 0 for b in branches]
    one = sum((n.cast("int") for n in near), F.lit(0)) == 1
    which = F.coalesce(*[F.when(n, F.lit(b)) for n, b in zip(near, branches, strict=True)])
    return passed.where(one).withColumn("branch", which)


def window_ends(cells: DataFrame, key: str, n_windows: int, steps: int) -> dict[str, tuple[float, list[tuple[float, float, float]]]]:
    """By key: the last t, and of each window with two cells or more its middle, first and last t."""
    bounds = cells.groupBy(key).agg(F.min("t").alias("a"), F.max("t").alias("b")).collect()  # branches
    windows = [(r[key], a, b) for r in bounds for a, b in value_windows(r["a"], r["b"], n_windows, steps)]
    out: dict[str, tuple[float, list]] = {r[key]: (r["b"], []) for r in bounds}
    if windows:
        table = cells.sparkSession.createDataFrame(windows, f"{key} string, start double, end double")
        inside = cells.join(F.broadcast(table), [key]).where((F.col("t") > F.col("start")) & (F.col("t") < F.col("end")))
        for r in inside.groupBy(key, "start", "end").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).where("n > 1").orderBy("start").collect():
            out[r[key]][1].append(((r["start"] + r["end"]) / 2, r["a"], r["b"]))
    return out


def activation(expr: DataFrame, paths: DataFrame, features: DataFrame, fork_time: float, deriv_cut: float = 0.15, n_windows: int = 20, steps: int = 5) -> DataFrame:
    """gene, branch, activation, module: early if at the fork or before. ``features``: gene, branch.

    Activation is the middle of the first window in which the fit, scaled to its range, rises by
    more than ``deriv_cut``; else the branch's end plus one.
    """
    mine = expr.join(features.select("gene").distinct(), "gene", "left_semi")
    f = Features(mine, paths, "branch", 10)
    keys = f.keys
    stats = saved(f.fits(lambda by: ([v for name, key in keys.items() for v in gam_sums(key, *by[name])[1]],), "beta array<double>"), "activation")
    fits = collected(stats, list(keys), {n: x.size for n, x in keys.items()})
    ends = window_ends(f.cells, "key", n_windows, steps)
    rises = {name: (last, [w[0] for w in found], keys[name].rows(np.array([w[2] for w in found])) - keys[name].rows(np.array([w[1] for w in found]))) for name, (last, found) in ends.items()}
    rows = []
    for r in f.ranges(fits).collect():  # a row per feature and branch
        last, middle, rise = rises[r["key"]]
        span = r["high"] - r["low"]
        up = np.flatnonzero(rise @ fits[r["gene"]][r["key"]] > deriv_cut * span) if span > 0 else ()
        rows.append((r["gene"], r["key"], float(middle[up[0]] if len(up) else last + 1)))
    found = expr.sparkSession.createDataFrame(rows, "gene string, branch string, activation double").join(features.select("gene", "branch"), ["gene", "branch"])
    return found.withColumn("module", F.when(F.col("activation") > fork_time, "late").otherwise("early"))


def window_onsets(curve: DataFrame, key: str, windows: DataFrame, deriv_cut: float) -> DataFrame:
    """key, onset: from a curve (key, t, fit scaled to [0, 1]) and a small table of windows (start, end)."""
    inside = curve.join(F.broadcast(windows), (F.col("t") > F.col("start")) & (F.col("t") < F.col("end")))
    rise = inside.groupBy(key, "start", "end").agg((F.max_by("fit", "t") - F.min_by("fit", "t")).alias("change"))
    first = rise.where(F.col("change") > deriv_cut).groupBy(key).agg(F.min((F.col("start") + F.col("end")) / 2).alias("onset"))
    last = curve.groupBy(key).agg((F.max("t") + 1).alias("never"))
    return last.join(first, key, "left").select(key, F.coalesce("onset", "never").alias("onset"))


def slopes(rows: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """key, slope, t_stat, df: regression of value on t in each group."""
    s = rows.groupBy(key).agg(F.regr_slope(value, t).alias("slope"), F.regr_r2(value, t).alias("_r2"), F.regr_count(value, t).alias("_n"))
    return s.select(key, "slope", F.sqrt(F.col("_r2") * (F.col("_n") - 2) / (1 - F.col("_r2"))).alias("t_stat"), (F.col("_n") - 2).alias("df"))


def activation_lm(expr: DataFrame, before: DataFrame, fdr_cut: float = 0.05, stf_cut: float = 0.8) -> DataFrame:
    """gene, slope, pre_pval, pre_fdr, prefork_signi, module, over the cells before the fork (cell, t)."""
    lines = Features(expr, before.withColumn("_all", F.lit("")), "_all", 0)
    keys = lines.keys
    rows = lines.fits(lambda by: line_sums(keys[""], *by[""]) if keys else (float("nan"), float("nan")), "slope double, pre_pval double")
    rows = bonferroni_over(rows.fillna(1.0, ["pre_pval"]), "pre_pval", "pre_fdr", expr).withColumn("prefork_signi", (F.col("pre_fdr") < fdr_cut).cast("double"))
    return rows.withColumn("module", F.when((F.col("slope") > 0) & (F.col("prefork_signi") > stf_cut), "early").otherwise("late"))
