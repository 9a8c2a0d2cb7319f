"""Filtering, batch correction, overdispersion and diffusion over sparse (cell, gene, value) rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ramify.functions import numerics as num
from ramify.functions.splines import gam
from ramify.scratch import saved


def cell_totals(expr: DataFrame) -> DataFrame:
    """cell, x = ln(1 + total), y = ln(1 + number of non-zero genes)."""
    return expr.groupBy("cell").agg(F.log1p(F.sum("value")).alias("x"), F.log1p(F.count_if(F.col("value") != 0).cast("double")).alias("y"))


def prediction_band(points: DataFrame, slope: float, intercept: float, z: float) -> DataFrame:
    """``points`` (x, y) plus fit, se (prediction error of a line) and outlier."""
    s = points.agg(F.count("*").alias("_n"), F.avg("x").alias("_mx"), F.var_pop("x").alias("_vx"), F.avg((F.col("y") - intercept - slope * F.col("x")) ** 2).alias("_mse"))
    rows = points.crossJoin(F.broadcast(s)).withColumn("fit", intercept + slope * F.col("x"))
    se = F.sqrt("_mse") * F.sqrt(1 + 1 / F.col("_n") + (F.col("x") - F.col("_mx")) ** 2 / (F.col("_n") * F.col("_vx")))
    return rows.withColumn("se", se).withColumn("outlier", F.abs(F.col("y") - F.col("fit")) > F.col("se") * z).drop("_n", "_mx", "_vx", "_mse")


def robust_line(points: DataFrame, rounds: int = 25, tune: float = 1.345) -> tuple[float, float]:
    """(slope, intercept) by Huber-weighted least squares; each round is one aggregate, and one for the scale."""
    points = points.cache()
    try:
        slope, icpt, w = 0.0, 0.0, F.lit(1.0)
        for i in range(rounds):
            s = points.agg(F.sum(w).alias("n"), F.sum(w * F.col("x")).alias("x"), F.sum(w * F.col("y")).alias("y"), F.sum(w * F.col("x") ** 2).alias("xx"), F.sum(w * F.col("x") * F.col("y")).alias("xy")).first()
            new = (s["n"] * s["xy"] - s["x"] * s["y"]) / (s["n"] * s["xx"] - s["x"] ** 2)
            moved, slope = abs(new - slope), new
            icpt = (s["y"] - slope * s["x"]) / s["n"]
            if i and moved < 1e-8:
                break
            resid = F.col("y") - icpt - slope * F.col("x")
            scale = points.agg(F.median(F.abs(resid))).first()[0] / 0.6744897501960817
            if not scale:
                break
            w = F.least(F.lit(1.0), tune * scale / F.abs(resid))
        return slope, icpt
    finally:
        points.unpersist()


def filter_cells(expr: DataFrame, p_level: float | None = None) -> DataFrame:
    """cell, x, y, fit, se, outlier: cells off the robust line of genes on depth."""
    points = cell_totals(expr)
    n = points.count()
    slope, icpt = robust_line(points)
    p = p_level or min(1e-3, 1 / n)
    return prediction_band(points, slope, icpt, num.t_quantile(p / 2, n))


def batch_correct(expr: DataFrame, depth_scale: float = 1e3) -> DataFrame:
    """cell, gene, batch, value corrected by batch and scaled by depth; a few small joined tables."""
    depth = expr.groupBy("cell", "batch").agg(F.sum("value").alias("depth"))
    per_batch = depth.groupBy("batch").agg(F.sum("depth").alias("batch_depth"))
    whole = per_batch.agg(F.sum("batch_depth").alias("all_depth"), F.count("*").alias("n_batch"))
    gene_batch = expr.groupBy("gene", "batch").agg(F.sum("value").alias("tc"))
    gene = gene_batch.groupBy("gene").agg(F.sum("tc").alias("gene_total")).crossJoin(F.broadcast(whole)).select("gene", ((F.col("gene_total") + F.col("n_batch")) / (F.col("all_depth") + F.col("n_batch"))).alias("average"))
    factor = gene_batch.join(per_batch, "batch").join(gene, "gene").select("gene", "batch", F.exp(F.log(F.col("tc") + 1) - F.log(F.col("batch_depth") + 1) - F.log("average")).alias("factor"))
    out = expr.join(factor, ["gene", "batch"]).join(depth.select("cell", "depth"), "cell")
    return out.select("cell", "gene", "batch", (F.col("value") / F.col("factor") / (F.col("depth") / depth_scale)).alias("value"))


def mean_variance(expr: DataFrame) -> DataFrame:
    """gene, m = ln mean, v = ln population variance, n_obs; absent rows count as zeros."""
    n = expr.agg(F.count_distinct("cell").alias("_n"))
    sums = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("ss"), F.count_if(F.col("value") != 0).alias("n_obs"))
    mean = F.col("s") / F.col("_n")
    return sums.crossJoin(F.broadcast(n)).select("gene", F.log(mean).alias("m"), F.log(F.col("ss") / F.col("_n") - mean**2).alias("v"), "n_obs", F.col("_n").alias("n_cells"))


def find_overdispersed(expr: DataFrame, gam_k: int = 5, alpha: float = 0.05) -> DataFrame:
    """gene, m, v, n_obs, res, lp, lpa, qv, highly_variable. The table has a row per gene."""
    rows = mean_variance(expr).orderBy("gene").toPandas()
    rows["res"] = rows["v"] - gam(rows["m"].to_numpy(), rows["v"].to_numpy(), gam_k).fitted
    rows["lp"] = [num.f_log_sf(math.exp(r), n, n) for r, n in zip(rows["res"], rows["n_obs"], strict=True)]
    rows["lpa"] = num.bh(rows["lp"].to_numpy(), log=True)
    rows["qv"] = [num.chi2_from_log_sf(p, n - 1) / n for p, n in zip(rows["lp"], rows["n_cells"], strict=True)]
    rows["highly_variable"] = rows["lpa"] < math.log(alpha)
    return expr.sparkSession.createDataFrame(rows.drop(columns="n_cells"))


def knn(reps: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """src, dst, d, rank: the k nearest rows of each row, itself left out, exact; ties go by dst.

    Rows are packed in blocks of about ``block`` by hash, a matrix each. Every pair of blocks is one
    group, whose task multiplies the matrices and keeps the k best of each row before the
    results meet, so a task holds two blocks, not all rows.
    """
    rows = reps.select("cell", "x")
    n_blocks = max(1, -(-rows.count() // block))
    kind = reps.schema["cell"].dataType.simpleString()

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("cell").combine_chunks()
        x = np.asarray(group["x"].combine_chunks().flatten(), np.float64)
        cells = group["cell"].combine_chunks()
        return pa.table({"b": group["b"][:1], "cells": pa.ListArray.from_arrays(pa.array([0, len(cells)], pa.int32()), cells), "x": pa.array([x.tobytes()], pa.binary())})

    packed = saved(rows.withColumn("b", F.pmod(F.xxhash64("cell"), F.lit(n_blocks)).cast("int")).groupBy("b").applyInArrow(pack, f"b int, cells array<{kind}>, x binary"), "knn-blocks")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    left = packed.select(F.col("b").alias("i"), every.alias("j"), "cells", "x").groupBy("i", "j")
    right = packed.select(every.alias("i"), F.col("b").alias("j"), "cells", "x").groupBy("i", "j")

    def best(one: pa.Table, other: pa.Table) -> pa.Table:
        if not one.num_rows or not other.num_rows:  # a block that no row falls in
            return pa.table({"src": one["cells"].combine_chunks().flatten()[:0], "dst": one["cells"].combine_chunks().flatten()[:0], "d": pa.array([], pa.float64())})
        src, dst = (np.asarray(t["cells"].combine_chunks().flatten()) for t in (one, other))
        x, y = (np.frombuffer(t["x"][0].as_py(), np.float64).reshape(len(ids), -1) for t, ids in ((one, src), (other, dst)))
        gap = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
        gap[src[:, None] == dst[None, :]] = np.inf
        many = min(k, len(dst))
        cut = np.partition(gap, many - 1, axis=1)[:, many - 1 : many]
        # Candidates by the product, with room for its rounding; then exact distances decide.
        a, b = np.nonzero((gap <= cut + 1e-7 * (1 + np.abs(cut))) & np.isfinite(gap))
        d = np.sqrt(((x[a] - y[b]) ** 2).sum(axis=1))
        order = np.lexsort((dst[b], d, a))
        a, b, d = a[order], b[order], d[order]
        near = np.arange(len(a)) - np.searchsorted(a, a) < k
        return pa.table({"src": src[a[near]], "dst": dst[b[near]], "d": d[near]})

    found = left.cogroup(right).applyInArrow(best, f"src {kind}, dst {kind}, d double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))).where(F.col("rank") <= k)


def adaptive_kernel(neighbours: DataFrame, k: int) -> DataFrame:
    """src, dst, w: exp(-d / sigma of src), sigma the distance to neighbour floor(k / 3); plus its transpose."""
    sigma = neighbours.where(F.col("rank") == max(1, k // 3)).select("src", F.col("d").alias("sigma"))
    w = neighbours.join(sigma, "src").select("src", "dst", F.exp(-F.col("d") / F.col("sigma")).alias("w"))
    both = w.union(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def markov(kernel: DataFrame, alpha: float = 0.0) -> DataFrame:
    """src, dst, p: rows that add up to one, after dividing by degrees to the power alpha on both sides."""
    if alpha:
        degree = kernel.groupBy("src").agg((F.sum("w") ** -alpha).alias("f"))
        kernel = kernel.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("f").alias("g")), "dst").select("src", "dst", (F.col("w") * F.col("f") * F.col("g")).alias("w"))
    total = kernel.groupBy("src").agg(F.sum("w").alias("total"))
    return kernel.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p"))


def diffusion(reps: DataFrame, n_components: int = 5, k: int = 30, alpha: float = 0.0, rounds: int = 15, multiscale: bool = True) -> tuple[DataFrame, list[float]]:
    """(cell, x: components) and eigenvalues, by orthogonal iteration; each round is a join and a sum by row.

    Of a round only products of components with each other (n x n numbers) reach the driver.
    """
    t = saved(markov(adaptive_kernel(knn(reps, k), k), alpha), "markov")
    m = n_components + 1
    start = F.array(*[F.pmod(F.xxhash64("cell", F.lit(i)), F.lit(1 << 20)) / float(1 << 19) - 1 for i in range(m)])
    vectors, values = reps.select("cell", start.alias("x")), np.ones(m)
    add = lambda w: F.array(*[F.sum(F.col("p") * F.get("x", F.lit(i))) for i in range(w)])
    for _ in range(rounds):
        moved = saved(t.join(vectors.withColumnRenamed("cell", "dst"), "dst").groupBy(F.col("src").alias("cell")).agg(add(m).alias("x")), "eigen")
        pairs = [(i, j) for i in range(m) for j in range(i, m)]
        row = moved.agg(*[F.sum(F.get("x", F.lit(i)) * F.get("x", F.lit(j))) for i, j in pairs]).first()
        gram = np.zeros((m, m))
        for (i, j), v in zip(pairs, row, strict=True):
            gram[i, j] = gram[j, i] = v
        upper = np.linalg.cholesky(gram + 1e-14 * np.trace(gram) * np.eye(m)).T
        values, turn = np.abs(np.diag(upper)), np.linalg.inv(upper)
        vectors = moved.select("cell", F.array(*[sum((F.get("x", F.lit(i)) * float(turn[i, j]) for i in range(m)), F.lit(0.0)) for j in range(m)]).alias("x"))
    scale = [float(v / (1 - v)) if multiscale and v < 1 else 1.0 for v in values[1:]]
    return vectors.select("cell", F.array(*[F.get("x", F.lit(i + 1)) * s for i, s in enumerate(scale)]).alias("x")), values.tolist()


def dense_slice(expr: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """cell, gene, value for all pairs of the chosen cells and genes; absent rows are zeros."""
    grid = cells.select("cell").distinct().crossJoin(F.broadcast(genes.select("gene").distinct()))
    return grid.join(expr.select("cell", "gene", "value"), ["cell", "gene"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
