"""Fits of all features on the same cells, by sums.

A feature's fit needs the design only through sums of products over the cells. Sums of the design
with itself are the same for all features; those with a feature drop its zeros, so they come from
its sparse rows alone and add up before the shuffle. What is then fitted is a few numbers a
feature, however many cells there are. Cells are never sent to tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.functions.splines import Smooth, SumFit, fit_sums, spaced, thin_plate_on
from ramify.operators.relational import numbered
from ramify.scratch import saved

#: Features whose curves a task evaluates at a time.
BLOCK = 512


@dataclass
class Key:
    """What all features share on one key's cells: rows, the smooth, and sums of products of (1, its columns)."""

    n: int
    smooth: Smooth | None
    xx: np.ndarray

    @property
    def size(self) -> int:
        return len(self.xx)

    def rows(self, t: np.ndarray) -> np.ndarray:
        one = np.ones((len(t), 1))
        return np.hstack([one, self.smooth.columns(t)]) if self.smooth else one


class Features:
    """``expr`` (cell, gene, value; absent rows are zeros) on ``cells`` (cell, t and the key's column).

    A cell may have rows on several keys. ``common``: one smooth over all cells instead of one per
    key. ``k`` 0 takes t itself as the only column.
    """

    def __init__(self, expr: DataFrame, cells: DataFrame, key: str, k: int, shrink: bool = False, common: bool = False):
        self.expr, self.spark = expr, expr.sparkSession
        self.cells = cells.select("cell", F.col("t").cast("double").alias("t"), F.col(key).cast("string").alias("key"))
        smooths = self._smooths(k, shrink, common)
        self.width = max([2 if s is None and not k else 1 if s is None else 1 + s.columns(np.zeros(1)).shape[1] for s in smooths.values()], default=1)
        line = Smooth(np.zeros(0), np.zeros((0, 0)), np.zeros((1, 1)), 0.0, 1.0)  # t itself
        smooths = {name: line if not k else s for name, s in smooths.items()}
        width = self.width

        def design(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                x = np.zeros((len(frame), width))
                x[:, 0] = 1
                for name, part in frame.reset_index(drop=True).groupby("key"):
                    if smooths[name]:
                        columns = smooths[name].columns(part["t"].to_numpy())
                        x[part.index, 1 : 1 + columns.shape[1]] = columns
                yield pd.DataFrame({"cell": frame["cell"], "key": frame["key"], "x": list(x)})

        kind = self.cells.schema["cell"].dataType.simpleString()
        self.designed = saved(self.cells.mapInPandas(design, f"cell {kind}, key string, x array<double>"), "design")

        def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[str, np.ndarray] = {}
            for frame in frames:
                for name, part in frame.groupby("key"):
                    x = np.stack(part["x"].to_numpy())
                    sums[name] = sums.get(name, 0.0) + x.T @ x
            for name, xx in sums.items():
                yield pd.DataFrame({"key": name, "i": np.arange(xx.size, dtype=np.int32), "v": xx.ravel()})

        found: dict[str, np.ndarray] = {name: np.zeros(width * width) for name in smooths}
        for r in self.designed.mapInPandas(products, "key string, i int, v double").groupBy("key", "i").agg(F.sum("v").alias("v")).collect():  # width squared numbers a key
            found[r["key"]][r["i"]] = r["v"]
        self.keys: dict[str, Key] = {}
        for name in sorted(smooths):
            size = 1 + smooths[name].columns(np.zeros(1)).shape[1] if smooths[name] else 1
            xx = found[name].reshape(width, width)[:size, :size]
            self.keys[name] = Key(round(xx[0, 0]), smooths[name], xx)

    def _smooths(self, k: int, shrink: bool, common: bool) -> dict[str, Smooth | None]:
        """Knots stand on each key's distinct t, or on as many evenly spaced ones as a spline takes."""
        names = [r[0] for r in self.cells.select("key").distinct().collect()]  # segments, branches or groups
        if not k:
            return dict.fromkeys(names)
        of = F.lit("") if common else F.col("key")
        rows = self.cells.select(of.alias("key"), "t")
        stats = {r["key"]: r for r in rows.groupBy("key").agg(F.avg("t").alias("m"), F.stddev_pop("t").alias("s")).collect()}
        places = numbered(rows.distinct(), ["t"], ["key"])
        many = {r["key"]: r["n"] for r in places.groupBy("key").agg(F.max("_n").alias("n")).collect()}
        want = self.spark.createDataFrame([(name, int(i)) for name, n in many.items() for i in spaced(n)], "key string, _i long")
        knots: dict[str, list[float]] = {}
        for r in places.join(F.broadcast(want), ["key", "_i"]).select("key", "t").orderBy("key", "t").collect():  # 200 a key at most
            knots.setdefault(r["key"], []).append(r["t"])
        made = {name: thin_plate_on(np.array(v), stats[name]["m"], stats[name]["s"] or 1.0, k, shrink) if len(v) > 2 else None for name, v in knots.items()}
        return {name: made["" if common else name] for name in names}

    def fits(self, kernel: Callable[[dict[str, tuple[np.ndarray, float]]], tuple], schema: str) -> DataFrame:
        """gene and what ``kernel`` makes of each key's sums of a feature: with the key's columns, and of its squares."""
        keys, width = self.keys, self.width
        y = self.expr.select("cell", "gene", "value").repartition("cell").groupBy("cell", "gene").agg(F.sum("value").alias("y"))
        designed = self.designed.hint("merge")  # never broadcast: its file may be small, but it has a row a cell
        sums = y.join(designed, "cell").groupBy("gene", "key").agg(F.sum(F.col("y") * F.col("y")).alias("yy"), *[F.sum(F.col("y") * F.get("x", F.lit(i))).alias(f"s{i}") for i in range(width)])
        one = F.struct("key", "yy", F.array(*[f"s{i}" for i in range(width)]).alias("xy"))
        rows = self.expr.select("gene").distinct().join(sums.groupBy("gene").agg(F.collect_list(one).alias("sums")), "gene", "left")
        names = ["gene", *[c.split()[0] for c in schema.split(", ")]]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for gene, sums in zip(frame["gene"], frame["sums"], strict=True):
                    seen = {s["key"]: s for s in (sums if sums is not None else ())}
                    zero = {"xy": np.zeros(width), "yy": 0.0}
                    by = {name: (np.asarray(seen.get(name, zero)["xy"], float)[: k.size], float(seen.get(name, zero)["yy"])) for name, k in keys.items()}
                    out.append((gene, *kernel(by)))
                yield pd.DataFrame(out, columns=names)

        return rows.mapInPandas(run, f"gene string, {schema}")

    def curves(self, coefficients: dict[str, dict[str, np.ndarray]], schema: str, of: Callable[[str, pd.DataFrame, list[str], list[np.ndarray]], pd.DataFrame]) -> DataFrame:
        """Evaluates features' curves on the cells, batch by batch: ``of`` gets a key, its rows, and the features' values there.

        ``coefficients``: by feature and key, one row for each curve. A few numbers a feature are sent.
        """
        genes = sorted(coefficients)
        tables = {name: np.stack([np.atleast_2d(coefficients[g][name]) for g in genes]) if genes else np.zeros((0, 1, k.size)) for name, k in self.keys.items()}
        sent = self.spark.sparkContext.broadcast(tables)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for name, part in frame.groupby("key"):
                    x, table = np.stack(part["x"].to_numpy()), sent.value[name]
                    for at in range(0, len(genes), BLOCK):
                        some = table[at : at + BLOCK]
                        values = [x[:, : some.shape[2]] @ some[:, c].T for c in range(some.shape[1])]
                        yield of(name, part, genes[at : at + BLOCK], values)

        return self.designed.mapInPandas(run, schema)

    def ranges(self, coefficients: dict[str, dict[str, np.ndarray]]) -> DataFrame:
        """gene, key, low, high: of each curve over its key's cells."""

        def of(name: str, part: pd.DataFrame, genes: list[str], values: list[np.ndarray]) -> pd.DataFrame:
            return pd.DataFrame({"gene": genes, "key": name, "low": values[0].min(axis=0), "high": values[0].max(axis=0)})

        return self.curves(coefficients, "gene string, key string, low double, high double", of).groupBy("gene", "key").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def gam_sums(key: Key, xy: np.ndarray, yy: float, gamma: float = 1.0) -> tuple[SumFit, np.ndarray]:
    """(fit, coefficients of the key's raw columns) of y ~ s(t)."""
    turn = np.eye(key.size)
    turn[0, 1:] = -key.xx[0, 1:] / key.n
    terms = [(1, key.size, key.smooth.penalty)] if key.smooth else []
    fit = fit_sums(turn.T @ key.xx @ turn, turn.T @ xy, yy, key.n, terms, gamma)
    return fit, turn @ fit.beta


def line_sums(key: Key, xy: np.ndarray, yy: float) -> tuple[float, float]:
    """(slope, two-sided p) of y on t from a key's sums of (1, t)."""
    from ramify.functions.numerics import t_two_sided

    n, st, stt = key.n, key.xx[0, 1], key.xx[1, 1]
    sxx = stt - st * st / n
    if n < 3 or sxx <= 1e-12 * max(1.0, stt):
        return float("nan"), float("nan")
    sxy, syy = xy[1] - st * xy[0] / n, max(0.0, yy - xy[0] ** 2 / n)
    slope = sxy / sxx
    se = np.sqrt(max(0.0, syy - slope * sxy) / (n - 2) / sxx)
    return float(slope), t_two_sided(slope / se, n - 2) if se > 0 else 0.0


def collected(stats: DataFrame, names: list[str], sizes: dict[str, int], column: str = "beta") -> dict[str, dict[str, np.ndarray]]:
    """Coefficients by feature and key from a table with a row a feature: ``column`` has all keys' side by side."""
    out = {}
    for r in stats.select("gene", column).collect():
        at, mine = 0, {}
        for name in names:
            mine[name] = np.array(r[column][at : at + sizes[name]])
            at += sizes[name]
        out[r["gene"]] = mine
    return out
