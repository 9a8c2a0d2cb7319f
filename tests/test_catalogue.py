"""Every catalogue query with SQL gives the same rows in DuckDB, at the smallest scale."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ramify.operators.features import Features
from ramify.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(df):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 4) + 0.0 if isinstance(x, float) else x

    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(one(x) for x in r) for r in df.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_same_as_sql(spark, duck, name):
    assert plain(catalogue.QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(catalogue.ORACLES[name]).fetchdf())


@pytest.mark.parametrize("name", ["fit_explore_sigma", "project_multi_map", "view_trajectory_arrows", "module_inclusion", "synchro_inter_cor", "graph_cleanup", "fit_cellrank_tree"])
def test_runs(spark, name):
    large = name in ("module_inclusion", "synchro_inter_cor")  # their windows need more cells
    assert catalogue.QUERIES[name](spark, SF.replace("0.001", "0.01") if large else SF).count() > 0


def test_no_windows_no_rows(spark):
    assert catalogue.QUERIES["module_inclusion"](spark, SF).count() == 0
    assert catalogue.QUERIES["synchro_inter_cor"](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sets_are_in_the_input(spark):
    genes = {r[0] for r in catalogue._dense(spark, SF).select("gene").distinct().collect()}
    assert len(genes) == 25 and all(set(s) <= genes for s in catalogue.SETS)


def test_both_sets_correlate(spark):
    d = SF.replace("0.001", "0.01")
    rows = catalogue.QUERIES["synchro_path"](spark, d).toPandas()
    assert rows["corBB"].nunique() > 1 and rows["corAB"].nunique() > 1
    assert set(catalogue.QUERIES["slide_cors"](spark, d).toPandas()["geneset"]) == {"A", "B"}


def test_activation_lm_takes_cells_up_to_the_fork(spark, monkeypatch):
    seen, test = [], catalogue.fork.activation_lm
    monkeypatch.setattr(catalogue.fork, "activation_lm", lambda expr, before: seen.append(before.toPandas()) or test(expr, before))
    out = catalogue.QUERIES["activation_lm"](spark, SF).toPandas()
    paths = catalogue._paths(spark, SF)[0].toPandas()
    fork_t = paths.groupby("branch").t.max().min()
    assert len(out) == 25 and set(seen[0].cell) == set(paths.cell[paths.t < fork_t])


@pytest.mark.parametrize("name", ["fit_gam", "activation_gam", "view_trend_covariate", "assoc_monocle3"])
def test_all_features(spark, name):
    n = 64 if name == "assoc_monocle3" else 25
    assert catalogue.QUERIES[name](spark, SF).select("gene").distinct().count() == n


def test_trends_of_all_features(spark, monkeypatch):
    seen, smooth = [], catalogue.assoc.fit_features
    monkeypatch.setattr(catalogue.assoc, "fit_features", lambda expr, *a, **k: seen.append(expr.select("gene").distinct().count()) or smooth(expr, *a, **k))
    assert catalogue.QUERIES["view_trends"](spark, SF).count() > 0 and seen == [25]


def test_a_row_a_cell_is_never_broadcast(spark):
    def keys(df):
        return re.findall(r"BroadcastHashJoin \[(\w+)#", df._jdf.queryExecution().executedPlan().toString())

    cells, expr = catalogue._cells_and_expr(spark, SF)
    paths = cells.withColumn("branch", F.col("seg"))
    fits = Features(expr, paths, "branch", 6).fits(lambda by: (0.0,), "x double")
    fitted = expr.select("cell", "gene", F.col("value").alias("fitted"))
    assert not keys(catalogue.tables.counts(spark, SF))
    assert "cell" not in keys(fits) + keys(catalogue.views.mean_trajectory(fitted, cells, 10))
