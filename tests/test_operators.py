import numpy as np
import pytest
from pyspark.sql import functions as F

from ramify.operators import assoc, cors, fit, fork, preprocess, project, relational
from ramify.plans.graph import PrincipalGraph, Segment
from ramify.sources import load_graph, long_expression, read_layer, save_graph, write_layer
from ramify.streaming import project_stream


@pytest.fixture(scope="module")
def fork_data(spark):
    """Cells along a Y, with vectors, and a feature that rises on one branch."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        t, b = rng.random() * 2, i % 2
        x = [t, 0.0] if t < 1 else [t, (t - 1) * (1 if b else -1)]
        rows.append((i, [v + 0.02 * rng.standard_normal() for v in x], t, b))
    cells = spark.createDataFrame([(i, x) for i, x, _, _ in rows], "cell long, x array<double>")
    expr = [(i, "up", 5 * max(0.0, t - 1) + 0.1) for i, _, t, b in rows if b] + [(i, "flat", 1.0 + 0.1 * rng.random()) for i, *_ in rows]
    return cells, spark.createDataFrame(expr, "cell long, gene string, value double"), rows


@pytest.fixture(scope="module")
def rooted(fork_data):
    cells, _, rows = fork_data
    g = fit.tree(cells, 12, sigma=0.05, lam=1.0, steps=20)
    ends = sorted(g.tips, key=lambda v: g.nodes[0, v])
    return g.rooted(ends[0])


def test_tree_follows_the_fork(rooted, fork_data):
    assert len(rooted.degree) == 12 and rooted.adjacency.sum() == 22
    assert rooted.time.max() == pytest.approx(2.2, abs=0.6)


def test_pseudotime_orders_cells(spark, rooted, fork_data):
    cells, _, rows = fork_data
    a = fit.soft_assign(cells, rooted.nodes, rooted.sigma)
    out, maps = project.pseudotime(a, rooted)
    got = {r["cell"]: r["t"] for r in out.collect()}
    assert np.corrcoef([got[i] for i, *_ in rows], [t for *_, t, _ in rows])[0, 1] > 0.95
    many, _ = project.pseudotime(a, rooted, n_map=3)
    assert many.count() == 300 and many.where("t_sd < 0").count() == 0


def test_stream_equals_batch(spark, rooted, fork_data, tmp_path):
    cells, _, _ = fork_data
    cells.write.parquet(f"{tmp_path}/in")
    stream = project_stream(spark.readStream.schema(cells.schema).parquet(f"{tmp_path}/in"), rooted)
    stream.writeStream.format("memory").queryName("projected").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination()
    assert spark.table("projected").select("cell", "edge").exceptAll(project_stream(cells, rooted).select("cell", "edge")).count() == 0


def test_association_finds_the_rising_feature(spark, fork_data):
    _, expr, rows = fork_data
    maps = spark.createDataFrame([(0, i, t, "1" if t < 1 else str(2 + b)) for i, _, t, b in rows], "map_id int, cell long, t double, seg string")
    out = {r["gene"]: r for r in assoc.test_association(expr, maps, fdr_cut=1e-4, a_cut=1).collect()}
    assert out["up"]["signi"] and not out["flat"]["signi"] and out["up"]["p_val"] < 1e-10


def test_fork_and_activation(spark, fork_data):
    _, expr, rows = fork_data
    paths = spark.createDataFrame([(i, t, f"b{b}") for i, _, t, b in rows] + [(i, t, f"b{1 - b}") for i, _, t, b in rows if t < 1], "cell long, t double, branch string")
    out = fork.test_fork(expr, paths)
    up = out.where("gene = 'up'").first()
    assert up["branch"] == "b1" and up["up_A"] > 1 and up["de_p"] < 0.05 and up["b1"] == 0
    chosen = fork.branch_specific(out, ["b0", "b1"], 0.1)
    assert [r["gene"] for r in chosen.collect()] == ["up"]
    when = fork.activation(expr, paths, chosen.select("gene", "branch"), 1.0, deriv_cut=0.06).first()
    assert 0.8 < when["activation"] < 1.6 and when["module"] in ("early", "late")


def test_zero_restoration_by_join_equals_broadcast(spark, fork_data, monkeypatch):
    _, expr, rows = fork_data
    cells = spark.createDataFrame([(i, t, "1") for i, _, t, _ in rows], "cell long, t double, seg string")
    run = lambda: sorted((r["gene"], round(r["v"], 9)) for r in assoc.per_feature(expr, cells, ["t"], lambda g, f: [(g, float(f["y"].mean()))], "gene string, v double").collect())
    a = run()
    monkeypatch.setattr(assoc, "BROADCAST_CELLS", 0)
    assert run() == a


def test_half_way_milestone_is_null(spark):
    g = PrincipalGraph(np.array([[0, 1], [1, 0]]), np.array([[0.0, 1.0]])).rooted(0)
    cells = spark.createDataFrame([(1, 0.0, "1"), (2, 0.5, "1"), (3, 1.0, "1")], "cell long, t double, seg string")
    assert [r["milestones"] for r in project.with_milestones(cells, g).orderBy("cell").collect()] == ["0", None, "1"]


def test_outside_cells_move_to_the_most_voted_segment(spark):
    maps = spark.createDataFrame([(0, 1, 0.2, "2"), (1, 1, 0.2, "2"), (2, 1, 0.2, "1")], "map_id int, cell long, t double, seg string")
    segments = (Segment("1", 0, 1, 1.0), Segment("2", 1, 2, 1.0))
    out = project.consolidate(maps, segments, 0, {0, 2}, {0: 0.0, 1: 1.0, 2: 2.0}).first()
    assert out["seg"] == "1" and out["t_sd"] == pytest.approx(0)


def test_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2.5, 5, 10)], "v double").select(relational.equal_width_bin(F.col("v"), F.lit(0.0), F.lit(10.0), 4).alias("b"))
    assert [r["b"] for r in df.collect()] == [1, 1, 1, 2, 4]


def test_count_windows_match_range(spark):
    df = spark.range(23).select(F.col("id").alias("cell"), F.col("id").cast("double").alias("t"))
    got = {}
    for r in relational.count_windows(df, ["t"], 5, 3).collect():
        got.setdefault(r["window"], []).append(r["cell"])
    assert {w: sorted(v) for w, v in got.items()} == {i: list(range(s, s + 5)) for i, s in enumerate(range(0, 23 - 5, 3))}


def test_elastic_shapes(spark, fork_data):
    cells, _, _ = fork_data
    curve, circle = (fit.elastic_graph(cells, 5, kind) for kind in ("curve", "circle"))
    assert curve.degree.max() == 2 and len(curve.tips) == 2
    assert (circle.degree == 2).all()


def test_knn_is_exact(spark, fork_data):
    cells, _, rows = fork_data
    x = {r["cell"]: np.array(r["x"]) for r in cells.collect()}
    got = {(r["src"], r["rank"]): r["dst"] for r in preprocess.knn(cells, 3, 4).collect()}
    for i in (0, 7, 250):
        d = sorted((np.linalg.norm(x[i] - x[j]), j) for j in x if j != i)
        assert [got[i, k] for k in (1, 2, 3)] == [j for _, j in d[:3]]


def test_outlier_cells(spark):
    rng = np.random.default_rng(3)
    expr = [(c, f"g{g}", float(1 + rng.poisson(3))) for c in range(80) for g in range(60) if rng.random() < 0.3 + c / 200]
    expr += [(99, "g0", 900.0)]
    out = preprocess.filter_cells(spark.createDataFrame(expr, "cell long, gene string, value double"), 1e-3)
    assert 99 in [r["cell"] for r in out.where("outlier").collect()]


def test_regroup_and_simplify(spark, rooted, fork_data):
    cells, _, _ = fork_data
    out, g = fit.simplify(fit.soft_assign(cells, rooted.nodes, rooted.sigma), rooted, 2)
    sizes = out.select(F.size("r").alias("k"), F.aggregate("r", F.lit(0.0), lambda a, v: a + v).alias("s")).distinct().collect()
    assert {r["k"] for r in sizes} == {len(g.degree)} and all(abs(r["s"] - 1) < 1e-9 for r in sizes)


def test_switch_point():
    assert cors.switch_point(np.array([0.9, 0.9, 0.0, 0.1, 0.0])) == 2
    assert cors.switch_point(np.array([0.9, 0.8])) == 2


def test_graph_and_layers_round_trip(spark, rooted, tmp_path):
    save_graph(spark, rooted, f"{tmp_path}/g")
    g = load_graph(spark, f"{tmp_path}/g")
    assert (g.adjacency == rooted.adjacency).all() and np.allclose(g.time, rooted.time) and g.segments == rooted.segments and g.milestones == rooted.milestones
    wide = spark.createDataFrame([(1, 0.0, 2.0), (2, 3.0, 0.0)], "cell long, a double, b double")
    write_layer(long_expression(wide, "cell", ["a", "b"]), f"{tmp_path}/e", "X")
    assert sorted(map(tuple, read_layer(spark, f"{tmp_path}/e", "X").collect())) == [(1, "b", 2.0), (2, "a", 3.0)]


def test_synchro_null_is_one(spark):
    """A branch whose genes follow one hidden signal: correlated as measured, not when genes are permuted on their own."""
    rng = np.random.default_rng(5)
    n, genes = 300, [f"g{i}" for i in range(4)]
    hidden = rng.standard_normal(n)
    dense = [(i, g, float(hidden[i] + 0.1 * rng.standard_normal())) for i in range(n) for g in genes]
    dense = spark.createDataFrame(dense, "cell long, gene string, value double")
    cells = spark.createDataFrame([(i, float(i), "b") for i in range(n)], "cell long, t double, branch string")
    out = cors.synchro_path(dense, cells, genes[:2], genes[2:], size=100, step=50).toPandas()
    mean = out.groupby("run").corAA.mean()
    assert mean["real"] > 0.9 and abs(mean["permuted"]) < 0.25


def test_permutation_stays_in_blocks_and_leaves_the_rest(spark):
    dense = spark.createDataFrame([(i, g, float(100 * k + i)) for i in range(25) for k, g in enumerate("ab")], "cell long, gene string, value double")
    cells = spark.createDataFrame([(i, float(i), "b") for i in range(25)], "cell long, t double, branch string")
    got = cors.permuted_within(dense, cells, 10, 1).toPandas().set_index(["gene", "cell"]).value
    for k, g in enumerate("ab"):
        v = got[g].sort_index().to_numpy() - 100 * k
        assert [sorted(v[a : a + 10]) for a in (0, 10)] == [list(range(0, 10)), list(range(10, 20))] and list(v[20:]) == list(range(20, 25))
    assert list(got["a"].sort_index()) != list(got["b"].sort_index() - 100)


def test_bh_with_ties_and_nulls(spark):
    from ramify.functions.numerics import bh

    rng = np.random.default_rng(6)
    p = np.concatenate([rng.random(200), np.full(100, 0.5), [1.0] * 50])
    rows = [(i, float(v)) for i, v in enumerate(p)] + [(1000, None)]
    got = {r["i"]: r["q"] for r in relational.bh_adjusted(spark.createDataFrame(rows, "i int, p double"), "p", "q").collect()}
    assert got.pop(1000) is None
    assert np.allclose([got[i] for i in range(len(p))], bh(p))


def test_numbers_within_keys(spark):
    df = spark.range(5000).selectExpr("id % 3 as k", "cast((id * 7919) % 5003 as double) as v")
    got = relational.numbered(df, ["v"], ["k"]).toPandas()
    for _, g in got.groupby("k"):
        g = g.sort_values("v")
        assert list(g["_i"]) == list(range(len(g))) and (g["_n"] == len(g)).all()


def test_weighted_correlations_equal_numpy(spark):
    rng = np.random.default_rng(7)
    x, w = rng.random((40, 3)), rng.random((2, 40))
    ranks = spark.createDataFrame([(i, f"g{j}", float(x[i, j])) for i in range(40) for j in range(3)], "cell long, gene string, rank double")
    weights = spark.createDataFrame([(i, k, float(w[k, i])) for i in range(40) for k in range(2)], "cell long, window int, w double")
    for r in cors.weighted_correlations(ranks, weights).collect():
        c = np.cov(x.T, aweights=w[r["window"]], bias=True)
        a, b = int(r["a"][1]), int(r["b"][1])
        assert r["r"] == pytest.approx(c[a, b] / np.sqrt(c[a, a] * c[b, b]))


def test_elastic_graph_measures_all_candidates(spark, fork_data, monkeypatch):
    cells, _, _ = fork_data
    seen, grown = [], fit._grown
    sums = fit._hard_sums
    monkeypatch.setattr(fit, "_grown", lambda *a: seen.append(len(out := grown(*a))) or out)
    measured = []
    monkeypatch.setattr(fit, "_hard_sums", lambda reps, fs, radius: measured.append(len(fs)) or sums(reps, fs, radius))
    g = fit.elastic_graph(cells, 5, "tree", at_once=3)
    assert len(g.degree) == 5 and sum(measured[3:]) == 2 * sum(seen)


def test_fits_by_sums_equal_fits_of_all_rows(spark):
    """Sums over sparse rows give what a fit of every cell's value gives, for both kinds of model."""
    from ramify.functions.splines import anova_p, gam, group_gam
    from ramify.operators.features import Features, collected, gam_sums

    rng = np.random.default_rng(9)
    n = 400
    t, g = rng.random(n), rng.integers(0, 2, n)
    y = np.where(rng.random(n) < 0.6, np.sin(5 * t) + 0.4 * g * t + 0.2 * rng.standard_normal(n), 0.0)
    cells = spark.createDataFrame([(i, float(t[i]), "ab"[g[i]]) for i in range(n)], "cell long, t double, seg string")
    expr = spark.createDataFrame([(i, "y", float(v)) for i, v in enumerate(y) if v], "cell long, gene string, value double")
    f = Features(expr, cells, "seg", 6)
    keys = f.keys
    stats = f.fits(lambda by: ([v for name, key in keys.items() for v in gam_sums(key, *by[name])[1]],), "beta array<double>")
    spans = {r["key"]: (r["low"], r["high"]) for r in f.ranges(collected(stats, list(keys), {k: v.size for k, v in keys.items()})).collect()}
    for name, code in (("a", 0), ("b", 1)):
        fitted = gam(t[g == code], y[g == code], 6).fitted
        assert spans[name] == pytest.approx((fitted.min(), fitted.max()), abs=1e-6)
    models = assoc.GroupModels(Features(expr, cells, "seg", 5, common=True).keys)
    common = Features(expr, cells, "seg", 5, common=True)
    p = common.fits(lambda by: (models.fit(by)[0].p_value(1), anova_p(models.fit(by)[0], models.fit(by, own=False)[0])), "main double, inter double").first()
    full = group_gam(t, y, g, 5)
    assert p["main"] == pytest.approx(full.p_value(1), rel=1e-3) and p["inter"] == pytest.approx(anova_p(full, group_gam(t, y, g, 5, by=False)), rel=1e-3)


def test_features_without_rows_on_the_cells(spark):
    cells = spark.createDataFrame([(i, float(i), "1") for i in range(20)], "cell long, t double, seg string")
    expr = spark.createDataFrame([(100, "elsewhere", 3.0), *((i, "here", float(i)) for i in range(20))], "cell long, gene string, value double")
    maps = cells.select(F.lit(0).alias("map_id"), "cell", "t", "seg")
    out = {r["gene"]: r for r in assoc.test_association(expr, maps).collect()}
    assert out["elsewhere"]["p_val"] == 1.0 and out["elsewhere"]["A"] == 0.0 and out["here"]["A"] > 18


def test_metrics_equal_plain_ones():
    from ramify.plans.graph import METRICS, pairwise

    rng = np.random.default_rng(3)
    f, g = rng.standard_normal((5, 4)), rng.standard_normal((5, 3))
    unit = lambda v: v / np.linalg.norm(v)
    plain = {
        "euclidean": lambda a, b: np.linalg.norm(a - b), "l2": lambda a, b: np.linalg.norm(a - b), "sqeuclidean": lambda a, b: ((a - b) ** 2).sum(),
        "chebyshev": lambda a, b: np.abs(a - b).max(), "cosine": lambda a, b: 1 - unit(a) @ unit(b), "correlation": lambda a, b: 1 - np.corrcoef(a, b)[0, 1],
    } | dict.fromkeys(("cityblock", "manhattan", "l1"), lambda a, b: np.abs(a - b).sum())
    for m in METRICS:
        assert np.allclose(pairwise(f, g, m), [[plain[m](a, b) for b in g.T] for a in f.T]), m
    with pytest.raises(ValueError, match="metric"):
        pairwise(f, g, "other")


def test_leaves_reach_out(spark):
    rng = np.random.default_rng(1)
    cells = spark.createDataFrame([(i, [float(v), 0.01 * float(rng.standard_normal())]) for i, v in enumerate(np.linspace(0, 10, 400))], "cell long, x array<double>")
    short, long = (fit.elastic_graph(cells, 5, "curve", mu=1.0, extend=e) for e in (False, True))
    assert len(long.degree) == 7 and len(long.tips) == 2 and np.ptp(long.nodes[0]) > np.ptp(short.nodes[0])
    assert long.nodes[0].min() > -0.2 and long.nodes[0].max() < 10.2


def test_fates_tree_in_one_call(spark):
    from ramify.operators.fates import fates_tree

    rng = np.random.default_rng(2)
    rows = [(i, float(p), float(1 - p), float(t)) for i in range(200) for t in [rng.random()] for p in [np.clip(0.5 + (t * 0.5 if i % 2 else -t * 0.5), 0, 1)]]
    fates = spark.createDataFrame(rows, "cell long, a double, b double, time double")
    cells, g = fates_tree(fates, "time", ["a", "b"], 10, sigma=0.05, lam=1.0, steps=20, auto_root=True, root_params={"tips_only": True, "least": True})
    got = cells.toPandas().sort_values("cell")
    assert g.nodes[1, g.root] < 0.4 and np.corrcoef(got.t, got.time)[0, 1] > 0.8
    again, h = fates_tree(fates, "time", ["a", "b"], 10, sigma=0.05, lam=1.0, steps=20, reassign=True, root_params={"tips_only": True, "least": True})
    assert again.where("t != time").count() == 0 and all(s.d == pytest.approx(abs(h.time[s.end] - h.time[s.start])) for s in h.segments)
    plain, _ = fates_tree(fates, "time", ["a", "b"], 10, sigma=0.05, lam=1.0, steps=5)
    assert "t" not in plain.columns
