"""Queries over the generated tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ramify.operators import assoc, cors, fates, fit, fork, preprocess, project, relational, views
from ramify.plans import tables
from ramify.plans.graph import PrincipalGraph, minimum_spanning_tree, pairwise
from ramify.scratch import saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# --- the views as SQL ---

C = """c AS (SELECT c_custkey AS cell, p_brand AS gene, c_mktsegment AS batch, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""
E = """e AS (SELECT event_id AS cell, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 AS t, event_type AS seg, value,
  CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS cov, user_id FROM events)"""
M = E + """, m AS (SELECT CAST(cell % 5 AS INTEGER) AS map_id, user_id AS cell, t, seg, value FROM e)"""
V = """v AS (SELECT vec_id AS cell, label AS cluster, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
  nd AS (SELECT cluster AS node, dim, avg(x) AS x FROM v GROUP BY 1, 2)"""
R = V + """, dist AS (SELECT v.cell, nd.node, sqrt(sum((v.x - nd.x) * (v.x - nd.x))) AS d FROM v JOIN nd USING (dim) GROUP BY 1, 2),
  raw AS (SELECT cell, node, exp(-d / 0.05) AS k FROM dist), r AS (SELECT cell, node, k / sum(k) OVER (PARTITION BY cell) AS w FROM raw)"""
SIGMA = 0.05


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rnd(c, n: int = 6):
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + 0.0


def label_nodes(v: DataFrame) -> np.ndarray:
    """Mean vector of each label, d x K; labels are ten."""
    rows = v.select("cluster", F.posexplode("x").alias("dim", "v")).groupBy("cluster", "dim").agg(F.avg("v").alias("m")).collect()
    out = np.zeros((1 + max(r["dim"] for r in rows), 1 + max(r["cluster"] for r in rows)))
    for r in rows:
        out[r["dim"], r["cluster"]] = r["m"]
    return out


def fixed_graph(v: DataFrame) -> PrincipalGraph:
    nodes = label_nodes(v)
    return PrincipalGraph(minimum_spanning_tree(pairwise(nodes)), nodes, sigma=SIGMA)


def assigned(spark: SparkSession, sf: str) -> tuple[DataFrame, PrincipalGraph]:
    v = tables.vectors(spark, sf)
    g = fixed_graph(v)
    return fit.soft_assign(v, g.nodes, SIGMA), g


# --- preprocessing ---


@query(f"WITH {C} SELECT cell, round(ln(1 + sum(value)), 6) AS x, round(ln(1 + count(*) FILTER (value <> 0)), 6) AS y FROM c GROUP BY 1")
def pp_cell_totals(spark, sf):
    return preprocess.cell_totals(tables.counts(spark, sf)).select("cell", rnd("x").alias("x"), rnd("y").alias("y"))


@query(f"""WITH {C}, p AS (SELECT cell, ln(1 + sum(value)) AS x, ln(1.0 + count(*) FILTER (value <> 0)) AS y FROM c GROUP BY 1),
  l AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, avg(x) AS mx, var_pop(x) AS vx FROM p),
  s AS (SELECT l.*, (SELECT avg((p.y - l.a - l.b * p.x) ** 2) FROM p) AS mse FROM l)
  SELECT cell, round(a + b * x, 6) AS fit, round(sqrt(mse) * sqrt(1 + 1.0 / n + (x - mx) ** 2 / (n * vx)), 6) AS se FROM p, s""")
def pp_se_band(spark, sf):
    points = preprocess.cell_totals(tables.counts(spark, sf))
    line = points.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a")).first()
    return preprocess.prediction_band(points, line["b"], line["a"], 3.0).select("cell", rnd("fit").alias("fit"), rnd("se").alias("se"))


@query()
def pp_filter_cells_rlm(spark, sf):
    return preprocess.filter_cells(tables.counts(spark, sf))


BC = f"""WITH {C}, d AS (SELECT cell, batch, sum(value) AS depth FROM c GROUP BY 1, 2), b AS (SELECT batch, sum(depth) AS bd FROM d GROUP BY 1),
  w AS (SELECT sum(bd) AS ad, count(*) AS nb FROM b), gb AS (SELECT gene, batch, sum(value) AS tc FROM c GROUP BY 1, 2),
  g AS (SELECT gene, (sum(tc) + any_value(nb)) / (any_value(ad) + any_value(nb)) AS av FROM gb, w GROUP BY 1),
  f AS (SELECT gb.gene, gb.batch, exp(ln(tc + 1) - ln(bd + 1) - ln(av)) AS f FROM gb JOIN b USING (batch) JOIN g USING (gene))"""


@query(BC + " SELECT c.cell, c.gene, c.batch, round(c.value / f.f / (d.depth / 1000.0), 6) AS value FROM c JOIN f ON c.gene = f.gene AND c.batch = f.batch JOIN d ON c.cell = d.cell")
def pp_batch_correct(spark, sf):
    return preprocess.batch_correct(tables.counts(spark, sf)).withColumn("value", rnd("value"))


@query(f"WITH {C} SELECT cell, gene, round(value / (sum(value) OVER (PARTITION BY cell) / 1000.0), 6) AS value FROM c")
def pp_depth_scale(spark, sf):
    depth = F.sum("value").over(Window.partitionBy("cell"))
    return tables.counts(spark, sf).select("cell", "gene", rnd(F.col("value") / (depth / 1000)).alias("value"))


@query(f"""WITH {C}, n AS (SELECT count(DISTINCT cell) AS n FROM c) SELECT gene, round(ln(sum(value) / any_value(n)), 6) AS m,
  round(ln(sum(value * value) / any_value(n) - (sum(value) / any_value(n)) ** 2), 6) AS v, count(*) FILTER (value <> 0) AS n_obs FROM c, n GROUP BY 1""")
def pp_mean_var(spark, sf):
    return preprocess.mean_variance(tables.counts(spark, sf)).select("gene", rnd("m").alias("m"), rnd("v").alias("v"), "n_obs")


PVAL = "abs(value - floor(value)) / 2 + cell * 1e-9"


def _p(spark, sf) -> DataFrame:
    e = tables.timeline(spark, sf).select("cell", "value")
    return e.select("cell", (F.abs(F.col("value") - F.floor("value")) / 2 + F.col("cell") * 1e-9).alias("p"))


@query(f"""WITH {E}, p AS (SELECT cell, {PVAL} AS p FROM e), k AS (SELECT cell, p, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS q FROM p)
  SELECT cell, round(min(q) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING), 6) AS q FROM k""")
def pp_bh_adjust(spark, sf):
    return relational.bh_adjusted(_p(spark, sf), "p", "q").select("cell", rnd("q").alias("q"))


@query(f"""WITH {E}, p AS (SELECT cell, ln({PVAL} + 1e-6) AS p FROM e), k AS (SELECT cell, p, p + ln(count(*) OVER () * 1.0 / row_number() OVER (ORDER BY p)) AS q FROM p)
  SELECT cell, round(min(q) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING), 6) AS q FROM k""")
def pp_bh_adjust_log(spark, sf):
    logs = _p(spark, sf).select("cell", F.log(F.col("p") + 1e-6).alias("p"))
    return relational.bh_adjusted(logs, "p", "q", log=True).select("cell", rnd("q").alias("q"))


@query(f"WITH {E} SELECT cell, round(least(({PVAL}) * count(*) OVER (), 1.0), 6) AS q FROM e")
def pp_bonferroni(spark, sf):
    return relational.bonferroni(_p(spark, sf), "p", "q").select("cell", rnd("q").alias("q"))


KNN = f"""WITH {V}, pd AS (SELECT a.cell AS src, b.cell AS dst, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM v a JOIN v b ON a.dim = b.dim AND a.cell <> b.cell GROUP BY 1, 2),
  nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM pd) WHERE rank <= 9)"""
KERNEL = KNN + """, sg AS (SELECT src, d AS sigma FROM nn WHERE rank = 3), w1 AS (SELECT src, dst, exp(-d / sigma) AS w FROM nn JOIN sg USING (src)),
  kn AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM w1 UNION ALL SELECT dst, src, w FROM w1) GROUP BY 1, 2)"""


@query(KNN + " SELECT src, dst, round(d, 6) AS d, CAST(rank AS INTEGER) AS rank FROM nn")
def pp_knn(spark, sf):
    return preprocess.knn(tables.vectors(spark, sf), 9).select("src", "dst", rnd("d").alias("d"), "rank")


@query(KERNEL + " SELECT src, dst, round(w, 6) AS w FROM kn")
def pp_adaptive_kernel(spark, sf):
    return preprocess.adaptive_kernel(preprocess.knn(tables.vectors(spark, sf), 9), 9).withColumn("w", rnd("w"))


@query(KERNEL + ", f AS (SELECT src, 1 / sum(w) AS f FROM kn GROUP BY 1), a AS (SELECT kn.src, kn.dst, kn.w * f.f * g.f AS w FROM kn JOIN f ON kn.src = f.src JOIN f g ON kn.dst = g.src) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS p FROM a")
def pp_markov_norm(spark, sf):
    return preprocess.markov(preprocess.adaptive_kernel(preprocess.knn(tables.vectors(spark, sf), 9), 9), 1.0).withColumn("p", rnd("p"))


@query()
def pp_diffusion_eig(spark, sf):
    return preprocess.diffusion(tables.vectors(spark, sf), 3, 15, rounds=6)[0]


@query("SELECT vec_id AS cell, CAST(i AS INTEGER) AS dim, round(embedding[i + 1]::DOUBLE, 6) AS x FROM embeddings, range(5) t(i)")
def rep_slice(spark, sf):
    name, df = fit.resolve_rep({"X_emb": tables.vectors(spark, sf)}, "emb", 5, 100)
    return df.select("cell", F.posexplode("x").alias("dim", "x")).withColumn("x", rnd("x"))


@query(f"""WITH {C}, cl AS (SELECT DISTINCT cell FROM c WHERE batch = 'BUILDING'), gn AS (SELECT DISTINCT gene FROM c WHERE gene < 'Brand#3')
  SELECT cl.cell, gn.gene, coalesce(c.value, 0) AS value FROM cl CROSS JOIN gn LEFT JOIN c ON c.cell = cl.cell AND c.gene = gn.gene""")
def expr_slice_dense(spark, sf):
    c = tables.counts(spark, sf)
    return preprocess.dense_slice(c, c.where("batch = 'BUILDING'"), c.where("gene < 'Brand#3'"))


# --- fitting ---


@query("WITH " + R + " SELECT cell, CAST(node AS INTEGER) AS node, round(w, 6) AS w FROM r")
def fit_soft_assign(spark, sf):
    return assigned(spark, sf)[0].select("cell", F.posexplode("r").alias("node", "w")).withColumn("w", rnd("w"))


@query("WITH " + R + " SELECT CAST(node AS INTEGER) AS node, round(sum(w), 6) AS mass FROM r GROUP BY 1")
def fit_colsum(spark, sf):
    v = tables.vectors(spark, sf)
    mass, _ = fit._sums(v, label_nodes(v), SIGMA, None)
    return spark.createDataFrame([(i, round(float(m), 6)) for i, m in enumerate(mass)], "node int, mass double")


@query("WITH " + R + " SELECT CAST(node AS INTEGER) AS node, CAST(dim AS INTEGER) AS dim, round(sum(w * x), 6) + 0.0 AS s FROM r JOIN v USING (cell) GROUP BY 1, 2")
def fit_xtr(spark, sf):
    v = tables.vectors(spark, sf)
    _, s = fit._sums(v, label_nodes(v), SIGMA, None)
    return spark.createDataFrame([(k, d, round(float(s[d, k]), 6) + 0.0) for d in range(len(s)) for k in range(s.shape[1])], "node int, dim int, s double")


PN = V + ", pn AS (SELECT a.node AS a, b.node AS b, sqrt(sum((a.x - b.x) ** 2)) AS d FROM nd a JOIN nd b ON a.dim = b.dim AND a.node < b.node GROUP BY 1, 2)"


@query(f"WITH {PN} SELECT a, b, round(d, 6) AS d FROM pn")
def fit_pairwise_nodes(spark, sf):
    d = pairwise(label_nodes(tables.vectors(spark, sf)))
    return spark.createDataFrame([(a, b, round(float(d[a, b]), 6)) for a in range(len(d)) for b in range(a + 1, len(d))], "a int, b int, d double")


MST = """, s AS (SELECT a, b, d FROM pn UNION ALL SELECT b, a, d FROM pn),
  mm(a, b, m, k) AS (SELECT a, b, d, 1 FROM s UNION ALL
    SELECT a, b, min(m), k FROM (SELECT mm.a, s.b, greatest(mm.m, s.d) AS m, mm.k + 1 AS k FROM mm JOIN s ON mm.b = s.a WHERE mm.k < 9 AND s.b <> mm.a) GROUP BY a, b, k),
  best AS (SELECT a, b, min(m) AS m FROM mm GROUP BY 1, 2), mst AS (SELECT pn.a, pn.b, pn.d FROM pn JOIN best USING (a, b) WHERE pn.d <= best.m)"""
# The tree rooted at its first tip: times of nodes (walk), the nearest neighbour of each.
ROOTED = R + PN.removeprefix(V) + MST + """, ad AS (SELECT a AS u, b AS v, d FROM mst UNION ALL SELECT b, a, d FROM mst),
  tip AS (SELECT min(u) AS root FROM (SELECT u FROM ad GROUP BY u HAVING count(*) = 1)),
  walk(node, t, prev) AS (SELECT root, 0.0::DOUBLE, -1 FROM tip UNION ALL SELECT ad.v, walk.t + ad.d + 1e-6, walk.node FROM walk JOIN ad ON ad.u = walk.node AND ad.v <> walk.prev),
  near AS (SELECT u AS v0, arg_min(v, d) AS v1 FROM ad GROUP BY 1)"""
# Weights on the two nodes of each cell's nearest edge.
EDGES = ROOTED + """, pr AS (SELECT v.cell, mst.a, mst.b, sum((v.x - p.x) * (q.x - p.x)) AS along, sum((q.x - p.x) ** 2) AS len, sum((v.x - p.x) ** 2) AS far
    FROM v JOIN nd p ON p.dim = v.dim JOIN mst ON mst.a = p.node JOIN nd q ON q.node = mst.b AND q.dim = v.dim GROUP BY 1, 2, 3),
  gp AS (SELECT cell, a, b, far - 2 * u * along + u * u * len AS gap FROM (SELECT *, greatest(0, least(1, along / len)) AS u FROM pr)),
  ed AS (SELECT cell, a, b, row_number() OVER (PARTITION BY cell ORDER BY a, b) AS k FROM (SELECT *, min(gap) OVER (PARTITION BY cell) AS least FROM gp) WHERE gap <= least * (1 + 1e-9)),
  he AS (SELECT ed.cell, ed.a, ed.b, x.d AS da, y.d AS db FROM ed JOIN dist x ON x.cell = ed.cell AND x.node = a JOIN dist y ON y.cell = ed.cell AND y.node = b WHERE k = 1),
  hr AS (SELECT cell, a AS node, 1 - da / (da + db) AS w FROM he UNION ALL SELECT cell, b, 1 - db / (da + db) FROM he)"""
TIMED = """, b AS (SELECT cell, arg_max(node, w) AS v0 FROM {r} GROUP BY 1),
  pt AS (SELECT b.cell, near.v0 || '|' || near.v1 AS edge, (t0.t * x.w + t1.t * coalesce(y.w, 0)) / (x.w + coalesce(y.w, 0)) AS t FROM b JOIN near ON near.v0 = b.v0
    JOIN {r} x ON x.cell = b.cell AND x.node = near.v0 LEFT JOIN {r} y ON y.cell = b.cell AND y.node = near.v1 JOIN walk t0 ON t0.node = near.v0 JOIN walk t1 ON t1.node = near.v1)"""


@query(f"WITH RECURSIVE {PN}{MST} SELECT a, b, round(d, 6) AS d FROM mst")
def fit_mst(spark, sf):
    g = fixed_graph(tables.vectors(spark, sf))
    d = pairwise(g.nodes)
    return spark.createDataFrame([(a, b, round(float(d[a, b]), 6)) for a, b in g.edges], "a int, b int, d double")


def _graph_rows(spark, g: PrincipalGraph) -> DataFrame:
    return spark.createDataFrame([(a, b, float(w)) for a, b in g.edges for w in [pairwise(g.nodes)[a, b]]], "src int, dst int, d double")


@query()
def fit_ppt_tree(spark, sf):
    return _graph_rows(spark, fit.tree(tables.vectors(spark, sf), 20, sigma=0.3, lam=10, steps=8))


@query()
def fit_epg_tree(spark, sf):
    return _graph_rows(spark, fit.elastic_graph(tables.vectors(spark, sf), 6, "tree"))


@query()
def fit_curve(spark, sf):
    return _graph_rows(spark, fit.elastic_graph(tables.vectors(spark, sf), 6, "curve"))


@query()
def fit_circle(spark, sf):
    return _graph_rows(spark, fit.elastic_graph(tables.vectors(spark, sf), 6, "circle"))


@query()
def fit_explore_sigma(spark, sf):
    best, found = fit.explore_sigma(tables.vectors(spark, sf), 10, [10.0, 1.0, 0.1])
    return spark.createDataFrame([(s, float(v), s == best) for s, v in found], "sigma double, score double, chosen boolean")


@query()
def fit_convert_to_soft(spark, sf):
    v = tables.vectors(spark, sf)
    return _graph_rows(spark, fit.convert_to_soft(v, fixed_graph(v), 0.1, 1.0, 2))


@query()
def fit_cellrank_tree(spark, sf):
    e = tables.timeline(spark, sf).groupBy("user_id").agg(F.avg((F.col("seg") == "click").cast("double")).alias("p1"), F.avg("t").alias("time"))
    rows = fit.fate_vectors(e.select(F.col("user_id").alias("cell"), "p1", (1 - F.col("p1")).alias("p2"), (F.col("time") / 1e5).alias("time")), "time", ["p1", "p2"])
    return _graph_rows(spark, fit.tree(rows, 8, sigma=1.0, lam=100, steps=5))


def _fates(spark, sf) -> DataFrame:
    """cell, p1, p2, time: users, shares of their clicks and of other events, and their mean time."""
    e = tables.timeline(spark, sf).groupBy("user_id").agg(F.avg((F.col("seg") == "click").cast("double")).alias("p1"), F.avg("t").alias("time"))
    return e.select(F.col("user_id").alias("cell"), "p1", (1 - F.col("p1")).alias("p2"), (F.col("time") / 1e5).alias("time"))


@query()
def fit_fates_rooted(spark, sf):
    """The tree of fates in one call: rooted at the tip with the least time, whose times replace pseudotimes."""
    cells, _ = fates.fates_tree(_fates(spark, sf), "time", ["p1", "p2"], 8, sigma=1.0, steps=5, reassign=True, root_params={"tips_only": True, "least": True})
    return cells.select("cell", rnd("t").alias("t"), "seg")


@query()
def fit_tree_metric(spark, sf):
    return _graph_rows(spark, fit.tree(tables.vectors(spark, sf), 10, sigma=SIGMA, steps=5, metric="cosine"))


@query()
def fit_extend_leaves(spark, sf):
    return _graph_rows(spark, fit.elastic_graph(tables.vectors(spark, sf), 6, "curve", extend=True))


@query(f"WITH RECURSIVE {EDGES} SELECT cell, CAST(node AS INTEGER) AS node, round(w, 6) AS w FROM hr WHERE w > 0")
def fit_edge_assign(spark, sf):
    v = tables.vectors(spark, sf)
    return fit.edge_assign(v, fixed_graph(v)).select("cell", F.posexplode("r").alias("node", "w")).where("w > 0").withColumn("w", rnd("w"))


@query(f"WITH RECURSIVE {EDGES}{TIMED.format(r='hr')} SELECT cell, round(t, 6) + 0.0 AS t, edge FROM pt")
def project_edges_time(spark, sf):
    """Projection onto a hard graph: weights on the two nodes of the nearest edge, then as for soft ones."""
    v = tables.vectors(spark, sf)
    g = fixed_graph(v)
    g = g.rooted(g.tips[0])
    return project.map_cells(fit.edge_assign(v, g), g).select("cell", rnd("t").alias("t"), "edge")


@query("WITH " + R + ", nv AS (SELECT node, sum(w * CAST(cell AS DOUBLE)) / sum(w) AS t FROM r GROUP BY 1) SELECT CAST(node AS INTEGER) AS node, round(t, 4) AS t FROM nv")
def project_reassigned_time(spark, sf):
    a, g = assigned(spark, sf)
    _, g = project.reassign_time(a.withColumn("time", F.col("cell").cast("double")), g.rooted(g.tips[0]), "time")
    return spark.createDataFrame([(i, round(float(t), 4)) for i, t in enumerate(g.time)], "node int, t double")


# --- graph and rooting ---

H = """ed AS (SELECT -1 AS a, r_regionkey AS b, 1.0::DOUBLE AS w FROM region UNION ALL SELECT n_regionkey, 100 + n_nationkey, 2.0 FROM nation),
  sy AS (SELECT a, b, w FROM ed UNION ALL SELECT b, a, w FROM ed), dg AS (SELECT a AS node, count(*) AS degree FROM sy GROUP BY 1)"""


@query(f"WITH {H} SELECT node, degree, degree = 1 AS tip, degree > 2 AS fork FROM dg")
def graph_degree_tips_forks(spark, sf):
    g, names = tables.hierarchy_graph(spark, sf)
    return spark.createDataFrame([(names[i], int(d), bool(d == 1), bool(d > 2)) for i, d in enumerate(g.degree)], "node int, degree long, tip boolean, fork boolean")


@query(f"WITH RECURSIVE {H}, p(node, d) AS (SELECT -1, 0.0::DOUBLE UNION ALL SELECT sy.b, p.d + sy.w FROM p JOIN sy ON p.node = sy.a AND sy.b > sy.a) SELECT node, round(d, 4) AS d FROM p")
def graph_root_dist(spark, sf):
    g, names = tables.hierarchy_graph(spark, sf)
    return spark.createDataFrame([(names[i], round(float(t), 4)) for i, t in enumerate(g.rooted(0).time)], "node int, d double")


@query(f"WITH {H} SELECT CAST(row_number() OVER (ORDER BY a, b) AS VARCHAR) AS n, a AS \"start\", b AS \"end\", w AS d FROM ed")
def graph_segments(spark, sf):
    g, names = tables.hierarchy_graph(spark, sf)
    rows = sorted((names[s.start], names[s.end], round(s.d, 4)) for s in g.rooted(0).segments)
    return spark.createDataFrame([(str(i + 1), *r) for i, r in enumerate(rows)], "n string, start int, end int, d double")


@query("SELECT 100 + n_nationkey AS tip, unnest([-1, n_regionkey, 100 + n_nationkey]) AS node FROM nation")
def graph_path_nodes(spark, sf):
    g, names = tables.hierarchy_graph(spark, sf)
    return spark.createDataFrame([(names[t], names[v]) for t in g.tips for v in g.path(0, t)], "tip int, node int")


@query("WITH " + R + ", nv AS (SELECT node, sum(w * CAST(cell AS DOUBLE)) / sum(w) AS value FROM r GROUP BY 1) SELECT CAST(node AS INTEGER) AS node, round(value, 4) AS value, row_number() OVER (ORDER BY value DESC, node) = 1 AS root FROM nv")
def root_auto_nodes(spark, sf):
    a, g = assigned(spark, sf)
    a = a.withColumn("v", F.col("cell").cast("double"))
    root = project.root_by_value(a, g, "v")
    return project.node_means(a, "v").select("node", rnd("value", 4).alias("value"), (F.col("node") == root).alias("root"))


@query()
def root_auto_tips_min(spark, sf):
    a, g = assigned(spark, sf)
    root = project.root_by_value(a.withColumn("v", F.col("cell").cast("double")), g, "v", tips_only=True, least=True)
    return spark.createDataFrame([(root, root in g.tips)], "root int, tip boolean")


@query()
def root_two_roots(spark, sf):
    g, names = tables.hierarchy_graph(spark, sf)
    t = g.tips
    r = g.rooted_twice(t[0], t[-1], 0)
    return spark.createDataFrame([(names[i], float(x)) for i, x in enumerate(r.time)], "node int, time double")


# --- projection ---


def _projected(spark, sf) -> tuple[DataFrame, PrincipalGraph]:
    a, g = assigned(spark, sf)
    g = g.rooted(g.tips[0])
    return project.with_milestones(project.map_cells(a, g), g), g


@query("WITH " + R + ", b AS (SELECT cell, arg_max(node, w) AS v0 FROM r GROUP BY 1) SELECT cell, CAST(v0 AS INTEGER) AS v0 FROM b")
def project_argmax_node(spark, sf):
    p, _ = _projected(spark, sf)
    return p.select("cell", F.split("edge", r"\|")[0].cast("int").alias("v0"))


@query(f"WITH RECURSIVE {ROOTED}{TIMED.format(r='r')} SELECT cell, edge FROM pt")
def project_argmax_edge(spark, sf):
    return _projected(spark, sf)[0].select("cell", "edge")


@query(f"WITH RECURSIVE {ROOTED}{TIMED.format(r='r')} SELECT cell, round(t, 6) + 0.0 AS t FROM pt")
def project_time(spark, sf):
    return _projected(spark, sf)[0].select("cell", rnd("t").alias("t"))


@query()
def project_segments(spark, sf):
    return _projected(spark, sf)[0].select("cell", "seg", "milestones")


@query()
def project_multi_map(spark, sf):
    a, g = assigned(spark, sf)
    return project.pseudotime(a, g.rooted(g.tips[0]), n_map=3)[0].drop("x", "r")


@query()
def project_binned_trend(spark, sf):
    """The flagship: vectors, graph, pseudotime, and the mean of a value by segment and bin of time."""
    p, _ = _projected(spark, sf)
    value = p.select("cell", "seg", "t"), p.select("cell", F.lit("x0").alias("gene"), F.get("x", F.lit(0)).alias("value"))
    return views.binned_matrix(*value, n=5, norm="none")




def _line_graph(spark, sf) -> tuple[DataFrame, PrincipalGraph, list[str]]:
    """Event types as the segments of a star: the first leads to the centre, the others away from it."""
    e = tables.timeline(spark, sf)
    segs = [r[0] for r in e.select("seg").distinct().orderBy("seg").collect()]
    k = len(segs) + 1
    adjacency = np.zeros((k, k), int)
    adjacency[0, 1:] = adjacency[1:, 0] = 1
    nodes = np.zeros((k, k))
    nodes[np.arange(1, k), np.arange(1, k)] = 1
    g = PrincipalGraph(adjacency, nodes).rooted(1)
    # Segment n lies between the centre and tip n, since tips are numbered in order.
    of = spark.createDataFrame([(s, next(x.n for x in g.segments if i + 1 in (x.start, x.end)), f"{i + 1}|0") for i, s in enumerate(segs)], "name string, seg string, edge string")
    cells = e.withColumnRenamed("seg", "name").join(F.broadcast(of), "name")
    return cells, g, segs


EN = E + ", sn AS (SELECT seg, row_number() OVER (ORDER BY seg) AS k FROM (SELECT DISTINCT seg FROM e)), en AS (SELECT e.*, sn.k FROM e JOIN sn USING (seg))"


@query(f"WITH {EN} SELECT cell, '1_' || CAST(tip AS VARCHAR) AS branch FROM en, (VALUES (2), (3)) x(tip) WHERE k = 1 OR k = tip")
def getpath_cells(spark, sf):
    cells, g, _ = _line_graph(spark, sf)
    return project.path_cells(cells, g, "1", ["2", "3"]).select("cell", "branch")


@query(f"WITH {EN} SELECT cell, '1_' || CAST(tip AS VARCHAR) AS branch FROM en, (VALUES (2), (3)) x(tip) WHERE k = 1 OR k = tip")
def getpath_include_root(spark, sf):
    cells, g, _ = _line_graph(spark, sf)
    return project.path_cells(cells, g, "1", ["2", "3"], include_root=True).select("cell", "branch")


@query(f"WITH {EN} SELECT cell, t FROM en WHERE k IN (1, 2)")
def subset_extract(spark, sf):
    cells, g, _ = _line_graph(spark, sf)
    return project.subset(cells, g, "1", ["2"]).select("cell", "t")


@query(f"WITH {EN} SELECT cell, t FROM en WHERE k NOT IN (1, 2)")
def subset_subtract(spark, sf):
    cells, g, _ = _line_graph(spark, sf)
    return project.subset(cells, g, "1", ["2"], "substract").select("cell", "t")


@query(f"WITH {E} SELECT cell, t FROM e WHERE t > 1000 AND t < 100000")
def subset_time(spark, sf):
    cells, g, _ = _line_graph(spark, sf)
    return project.subset(cells, g, "1", ["2"], "pseudotime", 1000, 100000).select("cell", "t")


@query(f"WITH {M}, n AS (SELECT cell, seg, count(*) AS votes FROM m GROUP BY 1, 2) SELECT cell, seg, votes FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY votes DESC, seg) AS i FROM n) WHERE i = 1")
def map_vote(spark, sf):
    m = tables.mappings(spark, sf)
    ids = m.select("seg").distinct().withColumn("k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("seg")))  # five rows
    won = relational.vote(m.join(F.broadcast(ids), "seg"), "cell", "k")
    return won.join(F.broadcast(ids), "k").select("cell", "seg", "votes")


@query(f"WITH {M} SELECT cell, round(avg(t), 4) AS t, round(stddev_pop(t), 4) AS t_sd FROM m GROUP BY 1")
def map_mean_sd(spark, sf):
    return tables.mappings(spark, sf).groupBy("cell").agg(rnd(F.avg("t"), 4).alias("t"), rnd(F.stddev_pop("t"), 4).alias("t_sd"))


@query(f"""WITH {M}, iv AS (SELECT seg, min(t) + (max(t) - min(t)) * 0.25 AS lo, max(t) - (max(t) - min(t)) * 0.25 AS hi FROM e GROUP BY 1),
  n AS (SELECT cell, seg, count(*) AS votes FROM m GROUP BY 1, 2), mt AS (SELECT cell, avg(t) AS t FROM m GROUP BY 1)
  SELECT cell, seg, votes FROM (SELECT n.*, row_number() OVER (PARTITION BY n.cell ORDER BY votes DESC, n.seg) AS i FROM n JOIN mt USING (cell) JOIN iv ON iv.seg = n.seg AND mt.t > iv.lo AND mt.t < iv.hi) WHERE i = 1""")
def map_reassign_interval(spark, sf):
    m = tables.mappings(spark, sf)
    quarter = (F.max("t") - F.min("t")) * 0.25
    ranges = tables.timeline(spark, sf).groupBy(F.col("seg").alias("other")).agg((F.min("t") + quarter).alias("lo"), (F.max("t") - quarter).alias("hi"))
    inside = relational.between_open(m.groupBy("cell").agg(F.avg("t").alias("t")), "t", ranges, "lo", "hi")
    votes = m.groupBy("cell", F.col("seg").alias("other")).agg(F.count("*").alias("votes"))
    w = Window.partitionBy("cell").orderBy(F.desc("votes"), "other")
    return votes.join(inside.select("cell", "other"), ["cell", "other"]).withColumn("i", F.row_number().over(w)).where("i = 1").select("cell", F.col("other").alias("seg"), "votes")


@query(f"""WITH {EN}, s AS (SELECT *, min(t) OVER (PARTITION BY k) AS lo, max(t) OVER (PARTITION BY k) AS hi FROM en)
  SELECT cell, CASE WHEN t - lo < (hi - lo) / 2 THEN CASE WHEN k = 1 THEN '1' ELSE '0' END WHEN t - lo > (hi - lo) / 2 THEN CASE WHEN k = 1 THEN '0' ELSE CAST(k AS VARCHAR) END END AS milestones FROM s""")
def milestones_half(spark, sf):
    cells, g, _ = _line_graph(spark, sf)
    return project.with_milestones(cells, g).select("cell", "milestones")


@query(f"""WITH {EN}, s AS (SELECT *, min(t) OVER (PARTITION BY k) AS lo, max(t) OVER (PARTITION BY k) AS hi FROM en), q AS (
  SELECT cell, CASE WHEN t - lo < (hi - lo) / 2 THEN CASE WHEN k = 1 THEN '1' ELSE '0' END WHEN t - lo > (hi - lo) / 2 THEN CASE WHEN k = 1 THEN '0' ELSE CAST(k AS VARCHAR) END END AS milestones FROM s)
  SELECT cell, CASE milestones WHEN '0' THEN 'fork' WHEN '1' THEN 'root' ELSE milestones END AS milestones FROM q""")
def rename_milestones(spark, sf):
    cells, g, _ = _line_graph(spark, sf)
    return project.rename_milestones(project.with_milestones(cells, g), g, {"0": "fork", "1": "root"})[0].select("cell", "milestones")


@query(f"""WITH {E}, z AS (SELECT cell, t, CASE WHEN seg = 'click' THEN '0' ELSE '1' END AS seg FROM e WHERE seg IN (SELECT seg FROM e GROUP BY 1 ORDER BY 1 LIMIT 2)),
  u AS (SELECT *, CASE WHEN seg = '0' THEN max(CASE WHEN seg = '0' THEN t END) OVER () - t END AS u FROM z),
  s AS (SELECT *, coalesce(u + max(CASE WHEN seg <> '0' THEN t END) OVER (), t) AS nt FROM u)
  SELECT cell, round(nt, 1) AS t, CASE WHEN nt <= max(nt) OVER () / 2 THEN '0' ELSE '3' END AS milestones FROM s""")
def unroll_circle(spark, sf):
    e = tables.timeline(spark, sf)
    two = e.select("seg").distinct().orderBy("seg").limit(2)
    cells = e.join(F.broadcast(two), "seg", "left_semi").select("cell", "t", F.when(F.col("seg") == "click", "0").otherwise("1").alias("seg"))
    k = 6
    angle = np.arange(k) * 2 * np.pi / k
    adjacency = np.array([[1 if (i - j) % k in (1, k - 1) else 0 for j in range(k)] for i in range(k)])
    g = PrincipalGraph(adjacency, np.vstack([np.cos(angle), np.sin(angle)])).rooted(0)
    return project.unroll_circle(cells, g)[0].select("cell", rnd("t", 1).alias("t"), "milestones")


# --- associations ---


@query(f"WITH {E} SELECT seg, round(sum((value - m) ** 2), 4) AS deviance, count(*) - 1 AS df FROM (SELECT *, avg(value) OVER (PARTITION BY seg) AS m FROM e) GROUP BY 1")
def assoc_null_deviance(spark, sf):
    return tables.timeline(spark, sf).groupBy("seg").agg(rnd(F.var_pop("value") * F.count("*"), 4).alias("deviance"), (F.count("*") - 1).alias("df"))


@query(f"""WITH {E}, g AS (SELECT seg, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM e GROUP BY 1), w AS (SELECT count(*) AS n, var_pop(value) * count(*) AS d0 FROM e)
  SELECT round((d0 - ss) / (k - 1) / (ss / (w.n - k)), 6) AS f FROM w, (SELECT sum(ss) AS ss, count(*) AS k FROM g)""")
def assoc_f_stat_null(spark, sf):
    e = tables.timeline(spark, sf)
    parts = e.groupBy("seg").agg((F.var_pop("value") * F.count("*")).alias("s")).agg(F.sum("s").alias("ss"), F.count("*").alias("k"))
    whole = e.agg((F.var_pop("value") * F.count("*")).alias("d0"), F.count("*").alias("n"))
    return whole.crossJoin(parts).select(rnd((F.col("d0") - F.col("ss")) / (F.col("k") - 1) / (F.col("ss") / (F.col("n") - F.col("k")))).alias("f"))


def _cells_and_expr(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Customers with their depth as time, two segments by parity, and their counts, which are made once."""
    c = saved(tables.counts(spark, sf), "counts")
    cells = c.groupBy("cell").agg(F.log1p(F.sum("value")).alias("t"), F.first("batch").alias("batch")).withColumn("seg", (F.col("cell") % 2 + 1).cast("string"))
    return cells, c


@query()
def assoc_gam(spark, sf):
    cells, expr = _cells_and_expr(spark, sf)
    return assoc.test_association(expr, cells.select(F.lit(0).alias("map_id"), "cell", "t", "seg"))


@query()
def assoc_covariate(spark, sf):
    cells, expr = _cells_and_expr(spark, sf)
    two = cells.where(F.col("batch").isin("BUILDING", "MACHINERY"))
    return assoc.test_association_covariate(expr, two, "batch")


@query()
def fit_gam(spark, sf):
    cells, expr = _cells_and_expr(spark, sf)
    return assoc.fit_features(expr, cells.withColumn("branch", F.col("seg")), knots=6)


@query()
def overdispersed_gam(spark, sf):
    return preprocess.find_overdispersed(tables.counts(spark, sf))


def _paths(spark, sf) -> tuple[DataFrame, DataFrame]:
    cells, expr = _cells_and_expr(spark, sf)
    return cells.select("cell", "t", F.concat(F.lit("b"), "seg").alias("branch")), expr


@query()
def fork_gam(spark, sf):
    paths, expr = _paths(spark, sf)
    return fork.test_fork(expr, paths)


@query()
def cov_gam(spark, sf):
    cells, expr = _cells_and_expr(spark, sf)
    return assoc.test_covariate(expr, cells.where(F.col("batch").isin("BUILDING", "MACHINERY")), "batch")


@query()
def cov_gam_nested(spark, sf):
    cells, expr = _cells_and_expr(spark, sf)
    return assoc.test_covariate(expr, cells.where(F.col("batch").isin("BUILDING", "MACHINERY")), "batch", nested=True)


@query()
def view_trend_covariate(spark, sf):
    cells, expr = _cells_and_expr(spark, sf)
    two = cells.where(F.col("batch").isin("BUILDING", "MACHINERY"))
    return assoc.trend_covariate(expr.join(two, "cell", "left_semi"), two, "batch")


@query()
def activation_gam(spark, sf):
    paths, expr = _paths(spark, sf)
    features = expr.select("gene").distinct().withColumn("branch", F.lit("b1"))
    return fork.activation(expr, paths, features, 5.0)


def _stats(spark, sf) -> DataFrame:
    """Per mapping and event type: stand-ins for a feature's p value, amplitude and fdr."""
    m = tables.mappings(spark, sf)
    s = m.groupBy("map_id", F.concat_ws("-", "seg", (F.col("cell") % 10).cast("string")).alias("gene")).agg((F.max("value") - F.min("value")).alias("A"), (F.avg("value") / 1000).alias("p_val"))
    return s.withColumn("fdr", F.col("p_val") / 10)


ST = M + """, st AS (SELECT map_id, seg || '-' || CAST(cell % 10 AS VARCHAR) AS gene, max(value) - min(value) AS A, avg(value) / 1000 AS p_val, avg(value) / 10000 AS fdr FROM m GROUP BY 1, 2)"""


@query(f"""WITH {ST}, f AS (SELECT gene, median(p_val) AS p_val, median(A) AS A, median(fdr) AS fdr, avg(CASE WHEN fdr < 0.005 AND A > 100 THEN 1.0 ELSE 0.0 END) AS st FROM st GROUP BY 1)
  SELECT gene, round(p_val, 6) AS p_val, round(A, 4) AS A, round(fdr, 6) AS fdr, round(st, 6) AS st, st > 0.5 AS signi FROM f""")
def assoc_apply_filters(spark, sf):
    out = assoc.apply_filters(_stats(spark, sf), 0.005, 100, 0.5)
    return out.select("gene", rnd("p_val").alias("p_val"), rnd("A", 4).alias("A"), rnd("fdr").alias("fdr"), rnd("st").alias("st"), "signi")


@query(f"WITH {ST} SELECT gene, bool_or(fdr < 0.004) AS signi FROM st GROUP BY 1")
def cov_any_signi(spark, sf):
    return _stats(spark, sf).groupBy("gene").agg(F.bool_or(F.col("fdr") < 0.004).alias("signi"))


LP = f"""WITH {C}, t AS (SELECT cell, ln(1 + sum(value)) AS t FROM c GROUP BY 1), cu AS (SELECT quantile_cont(t, 0.2) AS a, quantile_cont(t, 0.8) AS b FROM t),
  lb AS (SELECT cell, CASE WHEN t < a THEN 'progenitors' WHEN t > b THEN 'progenies' ELSE 'bridge' END AS part FROM t, cu)"""


@query(LP + " SELECT cell, part FROM lb")
def lindev_labels(spark, sf):
    cells, _ = _cells_and_expr(spark, sf)
    return assoc.linearity_labels(cells).select("cell", "part")


@query(LP + """, n AS (SELECT count(*) FILTER (part = 'progenitors') AS na, count(*) FILTER (part = 'progenies') AS nb, count(*) FILTER (part = 'bridge') AS nx, count(*) AS n FROM lb),
  gl AS (SELECT DISTINCT gene FROM c), x AS (SELECT lb.cell, lb.part, gl.gene, coalesce(c.value, 0)::DOUBLE AS value FROM lb CROSS JOIN gl LEFT JOIN c ON c.cell = lb.cell AND c.gene = gl.gene),
  ge AS (SELECT gene, avg(value) FILTER (part = 'progenitors') AS a, avg(value) FILTER (part = 'progenies') AS b, stddev_pop(value) AS sd FROM x GROUP BY 1),
  wh AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, count(*) AS g FROM ge),
  ce AS (SELECT x.cell, sum(a * value) AS ax, sum(b * value) AS bx FROM x JOIN ge USING (gene) WHERE part = 'bridge' GROUP BY 1),
  uv AS (SELECT cell, (bb * ax - ab * bx) / (aa * bb - ab * ab) AS u, (aa * bx - ab * ax) / (aa * bb - ab * ab) AS v FROM ce, wh),
  rs AS (SELECT x.cell, x.gene, value - u * a - v * b AS res FROM x JOIN ge USING (gene) JOIN uv ON uv.cell = x.cell WHERE part = 'bridge'),
  sc AS (SELECT cell, sqrt(sum(res * res) / (count(*) - 2)) AS s FROM rs GROUP BY 1)
  SELECT gene, round(avg(res / s) / any_value(CASE WHEN sd > 0 THEN sd ELSE 1 END), 6) + 0.0 AS rss FROM rs JOIN sc USING (cell) JOIN ge USING (gene) GROUP BY 1""")
def lindev_residual(spark, sf):
    cells, expr = _cells_and_expr(spark, sf)
    return assoc.linearity_deviation(expr, cells).withColumn("rss", rnd("rss"))


LFC = """ SELECT gene, grp AS "group", round(log2((exp(s / n) - 1 + 1e-9) / (exp((all_s - s) / (all_n - n)) - 1 + 1e-9)), 5) + 0.0 AS lfc FROM k"""


@query(f"""WITH {C}, x AS (SELECT cell, gene, batch, ln(1 + value) AS value FROM c), n AS (SELECT batch AS grp, count(DISTINCT cell) AS n FROM c WHERE batch IN ('BUILDING', 'MACHINERY') GROUP BY 1),
  sm AS (SELECT gene, batch AS grp, sum(value) AS s FROM x GROUP BY 1, 2), k AS (SELECT g.gene, n.grp, coalesce(s, 0) AS s, n, sum(coalesce(s, 0)) OVER (PARTITION BY g.gene) AS all_s, sum(n) OVER (PARTITION BY g.gene) AS all_n
  FROM (SELECT DISTINCT gene FROM x) g CROSS JOIN n LEFT JOIN sm ON sm.gene = g.gene AND sm.grp = n.grp)""" + LFC)
def cov_lfc(spark, sf):
    cells, expr = _cells_and_expr(spark, sf)
    two = cells.where(F.col("batch").isin("BUILDING", "MACHINERY"))
    return assoc.fold_changes(expr.withColumn("value", F.log1p("value")).drop("batch"), two, "batch").withColumn("lfc", rnd("lfc", 5))


@query(f"""WITH {C}, x AS (SELECT cell, gene, batch, ln(1 + value) AS value FROM c), n AS (SELECT batch AS grp, count(DISTINCT cell) AS n FROM c GROUP BY 1),
  sm AS (SELECT gene, batch AS grp, sum(value) AS s FROM x GROUP BY 1, 2), k AS (SELECT g.gene, n.grp, coalesce(s, 0) AS s, n, sum(coalesce(s, 0)) OVER (PARTITION BY g.gene) AS all_s, sum(n) OVER (PARTITION BY g.gene) AS all_n
  FROM (SELECT DISTINCT gene FROM x) g CROSS JOIN n LEFT JOIN sm ON sm.gene = g.gene AND sm.grp = n.grp)""" + LFC)
def cov_ovr_lfc(spark, sf):
    cells, expr = _cells_and_expr(spark, sf)
    return assoc.fold_changes(expr.withColumn("value", F.log1p("value")).drop("batch"), cells, "batch").withColumn("lfc", rnd("lfc", 5))


# --- bifurcations ---


@query(f"""WITH {M}, p AS (SELECT cell * 1000000 + CAST(floor(t / 86400) AS BIGINT) AS cell, t, seg AS branch FROM m)
  SELECT cell, round(t, 6) AS t, branch FROM (SELECT *, count(*) OVER (PARTITION BY cell) AS n FROM (SELECT cell, branch, min(t) AS t FROM p GROUP BY 1, 2)) WHERE n = 1""")
def fork_unique_cells(spark, sf):
    """A cell is a user's day: some days are on one branch only, others on several."""
    day = F.col("cell") * 1_000_000 + F.floor(F.col("t") / 86400)
    p = tables.mappings(spark, sf).groupBy(day.alias("cell"), F.col("seg").alias("branch")).agg(F.min("t").alias("t"))
    return fork.branch_cells(p).select("cell", rnd("t").alias("t"), "branch")


@query(f"WITH {E} SELECT cell, round((t - min(t) OVER (PARTITION BY seg)) / (max(t) OVER (PARTITION BY seg) - min(t) OVER (PARTITION BY seg)), 6) AS t, seg AS branch FROM e")
def fork_rescale(spark, sf):
    p = tables.timeline(spark, sf).select("cell", "t", F.col("seg").alias("branch"))
    return fork.branch_cells(p, rescale=True).withColumn("t", rnd("t"))


@query(f"""WITH {C}, t AS (SELECT cell, ln(1 + sum(value)) AS t, 'b' || CAST(cell % 2 + 1 AS VARCHAR) AS branch FROM c GROUP BY 1), en AS (SELECT min(m) AS e FROM (SELECT branch, max(t) AS m FROM t GROUP BY 1)),
  i AS (SELECT cell, branch FROM t, en WHERE t <= e), n AS (SELECT branch, count(*) AS n FROM i GROUP BY 1), s AS (SELECT gene, branch, sum(value) AS s FROM c JOIN i USING (cell) GROUP BY 1, 2),
  me AS (SELECT g.gene, n.branch, coalesce(s, 0) / n AS mean FROM (SELECT DISTINCT gene FROM c) g CROSS JOIN n LEFT JOIN s ON s.gene = g.gene AND s.branch = n.branch)
  SELECT gene, branch, round(mean, 6) AS mean, round(mean - max(mean) OVER (PARTITION BY gene), 6) + 0.0 AS effect FROM me""")
def fork_effect(spark, sf):
    paths, expr = _paths(spark, sf)
    return fork.branch_effects(expr, paths).select("gene", "branch", rnd("mean").alias("mean"), rnd("effect").alias("effect"))


@query(f"WITH {E} SELECT seg, round(regr_slope(value, t / 1000), 6) + 0.0 AS slope FROM e GROUP BY 1")
def fork_upreg_slope(spark, sf):
    e = tables.timeline(spark, sf).withColumn("t", F.col("t") / 1000)
    return fork.slopes(e, "seg", "t", "value").select("seg", rnd("slope").alias("slope"))


def _fork_table(spark, sf) -> DataFrame:
    """A fork table made of event statistics: users as features, two branches' effects."""
    e = tables.timeline(spark, sf)
    f = e.groupBy(F.col("user_id").cast("string").alias("gene")).agg(
        F.avg(F.when(F.col("cov") == "A", F.col("value")).when(F.col("seg") == "click", F.col("value"))).alias("a"), F.avg(F.when(F.col("seg") == "purchase", F.col("value"))).alias("b"), F.avg("value").alias("up_A"), (F.stddev_pop("value") / 10000).alias("up_p"), (F.count("*") / 100.0).alias("signi_fdr"))
    top = F.greatest("a", "b")
    return f.where("a IS NOT NULL AND b IS NOT NULL").select("gene", (F.col("a") - top).alias("b1"), (F.col("b") - top).alias("b2"), "up_A", "up_p", "signi_fdr")


FT = E + """, f0 AS (SELECT CAST(user_id AS VARCHAR) AS gene, avg(CASE WHEN cov = 'A' THEN value WHEN seg = 'click' THEN value END) AS a, avg(CASE WHEN seg = 'purchase' THEN value END) AS b,
  avg(value) AS up_A, stddev_pop(value) / 10000 AS up_p, count(*) / 100.0 AS signi_fdr FROM e GROUP BY 1),
  f AS (SELECT gene, a - greatest(a, b) AS b1, b - greatest(a, b) AS b2, up_A, up_p, signi_fdr FROM f0 WHERE a IS NOT NULL AND b IS NOT NULL)"""


@query(f"""WITH {FT} SELECT gene, CASE WHEN b1 + 0.5 >= 0 THEN 'b1' ELSE 'b2' END AS branch FROM f WHERE up_A > 0 AND up_p < 0.05 AND signi_fdr > 0.1
  AND (CASE WHEN b1 + 0.5 >= 0 THEN 1 ELSE 0 END + CASE WHEN b2 + 0.5 >= 0 THEN 1 ELSE 0 END) = 1""")
def fork_branch_specific(spark, sf):
    return fork.branch_specific(_fork_table(spark, sf), ["b1", "b2"], 0.5, 0.1).select("gene", "branch")


@query(f"WITH {E} SELECT round(min(m), 4) AS fork_t FROM (SELECT seg, max(t) AS m FROM e GROUP BY 1)")
def fork_time(spark, sf):
    return tables.timeline(spark, sf).groupBy("seg").agg(F.max("t").alias("m")).agg(rnd(F.min("m"), 4).alias("fork_t"))


AW = E + """, b AS (SELECT seg, t, value, max(t) OVER () AS hi FROM e), w AS (SELECT i * hi / 20 / 5 AS s, i * hi / 20 / 5 + hi / 20 AS f FROM (SELECT max(t) AS hi FROM e), range(100) r(i) WHERE i * hi / 20 / 5 + hi / 20 < hi)"""


@query(f"WITH {AW} SELECT round(s, 3) AS \"start\", round(f, 3) AS \"end\", count(*) AS n FROM b JOIN w ON t > s AND t < f GROUP BY 1, 2")
def activation_windows(spark, sf):
    e = tables.timeline(spark, sf)
    hi = e.agg(F.max("t")).first()[0]
    w = spark.createDataFrame(relational.value_windows(0.0, hi, 20, 5), "start double, end double")
    return relational.between_open(e, "t", w, "start", "end").groupBy(F.round("start", 3).alias("start"), F.round("end", 3).alias("end")).agg(F.count("*").alias("n"))


@query(f"""WITH {AW}, cu AS (SELECT seg, t, sqrt(t / hi) AS fit FROM b), ch AS (SELECT seg, s, f, arg_max(fit, t) - arg_min(fit, t) AS c FROM cu JOIN w ON t > s AND t < f GROUP BY 1, 2, 3)
  SELECT seg, round(coalesce(min(CASE WHEN c > 0.05 THEN (s + f) / 2 END), any_value(never)), 3) AS onset FROM ch JOIN (SELECT seg, max(t) + 1 AS never FROM e GROUP BY 1) USING (seg) GROUP BY 1""")
def activation_onset(spark, sf):
    e = tables.timeline(spark, sf)
    hi = e.agg(F.max("t")).first()[0]
    w = spark.createDataFrame(relational.value_windows(0.0, hi, 20, 5), "start double, end double")
    curve = e.select("seg", "t", F.sqrt(F.col("t") / hi).alias("fit"))
    return fork.window_onsets(curve, "seg", w, 0.05).withColumn("onset", rnd("onset", 3))


@query(f"WITH {C}, t AS (SELECT cell, ln(1 + sum(value)) AS t FROM c GROUP BY 1) SELECT gene, round(regr_slope(value, t), 5) + 0.0 AS slope FROM c JOIN t USING (cell) GROUP BY 1")
def activation_lm_slope(spark, sf):
    cells, expr = _cells_and_expr(spark, sf)
    return fork.slopes(expr.join(cells.select("cell", "t"), "cell"), "gene", "t", "value").select("gene", rnd("slope", 5).alias("slope"))


@query()
def activation_lm(spark, sf):
    """The fork is where the first branch ends, as in fork_effect."""
    paths, expr = _paths(spark, sf)
    fork_t = paths.groupBy("branch").agg(F.max("t").alias("m")).agg(F.min("m")).first()[0]
    return fork.activation_lm(expr, paths.where(F.col("t") < fork_t).select("cell", "t"))


# --- correlations ---


@query(f"""WITH {E}, n AS (SELECT CAST(cell % 50 AS INTEGER) AS node, min(t) AS time, CAST(count(*) AS DOUBLE) AS mass FROM e GROUP BY 1),
  k AS (SELECT node, time, mass, sum(mass) OVER (ORDER BY time, node ROWS UNBOUNDED PRECEDING) AS cumulative FROM n)
  SELECT node, round(time, 4) AS time, cumulative, CAST(floor(cumulative / 900) AS INTEGER) AS "window" FROM k""")
def slide_cells_mass(spark, sf):
    n = tables.timeline(spark, sf).groupBy((F.col("cell") % 50).cast("int").alias("node")).agg(F.min("t").alias("time"), F.count("*").cast("double").alias("mass"))
    return project.running_mass(n, 900).select("node", rnd("time", 4).alias("time"), "cumulative", "window")


@query()
def slide_cells_windows(spark, sf):
    a, g = assigned(spark, sf)
    g = g.rooted(g.tips[0])
    mass, _ = fit._sums(tables.vectors(spark, sf), g.nodes, SIGMA, None)
    way = g.path(g.root, g.tips[-1])
    return project.window_weights(a, project.slide_windows(g.time, mass, way[:2], [way[2:]], float(mass.max()) * 1.2))


@query(f"WITH {E}, v AS (SELECT cell, seg, round(value) AS v FROM e) SELECT cell, rank() OVER (PARTITION BY seg ORDER BY v) + (count(*) OVER (PARTITION BY seg, v) - 1) / 2.0 AS rank FROM v")
def slide_avg_rank(spark, sf):
    e = tables.timeline(spark, sf).withColumn("v", F.round("value"))
    return e.select("cell", relational.average_rank("v", "seg").alias("rank"))


DC = C + """, gl AS (SELECT DISTINCT gene FROM c), cl AS (SELECT DISTINCT cell FROM c), de AS (SELECT cl.cell, gl.gene, coalesce(c.value, 0)::DOUBLE AS value FROM cl CROSS JOIN gl LEFT JOIN c ON c.cell = cl.cell AND c.gene = gl.gene)"""


def _dense(spark, sf) -> DataFrame:
    c = tables.counts(spark, sf)
    return preprocess.dense_slice(c, c, c)


@query(f"""WITH {DC}, rk AS (SELECT cell, gene, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS x FROM de),
  w AS (SELECT cell, CAST(cell % 3 AS INTEGER) AS win, 1 + (cell % 7) / 10.0 AS w FROM cl), z AS (SELECT rk.cell, gene, win, w, x - sum(w * x) OVER (PARTITION BY win, gene) / sum(w) OVER (PARTITION BY win, gene) AS z FROM rk JOIN w USING (cell))
  SELECT a.win AS "window", a.gene AS a, b.gene AS b, round(sum(a.w * a.z * b.z) / sqrt(sum(a.w * a.z * a.z) * sum(a.w * b.z * b.z)), 6) + 0.0 AS r FROM z a JOIN z b ON a.cell = b.cell AND a.gene <> b.gene GROUP BY 1, 2, 3""")
def slide_weighted_corr(spark, sf):
    dense = _dense(spark, sf)
    ranks = dense.withColumn("rank", relational.average_rank("value", "gene")).select("cell", "gene", "rank")
    w = dense.select("cell").distinct().select("cell", (F.col("cell") % 3).cast("int").alias("window"), (1 + (F.col("cell") % 7) / 10.0).alias("w"))
    return cors.weighted_correlations(ranks, w).withColumn("r", rnd("r"))


@query(f"""WITH {DC}, rk AS (SELECT cell, gene, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS x FROM de),
  z AS (SELECT cell, gene, CAST(cell % 3 AS INTEGER) AS win, x - avg(x) OVER (PARTITION BY CAST(cell % 3 AS INTEGER), gene) AS z FROM rk),
  r AS (SELECT a.win, a.gene AS a, b.gene AS b, sum(a.z * b.z) / sqrt(sum(a.z * a.z) * sum(b.z * b.z)) AS r FROM z a JOIN z b ON a.cell = b.cell AND a.gene <> b.gene GROUP BY 1, 2, 3)
  SELECT win AS "window", a AS gene, CASE WHEN b < 'Brand#13' THEN 'A' ELSE 'B' END AS geneset, round(avg(r), 6) + 0.0 AS cor FROM r GROUP BY 1, 2, 3""")
def slide_cors(spark, sf):
    dense = _dense(spark, sf)
    w = dense.select("cell").distinct().select("cell", (F.col("cell") % 3).cast("int").alias("window"), F.lit(1.0).alias("w"))
    sets = dense.select("gene").distinct().withColumn("geneset", F.when(F.col("gene") < "Brand#13", "A").otherwise("B"))
    return cors.slide_cors(dense, w, sets).withColumn("cor", rnd("cor"))


SW = E + """, i AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY t, cell) - 1 AS i, count(*) OVER (PARTITION BY seg) AS n FROM e),
  wn AS (SELECT i.*, CAST(k AS INTEGER) AS win FROM i JOIN range(2000) r(k) ON i.i >= k * 30 AND i.i < k * 30 + 200 AND k * 30 < n - 200)"""


@query(f"WITH {SW} SELECT seg, win AS \"window\", count(*) AS n, round(avg(t), 3) AS t FROM wn GROUP BY 1, 2")
def synchro_windows(spark, sf):
    w = relational.count_windows(tables.timeline(spark, sf), ["t", "cell"], 200, 30, ["seg"])
    return w.groupBy("seg", "window").agg(F.count("*").alias("n"), rnd(F.avg("t"), 3).alias("t"))


@query(f"""WITH {SW}, rk AS (SELECT seg, win, rank() OVER (PARTITION BY seg, win ORDER BY round(value)) + (count(*) OVER (PARTITION BY seg, win, round(value)) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY seg, win ORDER BY user_id) + (count(*) OVER (PARTITION BY seg, win, user_id) - 1) / 2.0 AS b FROM wn) SELECT seg, win AS "window", round(corr(a, b), 6) + 0.0 AS r FROM rk GROUP BY 1, 2""")
def synchro_corr(spark, sf):
    w = relational.count_windows(tables.timeline(spark, sf), ["t", "cell"], 200, 30, ["seg"]).withColumn("v", F.round("value"))
    ranked = w.withColumn("a", relational.average_rank("v", "seg", "window")).withColumn("b", relational.average_rank("user_id", "seg", "window"))
    return ranked.groupBy("seg", "window").agg(rnd(F.corr("a", "b")).alias("r"))


@query(f"WITH {E}, g AS (SELECT k * 10007.0 AS gt, k AS gv FROM range(50) r(k)) SELECT cell, arg_min(gv, abs(gt - t) + gt * 1e-12) AS near FROM e, g GROUP BY 1")
def synchro_nearest(spark, sf):
    grid = spark.createDataFrame([(k * 10007.0, k) for k in range(50)], "g_t double, g_v long")
    return relational.nearest(tables.timeline(spark, sf).select("cell", "t"), "t", grid, "g_t", "g_v", "near").select("cell", "near")


def _synchro(spark, sf) -> tuple[DataFrame, DataFrame]:
    dense = _dense(spark, sf)
    cells, _ = _cells_and_expr(spark, sf)
    return dense, cells.select("cell", "t", F.concat(F.lit("b"), "seg").alias("branch"))


SETS = (["Brand#11", "Brand#12"], ["Brand#13", "Brand#14"])


@query()
def synchro_path(spark, sf):
    return cors.synchro_path(*_synchro(spark, sf), *SETS, size=100, step=50)


@query()
def synchro_path_multi(spark, sf):
    dense, cells = _synchro(spark, sf)
    paths = {b: cells.where(F.col("branch") == b).select("cell", "t") for b in ("b1", "b2")}
    return cors.synchro_path_multi(dense, paths, dict(zip(("b1", "b2"), SETS, strict=True)), size=100, step=50, perm=False)


@query()
def synchro_inter_cor(spark, sf):
    dense, cells = _synchro(spark, sf)
    return cors.inter_values(cors.synchro_path(dense, cells, *SETS, size=100, step=50), cells, 6.5)


@query(f"WITH {DC}, z AS (SELECT cell, gene FROM de WHERE value <> 0) SELECT a.gene AS a, b.gene AS b, count(*) AS n FROM z a JOIN z b ON a.cell = b.cell AND a.gene < b.gene GROUP BY 1, 2 HAVING count(*) >= 10")
def incl_mask(spark, sf):
    return cors.coexpression_mask(_dense(spark, sf), 10)


@query(f"""WITH {M}, p AS (SELECT cell AS gene, row_number() OVER (PARTITION BY cell ORDER BY t, map_id) - 1 AS i, -10.0 * (value - floor(value)) + ln(10 / (1 - exp(-10.0))) AS g FROM m),
  q AS (SELECT gene, i, sum(g) OVER (PARTITION BY gene ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS s, count(*) OVER (PARTITION BY gene) AS n FROM p)
  SELECT gene, CASE WHEN max(s) > 0 THEN arg_max(i, s) ELSE any_value(n) END AS switch FROM q GROUP BY 1""")
def incl_switch_point(spark, sf):
    m = tables.mappings(spark, sf)
    p = m.withColumn("i", F.row_number().over(Window.partitionBy("cell").orderBy("t", "map_id")) - 1).withColumn("p", F.col("value") - F.floor("value"))

    @F.pandas_udf("long")
    def point(ps: pd.Series) -> pd.Series:
        return ps.map(cors.switch_point)

    return p.groupBy(F.col("cell").alias("gene")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "p"))), lambda s: s["p"]).alias("ps")).select("gene", point("ps").alias("switch"))


@query(f"WITH {M} SELECT seg AS branch, cell AS gene, round(median(t), 3) AS inclusion_t, round(count(t) / 5.0, 6) AS share FROM (SELECT seg, cell, map_id, min(t) AS t FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(t) / 5.0 > 0.8")
def incl_props(spark, sf):
    m = tables.mappings(spark, sf).groupBy(F.col("seg").alias("branch"), F.col("cell").alias("gene"), "map_id").agg(F.min("t").alias("inclusion_t"))
    return cors.kept_inclusions(m, 0.8).select("branch", "gene", rnd("inclusion_t", 3).alias("inclusion_t"), rnd("share").alias("share"))


@query()
def module_inclusion(spark, sf):
    dense, cells = _synchro(spark, sf)
    return cors.module_inclusion(dense, cells, 100, 50, n_perm=3)


# --- views and accessors ---


@query("WITH " + R + " SELECT CAST(node AS INTEGER) AS node, CAST(dim AS INTEGER) AS dim, round(sum(w * x) / sum(w), 6) + 0.0 AS x FROM r JOIN v USING (cell) WHERE dim < 2 GROUP BY 1, 2")
def view_node_projection(spark, sf):
    a, _ = assigned(spark, sf)
    return views.node_projection(a.withColumn("e", F.slice("x", 1, 2)), "e").withColumn("x", rnd("x"))


@query("WITH " + R + ", nv AS (SELECT node, sum(w * CAST(cell AS DOUBLE)) / sum(w) AS value FROM r GROUP BY 1), cu AS (SELECT quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.9) AS b FROM nv) SELECT CAST(x.node AS INTEGER) AS src, CAST(y.node AS INTEGER) AS dst, round((greatest(a, least(b, x.value)) + greatest(a, least(b, y.value))) / 2, 4) AS value FROM nv x JOIN nv y ON x.node + 1 = y.node, cu")
def view_node_value(spark, sf):
    a, _ = assigned(spark, sf)
    nodes = project.node_means(a.withColumn("v", F.col("cell").cast("double")), "v")
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "src int, dst int")
    return views.edge_values(nodes, edges, 10, 90).withColumn("value", rnd("value", 4))


BIN = "CAST(greatest(1, least({n}, ceil((t - lo) / ((hi - lo) / {n})))) AS INTEGER)"


@query(f"""WITH {E}, b AS (SELECT seg, {BIN.format(n=20)} AS bin FROM (SELECT *, min(t) OVER () AS lo, max(t) OVER () AS hi FROM e)), n AS (SELECT bin, seg, count(*) AS n FROM b GROUP BY 1, 2)
  SELECT g.bin, s.seg, round(coalesce(n, 0) * 1.0 / sum(coalesce(n, 0)) OVER (PARTITION BY g.bin), 6) AS share FROM (SELECT DISTINCT bin FROM n) g CROSS JOIN (SELECT DISTINCT seg FROM n) s LEFT JOIN n ON n.bin = g.bin AND n.seg = s.seg""")
def view_bins_meta(spark, sf):
    return views.binned_meta(tables.timeline(spark, sf), "seg").withColumn("share", rnd("share"))


@query(f"""WITH {E}, b AS (SELECT seg, cov AS gene, value, {BIN.format(n=10)} AS bin FROM (SELECT *, min(t) OVER (PARTITION BY seg) AS lo, max(t) OVER (PARTITION BY seg) AS hi FROM e)), m AS (SELECT seg, bin, gene, avg(value) AS v FROM b GROUP BY 1, 2, 3)
  SELECT seg, bin, gene, round((v - min(v) OVER (PARTITION BY gene)) / (max(v) OVER (PARTITION BY gene) - min(v) OVER (PARTITION BY gene)), 6) AS value FROM m""")
def view_matrix(spark, sf):
    e = tables.timeline(spark, sf)
    return views.binned_matrix(e.select("cell", "t", "seg"), e.select("cell", F.col("cov").alias("gene"), "value")).withColumn("value", rnd("value"))


@query(f"WITH {E} SELECT cell, round((t - min(t) OVER (PARTITION BY seg)) / (max(t) OVER (PARTITION BY seg) - min(t) OVER (PARTITION BY seg)), 6) AS progress FROM e")
def view_minmax(spark, sf):
    return views.milestone_gradient(tables.timeline(spark, sf)).select("cell", rnd("progress").alias("progress"))


@query(f"WITH {E}, q AS (SELECT seg, quantile_cont(value, 0.8) AS c FROM e GROUP BY 1) SELECT seg AS gene, round(avg(t), 3) AS place FROM e JOIN q USING (seg) WHERE value > c GROUP BY 1")
def view_order_quantile(spark, sf):
    e = tables.timeline(spark, sf)
    fitted = e.select("cell", F.col("seg").alias("gene"), F.col("value").alias("fitted"))
    return views.trend_order(fitted, e).withColumn("place", rnd("place", 3))


@query(f"WITH {ST}, f AS (SELECT gene, max(A) AS A FROM st GROUP BY 1) SELECT gene, round(A, 4) AS A FROM f ORDER BY f.A DESC, gene LIMIT 10")
def view_topn(spark, sf):
    return views.top_features(_stats(spark, sf).groupBy("gene").agg(F.max("A").alias("A")), "A", 10).select("gene", rnd("A", 4).alias("A"))


@query(f"WITH {E} SELECT CAST(cell % 7 AS INTEGER) AS \"window\", round(abs((corr(g, t) + corr(1 - g, value)) / 2), 6) AS score FROM (SELECT *, CAST(user_id % 2 AS DOUBLE) AS g FROM e) GROUP BY 1")
def view_repulsion(spark, sf):
    e = tables.timeline(spark, sf)
    rows = e.select((F.col("cell") % 7).cast("int").alias("window"), (F.col("user_id") % 2).alias("grp"), F.col("t").alias("cor_a"), F.col("value").alias("cor_b"))
    return views.repulsion(rows).withColumn("score", rnd("score"))


@query(f"WITH {M}, i AS (SELECT cell AS gene, map_id, min(t) AS it FROM m GROUP BY 1, 2) SELECT gene, k * 2000000 / 10.0 AS at, round(avg(CASE WHEN it <= k * 2000000 / 10.0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM i, range(11) r(k) GROUP BY 1, 2")
def view_incl_cdf(spark, sf):
    i = tables.mappings(spark, sf).groupBy(F.col("cell").alias("gene"), "map_id").agg(F.min("t").alias("inclusion_t"))
    return views.inclusion_cdf(i, 11, 2000000.0).withColumn("share", rnd("share"))


@query(f"""WITH {ST}, f AS (SELECT gene, A, CASE WHEN fdr < 0.004 THEN 0 ELSE fdr END AS fdr FROM st WHERE map_id = 0)
  SELECT gene, round(A, 4) AS A, round(CASE WHEN fdr = 0 THEN (SELECT min(fdr) FROM f WHERE fdr > 0) ELSE fdr END, 11) AS fdr FROM f""")
def view_fdr_floor(spark, sf):
    s = _stats(spark, sf).where("map_id = 0").withColumn("fdr", F.when(F.col("fdr") < 0.004, 0.0).otherwise(F.col("fdr"))).withColumn("signi", F.lit(True))
    return views.association_points(s).select("gene", rnd("A", 4).alias("A"), rnd("fdr", 11).alias("fdr"))


@query()
def view_trajectory_arrows(spark, sf):
    p, g = _projected(spark, sf)
    places = spark.createDataFrame(views.arrow_places(g), "seg string, node int, ahead int")
    return places.join(views.arrow_values(p, "t"), "node", "left")


@query()
def view_trends(spark, sf):
    cells, expr = _cells_and_expr(spark, sf)
    fitted = assoc.fit_features(expr, cells.withColumn("branch", F.col("seg")), knots=6)
    return views.mean_trajectory(fitted.withColumn("fitted", relational.min_max("fitted", "gene")), cells, 10)


@query()
def view_single_trend(spark, sf):
    cells, expr = _cells_and_expr(spark, sf)
    one = expr.where("gene = 'Brand#11'")
    return views.single_trend(cells, one, assoc.fit_features(one, cells.withColumn("branch", F.col("seg")), knots=6), "Brand#11")


@query()
def view_synchro_curves(spark, sf):
    return views.synchro_curves(cors.synchro_path(*_synchro(spark, sf), *SETS, size=100, step=50), 5)


@query(f"WITH {FT} SELECT gene, round(b1, 4) + 0.0 AS b1, round(b2, 4) + 0.0 AS b2 FROM f WHERE up_p / 10 < 0.05")
def view_fork_points(spark, sf):
    f = _fork_table(spark, sf).withColumn("fdr", F.col("up_p") / 10)
    return views.fork_points(f, ["b1", "b2"]).select("gene", rnd("b1", 4).alias("b1"), rnd("b2", 4).alias("b2"))


@query(f"WITH {FT} SELECT gene, CASE WHEN up_p < 0.003 THEN 'early' ELSE 'late' END AS module, CASE WHEN b1 = 0 THEN 'b1' ELSE 'b2' END AS branch FROM f WHERE up_p < 0.003 AND b1 = 0")
def get_fork_stats(spark, sf):
    f = _fork_table(spark, sf).select("gene", F.when(F.col("up_p") < 0.003, "early").otherwise("late").alias("module"), F.when(F.col("b1") == 0, "b1").otherwise("b2").alias("branch"))
    return views.fork_stats(f, "early", "b1")


@query(f"""WITH {DC}, k AS (SELECT gene, CASE WHEN gene < 'Brand#13' THEN 'b1' ELSE 'b2' END AS branch, CASE WHEN gene IN ('Brand#11', 'Brand#13') THEN 'early' ELSE 'late' END AS module FROM gl)
  SELECT cell, branch, module, round(avg(value), 6) AS value FROM de JOIN k USING (gene) GROUP BY 1, 2, 3""")
def get_modules(spark, sf):
    dense = _dense(spark, sf)
    f = dense.select("gene").distinct().select("gene", F.when(F.col("gene") < "Brand#13", "b1").otherwise("b2").alias("branch"), F.when(F.col("gene").isin("Brand#11", "Brand#13"), "early").otherwise("late").alias("module"))
    return views.modules(dense, dense, f).withColumn("value", rnd("value"))


@query(f"WITH {E} SELECT cell, seg AS branch, cov AS geneset, value FROM e WHERE seg = 'click' AND cov = 'A'")
def get_slide_cors(spark, sf):
    e = tables.timeline(spark, sf).select("cell", F.col("seg").alias("branch"), F.col("cov").alias("geneset"), "value")
    return views.get_slide_cors(e, "click", "A")


@query("SELECT 100 + n_nationkey AS tip, CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS INTEGER) AS place FROM nation")
def layout_dendro(spark, sf):
    g, names = tables.hierarchy_graph(spark, sf)
    g = g.rooted(0)
    place = g.layout()
    tips = sorted((place[s.n], names[s.end]) for s in g.segments if s.end in g.tips)
    return spark.createDataFrame([(t, i) for i, (_, t) in enumerate(tips)], "tip int, place int")


@query()
def layout_cells(spark, sf):
    p, g = _projected(spark, sf)
    return project.dendrogram(p, g)[0].select("cell", "x", "y")


@query()
def cluster_features(spark, sf):
    c = tables.counts(spark, sf)
    return assoc.cluster_features(c.select("cell", "gene", F.col("value").alias("fitted")))


MO = KNN + """, w AS (SELECT src, dst, 1.0 AS w FROM nn), vl AS (SELECT v.cell, 'g' || CAST(dim AS VARCHAR) AS gene, x - avg(x) OVER (PARTITION BY dim) AS z FROM v)
  SELECT a.gene, round((SELECT count(DISTINCT cell) FROM v) / (SELECT sum(w) FROM w) * sum(w.w * a.z * b.z) / any_value(zz), 6) + 0.0 AS morans_I FROM w JOIN vl a ON w.src = a.cell JOIN vl b ON w.dst = b.cell AND a.gene = b.gene JOIN (SELECT gene, sum(z * z) AS zz FROM vl GROUP BY 1) q ON q.gene = a.gene GROUP BY 1"""


@query(MO)
def moran_i(spark, sf):
    v = tables.vectors(spark, sf)
    edges = preprocess.knn(v, 9).select("src", "dst", F.lit(1.0).alias("w"))
    values = v.select("cell", F.posexplode("x").alias("dim", "value")).select("cell", F.concat(F.lit("g"), F.col("dim").cast("string")).alias("gene"), "value")
    return assoc.moran_i(values, edges).select("gene", rnd("morans_I").alias("morans_I"))


@query()
def assoc_monocle3(spark, sf):
    v = tables.vectors(spark, sf)
    edges = preprocess.knn(v, 9).select("src", "dst", F.lit(1.0).alias("w"))
    values = v.select("cell", F.posexplode("x").alias("dim", "value")).select("cell", F.concat(F.lit("g"), F.col("dim").cast("string")).alias("gene"), "value")
    return assoc.test_association_monocle3(values, values, edges)


# --- changes of topology ---


@query()
def graph_cleanup_rows(spark, sf):
    """Soft assignments after short branches are gone: columns dropped, rows normalised again."""
    a, g = assigned(spark, sf)
    small, groups = g.cleaned(1)
    return fit.regroup(a, groups).select("cell", F.size("r").alias("k"), F.round(F.aggregate("r", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query()
def graph_cleanup(spark, sf):
    g, names = tables.hierarchy_graph(spark, sf)
    return _graph_rows(spark, g.cleaned(1, leaves=[g.tips[0]])[0])


@query("SELECT 26 AS nodes, 25 AS edges")
def graph_merge_empty(spark, sf):
    g = tables.hierarchy_graph(spark, sf)[0].merged()[0]
    return spark.createDataFrame([(len(g.degree), len(g.edges))], "nodes int, edges int")


@query()
def graph_simplify(spark, sf):
    a, g = assigned(spark, sf)
    out, small = fit.simplify(a, g.rooted(g.tips[0]), 1)
    return _graph_rows(spark, small)


@query()
def graph_attach(spark, sf):
    a, g = assigned(spark, sf)
    left, right = a.where("cell % 2 = 0"), a.where("cell % 2 = 1")
    return fit.attach(left, g, right, g, (0, 1))[0].select("cell", F.size("r").alias("k"))


@query(f"WITH {E} SELECT cell, seg, NULL::DOUBLE AS value FROM e WHERE seg = 'click' UNION ALL SELECT cell, NULL, value FROM e WHERE seg <> 'click'")
def attach_outer_union(spark, sf):
    e = tables.timeline(spark, sf)
    return e.where("seg = 'click'").select("cell", "seg").unionByName(e.where("seg != 'click'").select("cell", "value"), allowMissingColumns=True)


@query(f"WITH {E} SELECT cell, CAST(ntile(7) OVER (PARTITION BY seg ORDER BY t, cell) AS INTEGER) AS chunk FROM e")
def simplify_ntile(spark, sf):
    return tables.timeline(spark, sf).select("cell", F.ntile(7).over(Window.partitionBy("seg").orderBy("t", "cell")).alias("chunk"))


@query()
def graph_subset_extract(spark, sf):
    g = tables.hierarchy_graph(spark, sf)[0].rooted(0)
    sub = project.subset_graph(g, "0", [str(g.tips[0]), str(g.tips[-1])])
    return _graph_rows(spark, sub)
