"""Queries over hierarchies of vectors, explanations by sampled coalitions, and models fitted by sums over all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.operators import cells as L
from lodeworks.operators import crystal as K
from lodeworks.operators import design as D
from lodeworks.operators import explain as X
from lodeworks.operators import gradient as G
from lodeworks.operators import hierarchy as H
from lodeworks.operators import select as S
from lodeworks.operators import workflow as R
from lodeworks.plans.query import LINE_KEY, query, read, rounded

VECTORS = "(SELECT vec_id, list_transform(embedding, lambda v: v::double) AS x FROM embeddings)"
DISTANCE = "sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) ** 2)))"


def _tree_sql(min_samples: int) -> str:
    """``f``: the edges of the spanning tree, point by point from the smallest key; the nearest one outside is the first edge in order."""
    core = f"SELECT a, d AS core FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = {min_samples - 1}" if min_samples > 1 else "SELECT DISTINCT a, 0.0::double AS core FROM d"
    return f"""d AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, {DISTANCE} AS d FROM {VECTORS} a JOIN {VECTORS} b ON a.vec_id <> b.vec_id),
    c AS MATERIALIZED ({core}), w AS MATERIALIZED (SELECT d.a, d.b, greatest(d.d, x.core, y.core) AS w FROM d JOIN c x ON x.a = d.a JOIN c y ON y.a = d.b),
    r AS (SELECT 0 AS step, b AS node, {{'w': w, 'lo': least(a, b), 'hi': greatest(a, b)}} AS e FROM w WHERE a = (SELECT min(vec_id) FROM embeddings)
        UNION ALL SELECT r.step + 1, r.node, least(r.e, {{'w': w.w, 'lo': least(w.a, w.b), 'hi': greatest(w.a, w.b)}}) FROM r, (SELECT arg_min(node, e) AS n FROM r) k, w WHERE r.node <> k.n AND w.a = k.n AND w.b = r.node),
    f AS MATERIALIZED (SELECT e.lo AS lo, e.hi AS hi, e.w AS w FROM (SELECT min(e) AS e FROM r GROUP BY step))"""


@query("c9_spanning_tree", f"WITH RECURSIVE {_tree_sql(5)} SELECT lo AS a, hi AS b, round(w, 6) AS weight FROM f")
def spanning_tree(spark, sf):
    return rounded(H.spanning_tree(read(spark, sf, "embeddings"), "vec_id", "embedding", 5))


@query("c9_hdbscan")
def hdbscan(spark, sf):
    return rounded(H.hdbscan(read(spark, sf, "embeddings"), "vec_id", "embedding", 5))


@query("c8_reachability")
def reachability(spark, sf):
    return rounded(H.reachability(read(spark, sf, "embeddings"), "vec_id", "embedding", 5))


@query(
    "c3_single_linkage",
    f"""WITH RECURSIVE {_tree_sql(1)}, k AS (SELECT * FROM f QUALIFY row_number() OVER (ORDER BY w DESC, lo DESC, hi DESC) > 9), s AS (SELECT lo AS a, hi AS b FROM k UNION ALL SELECT hi, lo FROM k),
    m(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT m.a, s.b FROM m JOIN s ON s.a = m.b) SELECT a AS vec_id, min(b) AS cluster FROM m GROUP BY 1""",
)
def single_linkage(spark, sf):
    return H.single_linkage(read(spark, sf, "embeddings"), "vec_id", "embedding", k=10)


# Two features over the five means by type: closed forms of the coalitions.
BACKGROUND = "(SELECT avg(p_size) AS s, avg(p_retailprice) AS r FROM part GROUP BY p_type)"
MODEL = "(3 * {s} + {s} * {r})"


@query(
    "x4_kernel_shap",
    f"""WITH m AS (SELECT p_partkey, p_size::double AS size, p_retailprice AS price, {MODEL.format(s="p_size", r="p_retailprice")} AS f, avg({MODEL.format(s="p_size", r="b.r")}) AS one, avg({MODEL.format(s="b.s", r="p_retailprice")}) AS two, avg({MODEL.format(s="b.s", r="b.r")}) AS none FROM part, {BACKGROUND} b GROUP BY ALL)
    SELECT p_partkey, 'p_size' AS feature, size AS value, round((one - none + f - two) / 2, 4) AS phi FROM m UNION ALL SELECT p_partkey, 'p_retailprice', round(price, 4), round((two - none + f - one) / 2, 4) FROM m""",
)
def kernel_shap(spark, sf):
    part = read(spark, sf, "part")
    background = part.groupBy("p_type").agg(F.avg("p_size").alias("p_size"), F.avg("p_retailprice").alias("p_retailprice"))
    model = lambda d: d.withColumn("prediction", 3 * F.col("p_size") + F.col("p_size") * F.col("p_retailprice"))
    return rounded(X.kernel_shap(part, ("p_size", "p_retailprice"), model, "p_partkey", background), 4)


@query("o5_one_class")
def one_class(spark, sf):
    x = read(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rounded(G.one_class_outliers(x, ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), 0.05, rounds=10).select(*LINE_KEY, "score", "is_outlier"))


@query("m2_kernel_machine")
def kernel_machine(spark, sf):
    x = read(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity", "l_discount", (F.col("l_extendedprice") > 50000).cast("double").alias("dear"))
    return rounded(G.kernel_machine(x, ("l_quantity", "l_discount"), "dear", rounds=15).score(x).select(*LINE_KEY, "score"))


@query("m6_regression_network")
def regression_network(spark, sf):
    x = read(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity", "l_discount", "l_extendedprice")
    return rounded(G.regression_network(x, ("l_quantity", "l_discount"), "l_extendedprice", (8,), rounds=20).predict(x).select(*LINE_KEY, "prediction"), 2)


# A plane over two standardised columns: the three weights' posterior, written out.


@query(
    "a4_gaussian_surrogate",
    """WITH m AS (SELECT count(*)::double AS n, avg(l_quantity) AS ma, stddev_pop(l_quantity) AS sa, avg(l_discount) AS mb, stddev_pop(l_discount) AS sb, avg(l_extendedprice / 1000) AS my, corr(l_quantity, l_discount) AS c, covar_pop(l_quantity, l_extendedprice / 1000) AS qa, covar_pop(l_discount, l_extendedprice / 1000) AS qb FROM lineitem),
    w AS (SELECT *, (n + 1) * (n + 1) - n * n * c * c AS det FROM m),
    k AS (SELECT *, n * my / (n + 1) AS w0, n * ((n + 1) * qa / sa - n * c * qb / sb) / det AS wa, n * ((n + 1) * qb / sb - n * c * qa / sa) / det AS wb FROM w),
    z AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity - ma) / sa AS a, (l_discount - mb) / sb AS b, k.* FROM lineitem, k)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(w0 + wa * a + wb * b, 5) AS mu, round(sqrt(1 / (n + 1) + ((n + 1) * (a * a + b * b) - 2 * n * c * a * b) / det), 7) AS sigma FROM z""",
)
def gaussian_surrogate(spark, sf):
    x = read(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity", "l_discount", (F.col("l_extendedprice") / 1000).alias("y"))
    found = G.gaussian_surrogate(x, ("l_quantity", "l_discount"), "y", draws=None).score(x)
    return found.select(*LINE_KEY, F.round("mu", 5).alias("mu"), F.round("sigma", 7).alias("sigma"))


# Level by level of the third objective: the area of all parts up to it.
@query(
    "mo6_hypervolume_three",
    """WITH p AS (SELECT p_retailprice AS a, p_size::double AS b, (p_partkey % 23)::double AS z FROM part), l AS (SELECT DISTINCT z, coalesce(lead(z) OVER (ORDER BY z), 25) - z AS step FROM (SELECT DISTINCT z FROM p)),
    g AS (SELECT l.z, step, a, min(b) AS b FROM l JOIN p ON p.z <= l.z GROUP BY 1, 2, 3), s AS (SELECT step, a, b, coalesce(min(b) OVER (PARTITION BY z ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 60) AS m FROM g)
    SELECT round(sum(step * (1100 - a) * greatest(m - b, 0)), 4) AS hypervolume FROM s""",
)
def hypervolume_three(spark, sf):
    part = read(spark, sf, "part").select("p_retailprice", "p_size", (F.col("p_partkey") % 23).alias("k"))
    return rounded(D.hypervolume_of_many(part, ("p_retailprice", "p_size", "k"), (1100.0, 60.0, 25.0)), 4)


# Parts as points of a plane: size, and price above 900, in tens.
def plane(spark, sf):
    p = read(spark, sf, "part")
    return p.select("p_partkey", F.array((F.col("p_size") / 10).cast("double"), ((F.col("p_retailprice") - 900) / 10).cast("double")).alias("v"))


PLANE = "(SELECT p_partkey, p_size / 10 AS a, (p_retailprice - 900) / 10 AS b FROM part)"


@query("c5_cell_features", f"SELECT min(p_partkey) AS cell, count(*) AS n, round(avg(a), 6) AS a, round(avg(b), 6) AS b FROM {PLANE} GROUP BY floor(a / 0.7), floor(b / 0.7)")
def cell_features(spark, sf):
    found = L.cell_features(plane(spark, sf), "p_partkey", "v", 0.7)
    return rounded(found.select("cell", "n", F.col("centre")[0].alias("a"), F.col("centre")[1].alias("b")))


@query("c5_birch")
def birch(spark, sf):
    return L.birch(plane(spark, sf), "p_partkey", "v", 0.7, 5)


@query("c6_mean_shift")
def mean_shift(spark, sf):
    found = L.mean_shift(plane(spark, sf), "p_partkey", "v", 1.5, rounds=10)
    return rounded(found.select("p_partkey", "cluster", F.col("mode")[0].alias("a"), F.col("mode")[1].alias("b")), 4)


# Lines as bonds from a supplier's number to a part's, one graph for each line number.
@query(
    "g2_line_graph",
    """WITH b AS (SELECT l_linenumber AS graph, l_suppkey AS src, l_partkey AS dst, l_orderkey * 10 + l_linenumber AS bond FROM lineitem)
    SELECT a.graph, a.dst AS atom, count(*) AS n_pairs, sum(a.bond + 2 * c.bond)::bigint AS total FROM b a JOIN b c ON a.graph = c.graph AND a.dst = c.src AND a.bond <> c.bond GROUP BY 1, 2""",
)
def line_graph(spark, sf):
    bonds = read(spark, sf, "lineitem").select(F.col("l_linenumber").alias("graph"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("bond"))
    found = K.line_graph(bonds, "graph", "bond")
    return found.groupBy("graph", "atom").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("one") + 2 * F.col("other")).alias("total"))


@query("c15_report")
def report(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    tables = R.cluster_report(part, "p_partkey", ("p_size", "p_retailprice"), 4)
    return R.long_report(tables, {"audit": ("column_name",), "actions": ("column_name",), "metrics": (), "profile": ("cluster", "column_name")})


_FENCED = " OR ".join(f"(SELECT max({c}) > quantile_cont({c}, 0.75) * 2.5 - quantile_cont({c}, 0.25) * 1.5 OR min({c}) < quantile_cont({c}, 0.25) * 2.5 - quantile_cont({c}, 0.75) * 1.5 FROM lineitem)" for c in ("l_quantity", "l_discount", "l_tax"))


@query(
    "w5_plan",
    f"""WITH s AS (SELECT count(*) AS n, CASE WHEN count(DISTINCT l_extendedprice) > 20 THEN 'regression' ELSE 'classification' END AS task, greatest(abs(corr(l_quantity, l_discount)), abs(corr(l_quantity, l_tax)), abs(corr(l_discount, l_tax))) > 0.95 AS alike FROM lineitem),
    c AS (SELECT *, CASE WHEN alike THEN 'correlation' ELSE 'none' END AS selection FROM s)
    SELECT 'task' AS step, task AS choice FROM c UNION ALL SELECT 'selection', selection FROM c
    UNION ALL SELECT 'models', CASE WHEN n >= 1000 THEN 'forest, boosting' WHEN task = 'regression' THEN 'linear, tree' ELSE 'logistic, tree' END FROM c
    UNION ALL SELECT 'search', CASE WHEN n < 1000 THEN 'grid' ELSE 'random' END FROM c
    UNION ALL SELECT 'evaluation', CASE WHEN n < 1000 THEN 'nested cross-validation' WHEN n < 100000 THEN 'cross-validation' ELSE 'split' END FROM c
    UNION ALL SELECT 'order', concat_ws(', ', CASE WHEN {_FENCED} THEN 'clean' END, 'encode', 'scale', CASE WHEN selection <> 'none' THEN 'select' END, 'train', 'evaluate') FROM c""",
)
def model_plan(spark, sf):
    x = read(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice")
    return R.model_plan(x, ("l_quantity", "l_discount", "l_tax"), "l_extendedprice")


_FOLD = "('0x' || substr(md5('0|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), 1, 8))::bigint % 100 % 3"
_MISS = "round(sqrt(avg((y - my - {fit}) ** 2)), 4) AS rmse"


@query(
    "f10_subset_folds",
    f"""WITH t AS (SELECT {_FOLD} AS fold, l_quantity AS a, l_discount AS b, l_extendedprice AS y FROM lineitem), k AS (SELECT unnest([0, 1, 2]) AS held),
    m AS (SELECT held, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy FROM t, k WHERE fold <> held GROUP BY held),
    j AS (SELECT t.*, m.* FROM t JOIN m ON fold = held), w AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM j)
    SELECT 'l_quantity' AS subset, held::int AS fold, count(*) AS n_rows, {_MISS.format(fit="ay / aa * (a - ma)")} FROM w GROUP BY held
    UNION ALL SELECT 'l_discount', held::int, count(*), {_MISS.format(fit="byy / bb * (b - mb)")} FROM w GROUP BY held
    UNION ALL SELECT 'l_quantity,l_discount', held::int, count(*), {_MISS.format(fit="wa * (a - ma) - wb * (b - mb)")} FROM w GROUP BY held""",
)
def subset_folds(spark, sf):
    return rounded(S.subset_fold_scores(read(spark, sf, "lineitem"), ("l_quantity", "l_discount"), "l_extendedprice", LINE_KEY), 4)
