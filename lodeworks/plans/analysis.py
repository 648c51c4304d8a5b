"""Queries over selection, splits, metrics, explanations, models and clusters."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from lodeworks.operators import cluster as C
from lodeworks.operators import evaluate as V
from lodeworks.operators import explain as X
from lodeworks.operators import model as M
from lodeworks.operators import prepare as P
from lodeworks.operators import select as S
from lodeworks.operators.isolation import isolation_scores
from lodeworks.plans.query import LINE_KEY, query, read, rounded
from lodeworks.functions.scalars import hash_percent

KEY = ", ".join(LINE_KEY)
#: Importances of a few features: what selection rules start from.
WEIGHED = ("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey")
WEIGHTS_SQL = "(" + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS importance FROM lineitem" for c in WEIGHED) + ")"


def weights(spark, sf):
    row = read(spark, sf, "lineitem").agg(*[F.abs(F.corr(c, "l_extendedprice")).alias(c) for c in WEIGHED])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in WEIGHED])).alias("w")).select("w.*")


@query("f2_keep_top", f"SELECT feature, round(importance, 8) AS importance FROM {WEIGHTS_SQL} ORDER BY importance DESC LIMIT 3")
def keep_top(spark, sf):
    return rounded(S.keep_top(weights(spark, sf), 3), 8)


@query("f3_keep_above", f"SELECT feature, round(importance, 8) AS importance FROM {WEIGHTS_SQL} WHERE importance > 0.002")
def keep_above(spark, sf):
    return rounded(S.keep_above(weights(spark, sf), 0.002), 8)


@query("f4_keep_cumulative", f"SELECT feature, round(importance, 8) AS importance, round(c / t, 8) AS cumulative FROM (SELECT *, sum(importance) OVER (ORDER BY importance DESC, feature) AS c, sum(importance) OVER () AS t FROM {WEIGHTS_SQL}) WHERE (c - importance) / t < 0.8")
def keep_cumulative(spark, sf):
    return rounded(S.keep_cumulative(weights(spark, sf), 0.8), 8)


# The copy of quantity goes if it tells less of the target than quantity itself, and the other way round.
@query(
    "f5_drop_correlated",
    """WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS q, abs(corr(l_quantity + 10 * l_tax, l_extendedprice)) AS c, abs(corr(l_discount, l_extendedprice)) AS d FROM lineitem)
    SELECT 'l_quantity' AS feature, round(q, 6) AS target_r, q >= c AS kept, CASE WHEN q < c THEN 'nearly_quantity' END AS dropped_for FROM r
    UNION ALL SELECT 'nearly_quantity', round(c, 6), c > q, CASE WHEN c <= q THEN 'l_quantity' END FROM r UNION ALL SELECT 'l_discount', round(d, 6), true, NULL FROM r""",
)
def drop_correlated(spark, sf):
    x = read(spark, sf, "lineitem").withColumn("nearly_quantity", F.col("l_quantity") + 10 * F.col("l_tax"))
    return rounded(S.drop_correlated(x, ("l_quantity", "nearly_quantity", "l_discount"), "l_extendedprice"))


@query("v1_split", f"SELECT {KEY}, ('0x' || substr(md5('7|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), 1, 8))::bigint % 100 < 80 AS is_training FROM lineitem")
def split(spark, sf):
    return read(spark, sf, "lineitem").select(*LINE_KEY, V.is_training(LINE_KEY, 7, 80).alias("is_training"))


@query("v2_repeated_splits", "SELECT r AS repeat, count(*) AS n_rows, count(CASE WHEN ('0x' || substr(md5(r || '|' || o_orderkey), 1, 8))::bigint % 100 < 70 THEN 1 END) AS n_training FROM orders, (SELECT unnest(range(1, 6))::int AS r) GROUP BY 1")
def repeated_splits(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey")
    n = [F.count(F.when(V.is_training(["o_orderkey"], r, 70), 1)).alias(f"n{r}") for r in range(1, 6)]
    one = o.agg(F.count(F.lit(1)).alias("n_rows"), *n)
    return one.select("n_rows", F.explode(F.array(*[F.struct(F.lit(r).alias("repeat"), F.col(f"n{r}").alias("n_training")) for r in range(1, 6)])).alias("x")).select("x.repeat", "n_rows", "x.n_training")


PREDICTED = "(SELECT *, 1000 * l_quantity AS p FROM lineitem)"


def predicted(spark, sf):
    return read(spark, sf, "lineitem").withColumn("p", 1000 * F.col("l_quantity"))


@query("v4_regression_metrics", f"SELECT count(*) AS n, round(avg(abs(l_extendedprice - p)), 4) AS mae, round(avg((l_extendedprice - p) ** 2), 2) AS mse, round(sqrt(avg((l_extendedprice - p) ** 2)), 4) AS rmse, round(1 - avg((l_extendedprice - p) ** 2) / var_pop(l_extendedprice), 6) AS r2 FROM {PREDICTED}")
def regression_metrics(spark, sf):
    m = V.regression_metrics(predicted(spark, sf), "l_extendedprice", "p")
    return m.select("n", F.round("mae", 4).alias("mae"), F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@query("v5_residuals", f"SELECT {KEY}, round(l_extendedprice - 1000 * l_quantity, 6) AS residual FROM lineitem")
def residuals(spark, sf):
    return rounded(predicted(spark, sf).select(*LINE_KEY, (F.col("l_extendedprice") - F.col("p")).alias("residual")))


CALLED = "(SELECT *, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS p FROM lineitem)"


def called(spark, sf):
    q = F.col("l_quantity")
    return read(spark, sf, "lineitem").withColumn("p", F.when(q < 17, "A").when(q < 34, "N").otherwise("R"))


@query("v6_accuracy", f"SELECT count(*) AS n, round(avg((l_returnflag = p)::int), 6) AS accuracy FROM {CALLED}")
def accuracy(spark, sf):
    return rounded(V.accuracy(called(spark, sf), "l_returnflag", "p"))


@query("v6_class_report", f"WITH c AS (SELECT k AS class, count(CASE WHEN l_returnflag = k AND p = k THEN 1 END) AS h, count(CASE WHEN l_returnflag = k THEN 1 END) AS s, count(CASE WHEN p = k THEN 1 END) AS q FROM {CALLED}, (VALUES ('A'), ('N'), ('R')) t(k) GROUP BY k) SELECT class, s AS support, round(h / q, 6) AS precision, round(h / s, 6) AS recall, round(2 * h / (s + q), 6) AS f1 FROM c")
def class_report(spark, sf):
    return rounded(V.class_report(called(spark, sf), "l_returnflag", "p"))


@query("v7_confusion", f"SELECT l_returnflag AS actual, p AS predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share FROM {CALLED} GROUP BY 1, 2")
def confusion(spark, sf):
    return rounded(V.confusion(called(spark, sf), "l_returnflag", "p"))


def scored(spark, sf):
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select("quality", "n_chars")


SCORED = "(SELECT quality, n_chars FROM documents JOIN labels USING (doc_id))"


@query("v8_auc", f"WITH r AS (SELECT quality, rank() OVER (ORDER BY n_chars) AS lo, count(*) OVER (PARTITION BY n_chars) AS t FROM {SCORED}), s AS (SELECT sum(quality)::bigint AS n_pos, sum(1 - quality)::bigint AS n_neg, sum(CASE WHEN quality = 1 THEN lo + (t - 1) / 2 END) AS r FROM r) SELECT n_pos, n_neg, round((r - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) AS auc FROM s")
def auc(spark, sf):
    return rounded(V.auc(scored(spark, sf), "quality", "n_chars"))


CURVE = f"WITH g AS (SELECT n_chars::double AS threshold, sum(quality)::bigint AS pos, sum(1 - quality)::bigint AS neg FROM {SCORED} GROUP BY 1), c AS (SELECT threshold, (sum(pos) OVER w)::bigint AS tp, (sum(neg) OVER w)::bigint AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY threshold DESC))"


@query("v8_roc", f"{CURVE} SELECT threshold, tp, fp, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr FROM c")
def roc(spark, sf):
    return rounded(V.curves(scored(spark, sf), "quality", "n_chars").drop("precision"))


@query("v9_precision_recall", f"{CURVE} SELECT threshold, round(tp / p, 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM c")
def precision_recall(spark, sf):
    return rounded(V.curves(scored(spark, sf), "quality", "n_chars").select("threshold", F.col("tpr").alias("recall"), "precision"))


LINEAR = {"l_quantity": 2.0, "l_discount": -30.0, "l_tax": 5.0}
PHI = " UNION ALL ".join(f"SELECT {KEY}, '{c}' AS feature, {c} AS value, {w} * ({c} - avg({c}) OVER ()) AS phi FROM lineitem" for c, w in LINEAR.items())


def phi(spark, sf):
    return X.linear_shap(read(spark, sf, "lineitem"), LINEAR, LINE_KEY)


# To the seventh digit: means of so few decimals put no value halfway between two numbers of seven digits, as they do at six.
@query("x2_linear_shap", f"SELECT {KEY}, feature, round(value, 7) AS value, round(phi, 7) AS phi FROM ({PHI})")
def linear_shap(spark, sf):
    return rounded(phi(spark, sf), 7)


@query("x4_coalition_shap", "SELECT p_partkey, feature, round(value, 4) AS value, round(phi, 4) AS phi FROM (SELECT p_partkey, 'p_size' AS feature, p_size::double AS value, 3 * (p_size - avg(p_size) OVER ()) + (p_size - avg(p_size) OVER ()) * (p_retailprice + avg(p_retailprice) OVER ()) / 2 AS phi FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice, (p_retailprice - avg(p_retailprice) OVER ()) * (p_size + avg(p_size) OVER ()) / 2 FROM part)")
def coalition_shap(spark, sf):
    # A model with an interaction: 3 * size + size * price.
    model = lambda d: d.withColumn("prediction", 3 * F.col("p_size") + F.col("p_size") * F.col("p_retailprice"))
    return rounded(X.coalition_shap(read(spark, sf, "part"), ("p_size", "p_retailprice"), model, "p_partkey"), 4)


@query("x5_global_importance", f"SELECT feature, round(avg(abs(phi)), 6) AS importance FROM ({PHI}) GROUP BY 1")
def global_importance(spark, sf):
    return rounded(X.global_importance(phi(spark, sf)))


def order_phi(spark, sf):
    return X.linear_shap(read(spark, sf, "part"), {"p_size": 2.0, "p_retailprice": 0.5}, ("p_partkey",))


ORDER_PHI = "(SELECT p_partkey, 'p_size' AS feature, p_size::double AS value, 2 * (p_size - avg(p_size) OVER ()) AS phi FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice, 0.5 * (p_retailprice - avg(p_retailprice) OVER ()) FROM part)"


@query("x7_waterfall", f"SELECT p_partkey, feature, round(phi, 5) AS phi, row_number() OVER w AS step, round(10 + sum(phi) OVER w, 5) AS reached FROM {ORDER_PHI} WINDOW w AS (PARTITION BY p_partkey ORDER BY abs(phi) DESC, feature ROWS UNBOUNDED PRECEDING)")
def waterfall(spark, sf):
    return rounded(X.waterfall(order_phi(spark, sf), 10.0, ("p_partkey",)), 5).withColumn("step", F.col("step").cast("long"))


@query("x8_dependence", f"SELECT a.p_partkey, a.value, round(a.phi, 6) AS phi, b.value AS other_value FROM {ORDER_PHI} a JOIN {ORDER_PHI} b USING (p_partkey) WHERE a.feature = 'p_size' AND b.feature = 'p_retailprice'")
def dependence(spark, sf):
    return rounded(X.dependence(order_phi(spark, sf), "p_size", "p_retailprice", ("p_partkey",)))


@query("m1_least_squares", "SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem")
def least_squares(spark, sf):
    w = P.least_squares(read(spark, sf, "lineitem"), ("l_quantity",), "l_extendedprice")
    return spark.createDataFrame([tuple(round(x, 4) for x in w)], "intercept double, slope double")


SUBSETS = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


def _det(cells: list[list[str]]) -> str:
    """The determinant as a sum over permutations."""
    n, terms = len(cells), []
    for p in itertools.permutations(range(n)):
        odd = sum(p[i] > p[j] for i in range(n) for j in range(i + 1, n)) % 2
        terms.append(f"{'-' if odd else '+'} {' * '.join(cells[i][p[i]] for i in range(n))}")
    return f"({' '.join(terms)})"


def _r2_sql(features: tuple[str, ...]) -> str:
    """(mask, r2) of least squares on every subset of the features: one less the ratio of two determinants of correlations."""
    names = [*features, "l_extendedprice"]
    r = {(i, j): "1.0::double" if i == j else f"r{min(i, j)}_{max(i, j)}" for i in range(len(names)) for j in range(len(names))}
    pairs = ", ".join(f"corr({names[i]}, {names[j]}) AS r{i}_{j}" for i in range(len(names)) for j in range(i + 1, len(names)))
    one = []
    for mask in range(1, 1 << len(features)):
        own = [i for i in range(len(features)) if mask >> i & 1]
        at = [*own, len(features)]
        one.append(f"SELECT {mask} AS mask, '{','.join(features[i] for i in own)}' AS subset, 1 - {_det([[r[i, j] for j in at] for i in at])} / {_det([[r[i, j] for j in own] for i in own])} AS r2 FROM c")
    return f"c AS (SELECT {pairs} FROM lineitem), s AS ({' UNION ALL '.join(one)})"


def _steps_sql(features: tuple[str, ...], forward: bool) -> str:
    """Greedy steps, each the best subset that differs from the one before by one feature; ties by name."""
    named = f"(VALUES {', '.join(f'({1 << i}, {f!r})' for i, f in enumerate(features))}) f(bit, feature)"
    full = (1 << len(features)) - 1
    sql, before = f"WITH {_r2_sql(features)}, t0 AS (SELECT 0 AS step, {0 if forward else full} AS mask, '' AS feature, 0.0::double AS r2)", "t0"
    steps = len(features) if forward else len(features) - 1
    for k in range(1, steps + 1):
        moved, free = ("t.mask | bit", "t.mask & bit = 0") if forward else ("t.mask - bit", "t.mask & bit > 0")
        sql += f", t{k} AS (SELECT {k} AS step, s.mask, f.feature, s.r2 FROM {before} t, {named}, s WHERE {free} AND s.mask = {moved} ORDER BY s.r2 DESC, f.feature LIMIT 1)"
        before = f"t{k}"
    return sql + " " + " UNION ALL ".join(f"SELECT step::int AS step, feature, round(r2, 6) AS r2 FROM t{k}" for k in range(1, steps + 1))


@query("f9_exhaustive_all", f"WITH {_r2_sql(SUBSETS[:3])} SELECT subset, round(r2, 6) AS r2 FROM s")
def exhaustive_all(spark, sf):
    features = ("l_quantity", "l_discount", "l_tax")
    found = S.exhaustive(features, S.least_squares_score(read(spark, sf, "lineitem").select(*features, "l_extendedprice"), features, "l_extendedprice"))
    return spark.createDataFrame([(",".join(s), round(r, 6)) for s, r in found], "subset string, r2 double")


def _stepwise(spark, sf, forward: bool):
    score = S.least_squares_score(read(spark, sf, "lineitem").select(*SUBSETS, "l_extendedprice"), SUBSETS, "l_extendedprice")
    steps = S.sequential(SUBSETS, score, forward)
    return rounded(spark.createDataFrame([(i + 1, f, r) for i, (f, r) in enumerate(steps)], "step int, feature string, r2 double"))


@query("f7_forward", _steps_sql(SUBSETS, True))
def forward(spark, sf):
    return _stepwise(spark, sf, True)


@query("f7_backward", _steps_sql(SUBSETS, False))
def backward(spark, sf):
    return _stepwise(spark, sf, False)


# What is left without either of the two that are nearly the same, by R squared of two features.
@query(
    "f6_drop_by_model",
    """WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS qy, corr(l_quantity + 10 * l_tax, l_extendedprice) AS cy, corr(l_discount, l_extendedprice) AS dy, corr(l_quantity, l_discount) AS qd, corr(l_quantity + 10 * l_tax, l_discount) AS cd FROM lineitem),
    s AS (SELECT (qy * qy + dy * dy - 2 * qy * dy * qd) / (1 - qd * qd) AS without_c, (cy * cy + dy * dy - 2 * cy * dy * cd) / (1 - cd * cd) AS without_q FROM r)
    SELECT 'l_quantity' AS feature, without_q < without_c AS kept, CASE WHEN without_q >= without_c THEN 'nearly_quantity' END AS dropped_for, CASE WHEN without_q >= without_c THEN round(without_q, 6) END AS score_without FROM s
    UNION ALL SELECT 'nearly_quantity', without_c <= without_q, CASE WHEN without_c > without_q THEN 'l_quantity' END, CASE WHEN without_c > without_q THEN round(without_c, 6) END FROM s UNION ALL SELECT 'l_discount', true, NULL, NULL""",
)
def drop_by_model(spark, sf):
    features = ("l_quantity", "nearly_quantity", "l_discount")
    x = read(spark, sf, "lineitem").withColumn("nearly_quantity", F.col("l_quantity") + 10 * F.col("l_tax")).select(*features, "l_extendedprice")
    return rounded(S.drop_correlated_by_model(x, features, S.least_squares_score(x, features, "l_extendedprice")))


def training(spark, sf):
    x = read(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity", "l_discount", "l_returnflag", "l_extendedprice", (F.col("l_extendedprice") > 50000).cast("int").alias("dear"))
    return x


def _fitted(spark, sf, model: str, task: str, target: str, **parameters):
    x = training(spark, sf)
    own = hash_percent(*[F.col(k) for k in LINE_KEY], seed=3) < 80
    return x, own, M.fit(x.where(own), ("l_quantity", "l_discount", "l_returnflag"), target, model, task, **parameters)


# The plane through the training rows, by covariances.
PLANE = f"""t AS (SELECT *, ('0x' || substr(md5('3|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), 1, 8))::bigint % 100 < 80 AS own FROM lineitem),
    m AS (SELECT covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_discount, l_discount) AS bb, covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS byy, avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my FROM t WHERE own),
    w AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM m)"""


def _plane(spark, sf):
    x = training(spark, sf)
    own = hash_percent(*[F.col(k) for k in LINE_KEY], seed=3) < 80
    return x, own, M.fit(x.where(own), ("l_quantity", "l_discount"), "l_extendedprice", "linear", "regression")


@query("r1_predictions", f"WITH {PLANE} SELECT {KEY}, round(my + wa * (l_quantity - ma) + wb * (l_discount - mb), 3) AS prediction FROM t, w WHERE NOT own")
def predictions(spark, sf):
    x, own, fitted = _plane(spark, sf)
    return rounded(M.predict(fitted, x.where(~own)).select(*LINE_KEY, "prediction"), 3)


@query("r2_what_if", f"WITH {PLANE} SELECT change::int AS change, q AS l_quantity, d AS l_discount, round(my + wa * (q - ma) + wb * (d - mb), 3) AS prediction FROM w, (VALUES (0, 10.0::double, 0.05::double), (1, 20.0, 0.05), (2, 10.0, 0.0)) c(change, q, d)")
def what_if(spark, sf):
    x, _, fitted = _plane(spark, sf)
    return rounded(M.what_if(fitted, x, {"l_quantity": 10.0, "l_discount": 0.05}, ({}, {"l_quantity": 20.0}, {"l_discount": 0.0})), 3)


PART_PLANE = """m AS (SELECT covar_pop(p_size, p_size) AS aa, covar_pop(k, k) AS bb, covar_pop(p_size, k) AS ab, covar_pop(p_size, p_retailprice) AS ay, covar_pop(k, p_retailprice) AS byy, avg(p_size) AS ma, avg(k) AS mb FROM p),
    w AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM m)"""


def _parts(spark, sf, model: str, **parameters):
    x = read(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), (F.col("p_partkey") % 1000).cast("double").alias("k"), "p_type", "p_retailprice")
    features = ("p_size", "k") if model == "linear" else ("p_size", "k", "p_type")
    return x, features, M.fit(x, features, "p_retailprice", model, "regression", **parameters)


@query("x1_explain_linear", f"WITH p AS (SELECT *, (p_partkey % 1000)::double AS k FROM part), {PART_PLANE} SELECT p_partkey, 'p_size' AS feature, p_size::double AS value, round(wa * (p_size - ma), 5) + 0.0 AS phi FROM p, w UNION ALL SELECT p_partkey, 'k', k, round(wb * (k - mb), 5) + 0.0 FROM p, w")
def explain_linear(spark, sf):
    x, features, fitted = _parts(spark, sf, "linear")
    return rounded(X.explain(fitted, x, features, ("p_partkey",)), 5)


@query("x3_tree_shap")
def tree_shap(spark, sf):
    x, features, fitted = _parts(spark, sf, "forest", numTrees=5, maxDepth=4, seed=1)
    return rounded(X.explain(fitted, x, features, ("p_partkey",)))


for _task, _target in (("regression", "l_extendedprice"), ("classification", "dear")):
    for _model in M.AVAILABLE[_task]:

        @query(f"m_{_task}_{_model}")
        def trained(spark, sf, model=_model, task=_task, target=_target):
            small = {"forest": {"numTrees": 10, "seed": 1}, "boosting": {"maxIter": 5, "seed": 1}, "neural": {"maxIter": 20, "seed": 1}}.get(model, {})
            x, own, fitted = _fitted(spark, sf, model, task, target, **small)
            return rounded(M.predict(fitted, x.where(~own)).select(*LINE_KEY, F.col("prediction").cast("double")))


@query("f1_importances")
def importances(spark, sf):
    x, _, fitted = _fitted(spark, sf, "forest", "regression", "l_extendedprice", numTrees=10, seed=1)
    return rounded(M.importances(fitted, x))


@query("h1_grid_search")
def grid_search(spark, sf):
    return M.cross_validate(training(spark, sf), LINE_KEY, ("l_quantity", "l_discount"), "l_extendedprice", "linear", "regression", M.grid_search({"regParam": [0.0, 0.1]}), 2)


@query("r3_model_metadata")
def metadata(spark, sf):
    x, _, fitted = _fitted(spark, sf, "linear", "regression", "l_extendedprice")
    return M.describe_model(fitted, x)


VECTORS = "(SELECT vec_id, label, list_transform(embedding, lambda v: v::double) AS x FROM embeddings)"
DISTANCE = "sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) ** 2)))"


def vectors(spark, sf):
    return read(spark, sf, "embeddings")


@query("c1_assign", f"WITH c AS (SELECT unnest(range(0, 4)) AS i), d AS (SELECT vec_id, i, list_sum(list_transform(x, lambda v, k: (v - (CASE WHEN (k - 1) % 4 = i THEN 0.2 ELSE 0 END)) ** 2)) AS d FROM {VECTORS}, c) SELECT vec_id, arg_min(i, d)::int AS cluster, round(min(d), 6) AS squared_distance FROM d GROUP BY 1")
def assign(spark, sf):
    centres = [[0.2 if k % 4 == i else 0.0 for k in range(64)] for i in range(4)]
    return rounded(C.assign(vectors(spark, sf), "embedding", centres).select("vec_id", "cluster", "squared_distance"))


@query("c1_kmeans")
def kmeans(spark, sf):
    v = vectors(spark, sf)
    return C.fit(v, "embedding", "kmeans", 10).transform(C.with_features(v, "embedding")).select("vec_id", F.col("prediction").alias("cluster"))


@query("c7_gaussian_mixture")
def gaussian_mixture(spark, sf):
    v = vectors(spark, sf)
    return C.fit(v, "embedding", "gaussian_mixture", 3).transform(C.with_features(v, "embedding")).select("vec_id", F.col("prediction").alias("cluster"))


@query("c2_core_points", f"SELECT a.vec_id, count(*) AS n_neighbours FROM {VECTORS} a JOIN {VECTORS} b ON a.vec_id <> b.vec_id AND {DISTANCE} <= 1.2 GROUP BY 1 HAVING count(*) >= 4")
def core_points(spark, sf):
    return C.core_points(vectors(spark, sf), "vec_id", "embedding", 1.2)


@query(
    "c2_dbscan",
    f"""WITH RECURSIVE l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM {VECTORS} a JOIN {VECTORS} b ON a.vec_id <> b.vec_id AND {DISTANCE} <= 1.15),
    c AS (SELECT a FROM l GROUP BY a HAVING count(*) >= 4), k AS (SELECT l.* FROM l JOIN c USING (a) WHERE b IN (SELECT a FROM c)),
    r(a, b) AS (SELECT a, a FROM c UNION SELECT r.a, k.b FROM r JOIN k ON k.a = r.b), m AS (SELECT a, min(b) AS m FROM r GROUP BY a),
    e AS (SELECT l.b AS a, min(m.m) AS m FROM l JOIN m USING (a) GROUP BY 1)
    SELECT vec_id, coalesce(m.m, e.m) AS cluster, m.m IS NOT NULL AS is_core FROM embeddings LEFT JOIN m ON m.a = vec_id LEFT JOIN e ON e.a = vec_id""",
)
def dbscan(spark, sf):
    return C.dbscan(vectors(spark, sf), "vec_id", "embedding", 1.15)


@query("c10_silhouette", f"WITH d AS (SELECT a.vec_id, a.label AS own, b.label AS other, avg({DISTANCE}) AS d FROM {VECTORS} a JOIN {VECTORS} b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3), s AS (SELECT vec_id, own AS label, max(CASE WHEN own = other THEN d END) AS a, min(CASE WHEN own <> other THEN d END) AS b FROM d GROUP BY 1, 2) SELECT vec_id, label::bigint AS label, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM s")
def silhouette(spark, sf):
    return rounded(C.silhouette(vectors(spark, sf), "vec_id", "embedding", "label"))


@query(
    "c10_centroid_indices",
    f"""WITH p AS (SELECT vec_id, label, unnest(x) AS v, unnest(range(len(x))) AS d FROM {VECTORS}), c AS (SELECT label, d, avg(v) AS c, count(*) AS n FROM p GROUP BY 1, 2), g AS (SELECT d, avg(v) AS m FROM p GROUP BY 1),
    o AS (SELECT vec_id, p.label, sum((v - c) ** 2) AS d2 FROM p JOIN c USING (label, d) GROUP BY 1, 2), s AS (SELECT label, sum(d2) AS inside, avg(sqrt(d2)) AS scatter, count(*) AS n FROM o GROUP BY 1),
    b AS (SELECT sum(n * (c - m) ** 2) AS between_ FROM c JOIN g USING (d)), gaps AS (SELECT a.label AS i, e.label AS j, sqrt(sum((a.c - e.c) ** 2)) AS gap FROM c a JOIN c e ON a.d = e.d AND a.label <> e.label GROUP BY 1, 2),
    worst AS (SELECT i, max((x.scatter + y.scatter) / gap) AS r FROM gaps JOIN s x ON x.label = i JOIN s y ON y.label = j GROUP BY 1), k AS (SELECT count(*) AS k, sum(n) AS n, sum(inside) AS inside FROM s)
    SELECT k::int AS n_clusters, round(between_ / (k - 1) / (inside / (n - k)), 6) AS calinski_harabasz, round((SELECT avg(r) FROM worst), 6) AS davies_bouldin FROM k, b""",
)
def centroid_indices(spark, sf):
    return rounded(C.centroid_indices(vectors(spark, sf), "embedding", "label"))


@query("c11_k_distance", f"SELECT vec_id, round(d, 6) AS k_distance FROM (SELECT a.vec_id, {DISTANCE} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DISTANCE}, b.vec_id) AS k FROM {VECTORS} a JOIN {VECTORS} b ON a.vec_id <> b.vec_id) WHERE k = 4")
def k_distance(spark, sf):
    return rounded(C.k_distances(vectors(spark, sf), "vec_id", "embedding", 4))


@query("c11_inertia")
def inertia(spark, sf):
    return rounded(C.inertia(vectors(spark, sf), "embedding", (2, 4, 8)), 4)


_CENTRES = [[0.2 if k % 4 == i else 0.0 for k in range(64)] for i in range(4)]
_ASSIGNED = f"WITH c AS (SELECT unnest(range(0, 4)) AS i), d AS (SELECT vec_id, i, list_sum(list_transform(x, lambda v, k: (v - (CASE WHEN (k - 1) % 4 = i THEN 0.2 ELSE 0 END)) ** 2)) AS d FROM {VECTORS}, c), a AS (SELECT vec_id, arg_min(i, d)::int AS cluster, min(d) AS squared_distance FROM d GROUP BY 1)"


@query("c11_inertia_of_centres", f"{_ASSIGNED} SELECT 4 AS k, round(sum(squared_distance), 5) AS inertia FROM a")
def inertia_of_centres(spark, sf):
    return rounded(C.inertia_of(vectors(spark, sf), "embedding", _CENTRES), 5)


@query("c12_preview", f"{_ASSIGNED} SELECT vec_id, cluster, round(squared_distance, 6) AS squared_distance FROM a ORDER BY md5(vec_id::varchar), vec_id LIMIT 20")
def cluster_preview(spark, sf):
    return rounded(C.preview(vectors(spark, sf), "embedding", "vec_id", _CENTRES, 20))


@query("c16_interpret", " UNION ALL ".join(f"SELECT l_returnflag AS cluster, count(*) AS n, '{c}' AS column_name, round(avg({c}), 4) AS mean, round(max(m), 4) AS overall, round((avg({c}) - max(m)) / max(s), 6) AS shift FROM lineitem, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM lineitem) GROUP BY 1" for c in ("l_quantity", "l_discount")))
def interpret(spark, sf):
    x = C.interpret(read(spark, sf, "lineitem"), "l_returnflag", ("l_quantity", "l_discount"))
    return x.select("cluster", "n", "column_name", F.round("mean", 4).alias("mean"), F.round("overall", 4).alias("overall"), (F.round("shift", 6) + 0.0).alias("shift"))


@query("c4_power_iteration")
def power_iteration(spark, sf):
    return C.power_iteration(vectors(spark, sf), "vec_id", "embedding", 4)


@query("c14_principal_components")
def principal_components(spark, sf):
    return rounded(C.principal_components(vectors(spark, sf), "vec_id", "embedding", 2))


@query("v3_nested_cross_validation")
def nested(spark, sf):
    return M.nested_cross_validate(training(spark, sf), LINE_KEY, ("l_quantity", "l_discount"), "l_extendedprice", "linear", "regression", M.grid_search({"regParam": [0.0, 0.1]}), 2, 2)


@query("h2_random_search")
def random_search(spark, sf):
    return M.cross_validate(training(spark, sf), LINE_KEY, ("l_quantity", "l_discount"), "l_extendedprice", "linear", "regression", M.random_search({"regParam": [0.0, 0.1, 0.5], "elasticNetParam": [0.0, 0.5]}, 2, 1), 2)


@query("a4_forest_surrogate")
def forest_surrogate(spark, sf):
    x, own, fitted = _fitted(spark, sf, "forest", "regression", "l_extendedprice", numTrees=10, seed=1)
    return rounded(M.forest_surrogate(fitted, x.where(~own)).select(*LINE_KEY, "mu", "sigma"))


@query("o3_isolation")
def isolation(spark, sf):
    x = read(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rounded(isolation_scores(x, ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), LINE_KEY).select(*LINE_KEY, "isolation"))
