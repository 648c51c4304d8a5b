"""Edge cases and invariants of operators that no oracle covers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeworks.functions.joins import spread_join
from lodeworks.functions.quantiles import exact_quantiles
from lodeworks.functions.running import running
from lodeworks.operators import cluster, design, evaluate, explain, graph, isolation, model, neighbours, prepare, profile, project, select
from lodeworks.sources import tabular
from lodeworks.streaming import monitor

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def numbers(spark, values, name="x"):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], f"id long, {name} double")


@quick
@given(st.lists(st.floats(-1e300, 1e300, allow_nan=False), min_size=1, max_size=30))
def test_exact_quantiles_equal_numpy(spark, values):
    found = exact_quantiles(numbers(spark, [*values, None, math.nan]), {"x": (0, 0.25, 0.5, 0.9, 1)}, bins=8)["x"]
    ordered = sorted(values)
    for p, got in zip((0, 0.25, 0.5, 0.9, 1), found):
        at = p * (len(ordered) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert low <= got <= high and (low != high or got == low)


def test_exact_quantiles_of_ties_and_of_nothing(spark):
    df = numbers(spark, [5] * 1000 + [7]).withColumn("y", F.lit(None).cast("double"))
    assert exact_quantiles(df, {"x": (0.5, 1.0), "y": (0.5,)}) == {"x": [5.0, 7.0], "y": [None]}


def test_running_equals_a_loop_in_either_direction(spark):
    values = random.Random(1).sample(range(1000), 100)
    df = numbers(spark, values).withColumn("one", F.lit(1))
    up = {r["x"]: r["n"] for r in running(df, "x", {"n": (F.sum, "one")}, ranges=7).collect()}
    down = {r["x"]: r["m"] for r in running(df, "x", {"m": (F.max, "x")}, descending=True, ranges=7).collect()}
    for k, v in enumerate(sorted(values)):
        assert up[v] == (k or None)
        assert down[v] == (None if v == max(values) else max(values))


def test_empty_tables_pass_through(spark):
    empty = numbers(spark, [])
    fences = prepare.iqr_fences(empty, ("x",))
    assert prepare.drop_outliers(empty, fences).count() == 0
    assert prepare.impute(empty, ("x",), "mode").count() == 0
    assert prepare.fit_standard(empty, ("x",)).transform(empty).count() == 0
    assert prepare.cap(empty, ("x",)).count() == 0
    assert profile.describe(empty, ("x",)).first()["n"] == 0
    assert profile.histogram(empty, "x").count() == 0
    assert profile.duplicates(empty).first().asDict() == {"n_rows": 0, "n_distinct": 0, "n_duplicates": 0}
    assert profile.column_counts(empty, ("x",)).first()["missing_share"] is None
    assert design.pareto_front(empty, ("id", "min"), ("x", "min")).count() == 0


def test_missing_values_are_no_outliers_and_stay_missing(spark):
    df = numbers(spark, [1, 2, 3, 4, 100, None, math.nan])
    fences = prepare.iqr_fences(df, ("x",))
    assert prepare.count_outliers(df, fences).first()["n_outliers"] == 1
    assert prepare.drop_outliers(df, fences).count() == 6
    assert [r["x"] for r in prepare.fit_minmax(df, ("x",)).transform(df).orderBy("id").collect()][-2:] == [None, None]
    assert {r["x"] for r in prepare.impute(df, ("x",), "median").where("id > 4").collect()} == {3.0}


def test_constant_columns_scale_to_zero_and_restore(spark):
    df = numbers(spark, [4, 4, 4])
    for fit in (prepare.fit_standard, prepare.fit_minmax, prepare.fit_robust):
        scaler = fit(df, ("x",))
        assert {r["x"] for r in scaler.transform(df).collect()} == {0.0}
        assert {r["x"] for r in scaler.restore(scaler.transform(df)).collect()} == {4.0}


def test_mode_takes_the_smallest_of_ties(spark):
    assert prepare.mode(numbers(spark, [3, 1, 3, 1, 2]), "x") == 1.0


def test_iterative_imputation_finds_a_linear_relation(spark):
    rows = [(i, float(i), None if i % 4 == 0 else 2.0 * i + 1) for i in range(40)]
    out = prepare.impute_iterative(spark.createDataFrame(rows, "id long, a double, b double"), ("a", "b"), rounds=2)
    assert all(abs(r["b"] - (2 * r["a"] + 1)) < 1e-6 for r in out.collect())


def test_yeo_johnson_power_straightens_a_skewed_column(spark):
    values = np.random.default_rng(0).lognormal(size=400)
    assert abs(prepare.yeo_johnson_power(numbers(spark, np.log1p(values * 0) + values), "x")) < 1.5


def test_encoding_of_unseen_and_missing_categories(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b_c"), (3, None)], "id long, f string")
    e = prepare.Encoding.fit(df, ("f",))
    new = spark.createDataFrame([(1, "zz"), (2, None), (3, "a")], "id long, f string")
    assert [tuple(r)[1:] for r in e.one_hot(new).orderBy("id").collect()] == [(0, 0), (0, 0), (1, 0)]
    assert [r["f"] for r in e.labels(new).orderBy("id").collect()] == [None, None, 0]
    with pytest.raises(ValueError):
        prepare.Encoding.fit(df, ("f",), most=1)


def test_history_redo_is_cleared_by_a_new_step(spark):
    h = prepare.History(spark.range(3).toDF("id"))
    h.apply("a", lambda d: d.where("id > 0"))
    h.undo()
    h.apply("b", lambda d: d.where("id > 1"))
    assert h.redo().count() == 1 and h.log().count() == 3


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")


def test_nearest_equals_numpy_whatever_the_blocks(spark):
    x = np.random.default_rng(2).integers(0, 4, (60, 2)).astype(float)  # many ties
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for block in (7, 1000):
        got = {(r["id"], r["rank"]): (r["neighbour"], r["distance"]) for r in neighbours.nearest(vectors(spark, x), vectors(spark, x), "id", "v", 3, block).collect()}
        for i in range(len(x)):
            best = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:3]
            assert [(j, dist) for dist, j in best] == [got[i, k] for k in (1, 2, 3)]


def test_dbscan_of_two_chains_and_noise(spark):
    x = [[i * 0.9, 0] for i in range(8)] + [[i * 0.9, 50] for i in range(8)] + [[500, 500]]
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(vectors(spark, x), "id", "v", 1.0, 3, block=5).collect()}
    assert {got[i] for i in range(8)} == {got[0]} and {got[i] for i in range(8, 16)} == {got[8]} and got[0] != got[8] and got[16] is None


def test_components_of_a_star_leave_one_table(spark):
    from pathlib import Path

    from lodeworks.functions.storage import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.glob("lodeworks-links-*"))
    links = spark.range(1, 3000).selectExpr("0L AS a", "id AS b").union(spark.range(1).selectExpr("9001L AS a", "9000L AS b")).union(spark.sql("SELECT 5L, 5L")).union(spark.sql("SELECT CAST(NULL AS long), 5L"))
    got = {r["node"]: r["component"] for r in graph.components(links, "a", "b").collect()}
    assert len(set(folder.glob("lodeworks-links-*")) - before) == 1  # what the result reads
    assert got == {**{i: 0 for i in range(3000)}, 9000: 9000, 9001: 9000}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(links, "a", "b").collect()}
    assert {got[i] for i in range(51)} == {0} and got[101] == 100


def test_repeated_keys_of_a_join_are_not_broadcast(spark):
    many = spark.range(4000).selectExpr("id % 500 AS k", "id")
    few = spark.range(800).selectExpr("id % 400 AS k", "id AS m").groupBy("k").agg(F.min("m").alias("m"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        found = spread_join(many, few, ["k"], ["id"], how)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, many.join(few, "k", how).collect()))
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_centroid_indices_of_far_clusters(spark):
    x = [[0, 0], [0, 1], [100, 0], [100, 1]]
    df = vectors(spark, x).withColumn("label", (F.col("id") >= 2).cast("int"))
    r = cluster.centroid_indices(df, "v", "label").first()
    assert abs(r["davies_bouldin"] - 0.01) < 1e-9 and abs(r["calinski_harabasz"] - 20000) < 1e-6


def test_coalition_shap_sums_to_prediction_less_base(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i % 7)) for i in range(20)], "id long, a double, b double")
    score = lambda d: d.withColumn("prediction", F.col("a") * F.col("b") + F.sin("a"))
    total = explain.coalition_shap(df, ("a", "b"), score, "id").groupBy("id").agg(F.sum("phi").alias("s"))
    means = df.agg(F.avg("a").alias("a"), F.avg("b").alias("b")).first()
    base = means["a"] * means["b"] + math.sin(means["a"])
    for r in score(df).join(total, "id").collect():
        assert abs(r["s"] - (r["prediction"] - base)) < 1e-9


@quick
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=25))
def test_pareto_front_equals_a_double_loop(spark, points):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(points)], "id long, a int, b int")
    front = {i for i, (a, b) in enumerate(points) if not any(c <= a and d >= b and (c < a or d > b) for c, d in points)}
    assert {r["id"] for r in design.pareto_front(df, ("a", "min"), ("b", "max")).collect()} == front


def test_latin_hypercube_hits_every_stratum_once(spark):
    rows = design.latin_hypercube(spark, [design.Dimension("a", 0, 1), design.Dimension("b", 0, 1)], 300).collect()
    for name in "ab":
        assert sorted(round(r[name] * 300 - 0.5) for r in rows) == list(range(300))


def test_sobol_points_fill_every_cell(spark):
    rows = design.sobol(spark, ("a", "b", "c", "d", "e", "f"), 255).collect()
    for name in "abcdef":  # with the zero point, each of 256 cells holds one
        assert sorted({int(r[name] * 256) for r in rows} | {0}) == list(range(256))


def test_auc_of_ties_is_half_and_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, s double")
    assert evaluate.auc(df, "y", "s").first()["auc"] == 0.5
    assert evaluate.auc(df.where("y = 1"), "y", "s").first()["auc"] is None


def test_exhaustive_search_and_greedy_search_agree_on_the_best(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=(3, 200))
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, 3 * a - b)], "a double, b double, c double, y double")
    score = select.least_squares_score(df, ("a", "b", "c"), "y")
    assert set(select.exhaustive(("a", "b", "c"), score)[0][0]) >= {"a", "b"}
    assert [f for f, _ in select.sequential(("a", "b", "c"), score)][:2] == ["a", "b"]
    assert select.sequential(("a", "b", "c"), score, forward=False, size=2)[0][0] == "c"
    with pytest.raises(ValueError):
        select.exhaustive([f"f{i}" for i in range(16)], score)


def test_pipeline_survives_missing_and_unseen_and_is_saved(spark, tmp_path):
    rows = [(i, float(i) if i % 5 else None, "ab"[i % 2], i % 3 == 0, 2.0 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, c string, f boolean, y double")
    fitted = model.pipeline(df, ("x", "c", "f"), "y", "linear", "regression").fit(df)
    model.save(fitted, str(tmp_path / "model"))
    new = spark.createDataFrame([(1, None, "new", True, 0.0)], df.schema)
    again = model.predict(model.load(str(tmp_path / "model")), new).first()["prediction"]
    assert again == model.predict(fitted, new).first()["prediction"] and not math.isnan(again)


def test_project_versions(spark, tmp_path):
    p = project.Project(spark, str(tmp_path / "p"))
    assert p.history().count() == 0
    assert p.snapshot(spark.range(3).toDF("id"), "t") == 1 and p.snapshot(spark.range(5).toDF("id"), "t", "more") == 2
    assert p.restore("t", 1).count() == 3 and p.restore("t").count() == 5 and p.history().count() == 2


def test_structures_and_atoms(spark, tmp_path):
    (tmp_path / "q1.cif").write_text("data_quartz\n_cell_length_a 4.9\n_cell_length_b 4.9\n_cell_length_c 5.4\n_cell_angle_alpha 90\n")
    r = tabular.read_structures(spark, str(tmp_path)).first()
    assert r["cif_id"] == "q1" and r["name"] == "quartz" and r["lengths"] == [4.9, 4.9, 5.4] and r["angles"] == [90.0, None, None]
    df = spark.createDataFrame([('{"elements": ["Si", "O"], "cartesian": false}',), ("no json",), (None,)], "atoms string")
    assert [r["atoms"]["elements"] if r["atoms"] else None for r in tabular.parse_json(df, "atoms").collect()] == [["Si", "O"], None, None]


def test_usage_over_a_stream_equals_the_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    batch = monitor.usage(events, "ts", "event_type", "value", "1 day")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = monitor.usage(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "event_type", "value", "1 day", "40 days")
    q = stream.writeStream.format("memory").queryName("usage_out").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r[0], r[1]): r[2] for r in spark.table("usage_out").collect()} == {(r[0], r[1]): r[2] for r in batch.collect()}


def test_isolated_rows_score_highest_in_any_partitioning(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))] + [(300, 12.0, 12.0), (301, None, 1.0), (302, 12.0, -12.0), (303, 12.0, -12.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {r["id"]: r["isolation"] for r in isolation.isolation_scores(df.repartition(3), ("a", "b"), ("id",)).collect()}
    again = {r["id"]: r["isolation"] for r in isolation.isolation_scores(df.coalesce(1), ("a", "b"), ("id",)).collect()}
    assert got == again and got[301] is None and got[302] == got[303]
    ranked = sorted((i for i in got if got[i] is not None), key=lambda i: -got[i])
    assert {300, 302, 303} <= set(ranked[:8])
    assert isolation.isolation_scores(df.limit(0), ("a", "b")).count() == 0


def test_nested_search_and_forest_spread(spark):
    rows = [(i, float(i % 10), 3.0 * (i % 10)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    found = model.nested_cross_validate(df, ["id"], ("x",), "y", "linear", "regression", model.grid_search({"regParam": [0.0, 100.0]}), 2, 2)
    assert {r["parameters"] for r in found.collect()} == {"{'regParam': 0.0}"}
    fitted = model.pipeline(df, ("x",), "y", "forest", "regression", numTrees=5, seed=1).fit(df)
    out = model.forest_surrogate(fitted, df).join(model.predict(fitted, df).select("id", "prediction"), "id")
    assert out.where("abs(mu - prediction) > 1e-9 or sigma < 0").count() == 0


def test_zoom_search_reaches_the_optimum_within_bounds_and_constraints(spark):
    space = [design.Dimension("a", 0, 1), design.Dimension("b", 0, 1), design.Dimension("k", 1, 6, "integer"), design.Dimension("c", kind="categorical", categories=("x", "y"))]
    score = lambda d: d.withColumn("prediction", F.col("a") * F.col("b") - F.abs(F.col("k") - 4) + (F.col("c") == "y").cast("int"))
    best, trace = design.zoom_search(spark, space, score, [F.col("a") + F.col("b") - 1], pool=2000)
    r = best.first()
    assert abs(r["a"] - 0.5) < 0.05 and abs(r["b"] - 0.5) < 0.05 and r["k"] == 4 and r["c"] == "y" and r["a"] + r["b"] <= 1
    steps = [t["best"] for t in trace.orderBy("generation").collect()]
    assert steps == sorted(steps) and len(steps) == 4
    none, trace = design.zoom_search(spark, space, score, [F.lit(1.0)], pool=10, rounds=2)
    assert none.count() == 0 and [t["best"] for t in trace.collect()] == [None, None]
    assert design.zoom_search(spark, space, score, stop=lambda: True)[1].count() == 0


def test_one_column_for_each_model(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(20)], "id long, x double, y double")
    one = model.pipeline(df, ("x",), "y", "linear", "regression").fit(df)
    out = model.objectives(df, {"first": one, "second": one})
    assert out.columns == [*df.columns, "first", "second"] and out.where("first <> second").count() == 0


def test_least_squares_counts_columns_of_any_size(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1e5, 200), rng.normal(0, 1e-3, 200)
    y = 2 * a + 3e7 * b + 5
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, y)], "a double, b double, y double")
    assert np.allclose(prepare.least_squares(df, ("a", "b"), "y"), [5, 2, 3e7], rtol=1e-6)
    assert select.least_squares_score(df, ("a", "b"), "y")(("a", "b")) > 1 - 1e-9


def test_tree_shap_equals_coalitions_and_adds_up(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.integers(0, 5)), float(rng.normal()), "xyz"[i % 3]) for i in range(300)]
    rows = [(*r, r[1] * r[2] + (2.0 if r[3] == "x" else 0.0)) for r in rows]
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, y double").withColumn("up", (F.col("y") > 0.5).cast("double"))
    features = ("a", "b", "c")
    for name, task, target in (("tree", "regression", "y"), ("forest", "regression", "y"), ("boosting", "regression", "y"), ("forest", "classification", "up")):
        more = {"forest": {"numTrees": 3, "maxDepth": 3, "seed": 1}, "boosting": {"maxIter": 2, "maxDepth": 2, "seed": 1}, "tree": {"maxDepth": 3}}[name]
        fitted = model.fit(df, features, target, name, task, **more)
        assert explain.explainer_of(fitted) == "tree"
        phi = explain.tree_shap(fitted, df, features, ("id",)).groupBy("id").agg(F.sum("phi").alias("phi"))
        base = explain.mean_prediction(fitted, df)
        if task == "regression":
            told = model.predict(fitted, df).select("id", "prediction")
        else:
            from pyspark.ml.functions import vector_to_array

            told = fitted.transform(df).select("id", vector_to_array("probability")[1].alias("prediction"))
        assert told.join(phi, "id").where(F.abs(F.col("prediction") - base - F.col("phi")) > 1e-9).count() == 0


def test_explainers_by_model_what_if_and_parallel_evaluation(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, float(rng.normal()), float(rng.normal()), "ab"[i % 2]) for i in range(120)], "id long, a double, b double, c string").withColumn("y", 3 * F.col("a") - F.col("b") + F.when(F.col("c") == "a", 1.0).otherwise(0.0)).withColumn("up", (F.col("y") > 0).cast("double"))
    linear = model.fit(df, ("a", "b", "c"), "y", "linear", "regression")
    neural = model.fit(df, ("a", "b"), "up", "neural", "classification", hidden=(4,), maxIter=20, seed=1)
    assert [explain.explainer_of(m) for m in (linear, neural)] == ["linear", "coalition"]
    phi = explain.explain(linear, df, ("a", "b", "c"), ("id",)).groupBy("id").agg(F.sum("phi").alias("phi"))
    mean = df.agg(F.avg("y")).first()[0]
    assert model.predict(linear, df).join(phi, "id").where(F.abs(F.col("prediction") - mean - F.col("phi")) > 1e-4).count() == 0
    assert explain.explain(neural, df, ("a", "b"), ("id",)).count() == 240
    answers = model.what_if(linear, df, {"a": 1.0, "b": 0.0, "c": "a"}, ({}, {"a": 2.0}, {"c": "b"})).orderBy("change").collect()
    assert np.allclose([r["prediction"] for r in answers], [4, 7, 3], atol=1e-4)
    grid = model.grid_search({"regParam": [0.0, 0.5]})
    one, four = (model.cross_validate(df, ("id",), ("a", "b"), "y", "linear", "regression", grid, 2, parallel=p).collect() for p in (1, 4))
    assert [r[:2] for r in one] == [r[:2] for r in four] and np.allclose([r[2] for r in one], [r[2] for r in four]) and len(one) == 4


def test_correlated_features_go_by_what_the_model_loses(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=300)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, a + rng.normal(0, 0.05, 300), rng.normal(size=300), 2 * a)], "a double, near double, c double, y double")
    features = ("a", "near", "c")
    found = {r["feature"]: (r["kept"], r["dropped_for"]) for r in select.drop_correlated_by_model(df, features, select.least_squares_score(df, features, "y")).collect()}
    assert found == {"a": (True, None), "near": (False, "a"), "c": (True, None)}
    with pytest.raises(ValueError):
        select.roles(df, ("a",), ("a",))
    chosen, table = select.roles(df, ("c", "a"), ("y",))
    assert chosen.columns == ["c", "a", "y"] and {r["column_name"]: r["role"] for r in table.collect()} == {"c": "feature", "a": "feature", "y": "target"}


def test_pareto_front_of_three_objectives(spark):
    rng = np.random.default_rng(7)
    rows = [(i, *map(float, rng.integers(0, 12, 3))) for i in range(400)] + [(900, None, 1.0, 1.0), (901, math.nan, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5)
    points = np.array([[r[1], -r[2], r[3]] for r in rows[:400]])
    want = {rows[i][0] for i in range(400) if not ((points <= points[i]).all(1) & (points < points[i]).any(1)).any()}
    got = design.pareto_front_of_many(df, (("a", "min"), ("b", "max"), ("c", "min")))
    assert {r["id"] for r in got.collect()} == want and got.columns == df.columns
    assert design.pareto_front_of_many(df.limit(0), (("a", "min"), ("b", "max"), ("c", "min"))).count() == 0


def test_project_state_and_deletion(spark, tmp_path):
    p = project.Project(spark, str(tmp_path / "p"))
    p.save_state({"features": ["a"], "depth": 3})
    p.save_state({"features": ["b"], "depth": 4})
    assert p.load_state() == {"features": ["b"], "depth": 4}
    for name in ("one", "two", "one"):
        p.snapshot(spark.range(3), name)
    p.delete("one")
    assert [r["name"] for r in p.history().collect()] == ["two"] and p.restore("two").count() == 3
    assert not (tmp_path / "p" / "data" / "one").exists()


def test_applied_configurations(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, 5.0), (3, 3.0, 7.0)], "id long, a double, b double")
    steps = spark.createDataFrame([("a", "impute mean"), ("b", "drop: constant"), ("zz", "keep")], "column_name string, action string")
    out = profile.apply_recommendations(df, steps)
    assert out.columns == ["id", "a"] and {r["id"]: r["a"] for r in out.collect()} == {1: 1.0, 2: 2.0, 3: 3.0}
    with pytest.raises(ValueError):
        profile.apply_recommendations(df, steps.withColumn("action", F.lit("what")))


def test_running_sums_over_many_ranges(spark):
    rng = np.random.default_rng(9)
    x = rng.permutation(np.concatenate([rng.normal(size=500), np.arange(400.0)]))
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(x)], "x double, n long")
    for ranges in (1, 7, 300):
        for down in (False, True):
            got = {r["x"]: r["before"] for r in running(df, "x", {"before": (F.sum, "n")}, descending=down, ranges=ranges).collect()}
            total, want = None, {}
            for i in sorted(range(len(x)), key=lambda i: -x[i] if down else x[i]):
                want[x[i]] = total
                total = (total or 0) + i
            assert got == want


def test_entry_leaves_the_llm_queries_out_without_their_libraries():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['xxhash'] = None\nimport __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, check=True)
    assert int(done.stdout.split()[0]) > 100 and done.stdout.split()[1] == "False"
