"""Explainers, isolation forests and gradient-fitted models against slower versions of themselves."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lodeworks.operators import design, evaluate, explain, gradient, isolation, model, select


def conditional_mean(nodes, x, slots, known, at=0):
    """The mean of a tree over training rows that agree with a row in the known features: its own branch there, both by their rows elsewhere."""
    value, _, left, right, feature, threshold, categories = nodes[at]
    if left < 0:
        return value
    if known >> slots[feature] & 1:
        return conditional_mean(nodes, x, slots, known, left if (x[feature] in categories if threshold is None else x[feature] <= threshold) else right)
    n, m = nodes[left][1], nodes[right][1]
    return (conditional_mean(nodes, x, slots, known, left) * n + conditional_mean(nodes, x, slots, known, right) * m) / (n + m)


def random_tree(rng, slots, depth, n=1000):
    nodes = []

    def grow(n, depth):
        at = len(nodes)
        nodes.append(None)
        if depth == 0 or n < 4 or rng.random() < 0.1:
            nodes[at] = (float(rng.normal()), n, -1, -1, -1, None, [])
            return at
        part, f = int(rng.integers(1, n)), int(rng.integers(0, len(slots)))
        left = grow(part, depth - 1)
        right = grow(n - part, depth - 1)
        nodes[at] = (0.0, n, left, right, f, *((None, [0.0, 2.0]) if f == 1 else (float(rng.normal()), [])))
        return at

    grow(n, depth)
    return nodes


def test_leaf_paths_equal_all_coalitions():
    rng = np.random.default_rng(3)
    slots, p = [0, 1, 2, 2, 3, 0], 4  # two features with two places each
    for _ in range(12):
        nodes = random_tree(rng, slots, 6)
        x = np.where(np.arange(6) == 1, rng.integers(0, 3, (5, 6)), rng.normal(size=(5, 6)))
        got = np.zeros((5, p))
        for leaf in explain.leaves(nodes, slots):
            goes = lambda n, row: row[nodes[n][4]] in nodes[n][6] if nodes[n][5] is None else row[nodes[n][4]] <= nodes[n][5]  # noqa: E731, B023
            passed = np.array([[all(goes(n, row) == left for n, left in tests) for tests in leaf.tests] for row in x], float)
            if leaf.features:
                got[:, leaf.features] += explain.leaf_values(leaf, passed)
        for row, found in zip(x, got):
            for j in range(p):
                phi = sum(math.factorial(s.bit_count()) * math.factorial(p - s.bit_count() - 1) / math.factorial(p) * (conditional_mean(nodes, row, slots, s | 1 << j) - conditional_mean(nodes, row, slots, s)) for s in range(1 << p) if not s >> j & 1)
                assert abs(found[j] - phi) < 1e-9


def test_tree_explainer_takes_forty_features(spark):
    rng = np.random.default_rng(8)
    names = [f"f{i}" for i in range(40)]
    x = rng.normal(size=(400, 40))
    y = 3 * x[:, 0] + x[:, 1] * x[:, 39] - 2 * (x[:, 20] > 0)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, " + ", ".join(f"{n} double" for n in names) + ", y double")
    fitted = model.fit(df, names, "y", "forest", "regression", numTrees=5, maxDepth=8, seed=1)
    phi = explain.tree_shap(fitted, df, names, ("id",))
    assert phi.count() == 16_000
    total = phi.groupBy("id").agg(F.sum("phi").alias("phi"))
    base = explain.mean_prediction(fitted, df)
    assert model.predict(fitted, df).join(total, "id").where(F.abs(F.col("prediction") - base - F.col("phi")) > 1e-8).count() == 0
    assert explain.global_importance(phi).orderBy(F.desc("importance")).first()["feature"] == "f0"


def test_kernel_explainer_converges(spark):
    rng = np.random.default_rng(2)
    for p, most, tolerance in ((1, 100, 1e-9), (2, 100, 1e-9), (5, 64, 1e-9), (9, 200, 1.0)):
        names = [f"f{i}" for i in range(p)]
        df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(30, p)))], "id long, " + ", ".join(f"{n} double" for n in names))
        score = lambda d, names=names: d.withColumn("prediction", sum((F.col(a) * F.col(b) * F.col(c) for a, b, c in zip(names, names[1:], names[2:])), F.lit(0.0)) + 2 * F.col(names[-1]))
        exact = {(r["id"], r["feature"]): r["phi"] for r in explain.coalition_shap(df, names, score, "id").collect()}
        found = {(r["id"], r["feature"]): r["phi"] for r in explain.kernel_shap(df, names, score, "id", coalitions=most).collect()}
        assert found.keys() == exact.keys()
        error = max(abs(found[k] - exact[k]) for k in exact)
        assert error < tolerance, (p, error)
        if p == 9:
            assert error > 1e-9  # sampled, not all
            more = {(r["id"], r["feature"]): r["phi"] for r in explain.kernel_shap(df, names, score, "id", coalitions=420).collect()}
            assert np.mean([abs(more[k] - exact[k]) for k in exact]) < np.mean([abs(found[k] - exact[k]) for k in exact])
            for i in range(30):  # efficiency holds for any sample
                assert abs(sum(found[i, n] for n in names) - sum(exact[i, n] for n in names)) < 1e-9


def test_kernel_explainer_over_background_rows(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, -1.0, 5.0)], "id long, a double, b double")
    back = spark.createDataFrame([(0.0, 1.0), (4.0, -1.0), (1.0, 1.0)], "a double, b double")
    f = lambda a, b: a * b + a
    found = {(r["id"], r["feature"]): r["phi"] for r in explain.kernel_shap(df, ("a", "b"), lambda d: d.withColumn("prediction", F.col("a") * F.col("b") + F.col("a")), "id", back).collect()}
    rows = back.collect()
    for i, a, b in df.collect():
        one, two, none = np.mean([f(a, r[1]) for r in rows]), np.mean([f(r[0], b) for r in rows]), np.mean([f(*r) for r in rows])
        assert abs(found[i, "a"] - (one - none + f(a, b) - two) / 2) < 1e-9
        assert abs(found[i, "b"] - (two - none + f(a, b) - one) / 2) < 1e-9


def test_isolation_forest_equals_walks_over_the_same_samples(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(700, 2)))] + [(700, 12.0, 12.0), (701, None, 1.0), (702, 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(3)
    trees, sample, seed = 20, 64, 5
    found = {r["id"]: r["isolation"] for r in isolation.isolation_scores(df, ("a", "b"), ("id",), trees, sample, seed).collect()}
    hashed = df.where("a is not null and not isnan(b)").select("id", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("t")).withColumn("h", F.xxhash64(F.lit(seed), "t", "id")).collect()
    total = dict.fromkeys((r["id"] for r in hashed), 0.0)
    for t in range(trees):
        picked = np.array([[r["a"], r["b"]] for r in sorted((r for r in hashed if r["t"] == t), key=lambda r: r["h"])[:sample]])
        feature, cut, length = isolation.grown(picked, 6, np.random.default_rng((seed, t)))
        seen = np.zeros(len(feature), int)
        for r in [r for r in hashed if r["t"] == t]:
            node, depth = 0, 0
            while feature[node] >= 0:
                node, depth = 2 * node + (2 if (r["a"], r["b"])[feature[node]] > cut[node] else 1), depth + 1
            total[r["id"]] += length[node]
        for row in picked:  # leaves know how many rows of the sample they hold
            node = 0
            while feature[node] >= 0:
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            seen[node] += 1
        for node in np.flatnonzero(seen):
            assert abs(length[node] - int(math.log2(node + 1)) - isolation.usual_depth(seen[node])) < 1e-12
    usual = 2 * (math.log(sample - 1) + 0.5772156649015329) - 2 * (sample - 1) / sample
    assert found.pop(701) is None and found.pop(702) is None
    assert found.keys() == total.keys() and all(abs(found[i] - 2 ** (-total[i] / trees / usual)) < 1e-12 for i in total)
    assert max(found, key=found.get) == 700


def numeric(f, theta):
    out = np.zeros_like(theta)
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        out[i] = (f(theta + step) - f(theta - step)) / 2e-6
    return out


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=40)
    map_ = gradient.Features(["a", "b", "c"], np.zeros(3), np.ones(3), rng.normal(size=(3, 10)), rng.uniform(0, 6, 10))
    z, theta = map_(x), rng.normal(size=11)
    sign = np.where(y > 0, 1, -1)
    losses = (
        (gradient.hinge_gradient(map_, theta, x, y), lambda t: np.maximum(0, 1 - sign * (z @ t[:-1] + t[-1])).sum()),
        (gradient.tube_gradient(map_, 0.1, theta, x, y), lambda t: np.maximum(0, np.abs(z @ t[:-1] + t[-1] - y) - 0.1).sum()),
    )
    for found, loss in losses:
        assert np.allclose(found, numeric(loss, theta), atol=1e-5)
    w = rng.normal(size=10)
    lowest = z[np.argsort(z @ w)[:8]].mean(0)  # a fifth of 40
    gradient.SCORES, ranges = 4096, gradient.SCORES
    found = gradient.mean_of_lowest(gradient.lowest_sums(map_, w, x), 0.2)
    gradient.SCORES = ranges
    assert np.allclose(found, lowest) and np.allclose(w - found, numeric(lambda t: t @ t / 2 - np.sort(z @ t)[:8].mean(), w), atol=1e-5)
    sizes = [3, 5, 4, 1]
    theta = rng.normal(size=3 * 5 + 5 + 5 * 4 + 4 + 4 + 1)
    assert np.allclose(gradient.network_gradient(theta, sizes, x, y), numeric(lambda t: ((gradient.network_output(t, sizes, x) - y) ** 2).sum() / 2, theta), atol=1e-5)


def test_kernel_machines_bend(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-2, 2, (500, 2))
    ring = (x**2).sum(1)
    df = spark.createDataFrame([(i, float(a), float(b), float(1.2 < r < 3.5), float(np.sin(2 * a) + b * b)) for i, ((a, b), r) in enumerate(zip(x, ring))], "id long, a double, b double, inside double, y double")
    found = gradient.kernel_machine(df, ("a", "b"), "inside", gamma=1.0, rounds=25).score(df)
    plain = gradient.kernel_machine(df, ("a", "b"), "inside", draws=None, rounds=15).score(df)
    right = lambda d: d.where((F.col("score") > 0) == (F.col("inside") > 0)).count() / 500
    assert right(found) > 0.85 > 0.75 > right(plain)
    told = gradient.kernel_machine(df, ("a", "b"), "y", "regression", gamma=1.0, rounds=25).score(df).select(F.col("score") - F.col("y")).collect()
    assert np.sqrt(np.mean([r[0] ** 2 for r in told])) < 0.4 * np.std([r["y"] for r in df.collect()])


def test_one_class_machine_flags_planted_rows(spark):
    rng = np.random.default_rng(7)
    angle = rng.uniform(0, 2 * np.pi, 400)
    rows = [(i, float(3 * np.cos(t) + e), float(3 * np.sin(t) + f)) for i, (t, (e, f)) in enumerate(zip(angle, rng.normal(0, 0.2, (400, 2))))]
    planted = [(1000 + i, *p) for i, p in enumerate([(0.0, 0.0), (0.2, -0.1), (7.0, 7.0), (-7.0, 6.5), (7.0, -7.0)])]
    df = spark.createDataFrame([*rows, *planted, (2000, None, 1.0)], "id long, a double, b double")
    found = {r["id"]: r["is_outlier"] for r in gradient.one_class_outliers(df, ("a", "b"), 0.05, gamma=1.5, draws=256, rounds=8).collect()}
    assert all(found[i] for i, *_ in planted) and found[2000] is None
    assert abs(sum(bool(v) for v in found.values()) - 0.05 * 405) <= 2
    assert gradient.one_class_outliers(df.limit(0), ("a", "b"), rounds=1).count() == 0


def test_network_beats_the_plane(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, (400, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float(np.sin(2 * a) * b + 10)) for i, (a, b) in enumerate(x)], "id long, a double, b double, y double")
    rmse = lambda d: d.select(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).first()[0]
    plane = rmse(model.predict(model.fit(df, ("a", "b"), "y", "linear", "regression"), df))
    assert rmse(gradient.regression_network(df, ("a", "b"), "y", (12,), rounds=70).predict(df)) < 0.7 * plane


def test_surrogate_equals_the_process_of_its_features(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-2, 2, (60, 2))
    y = np.sin(x[:, 0]) + x[:, 1]
    df = spark.createDataFrame([(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    fitted = gradient.gaussian_surrogate(df, ("a", "b"), "y", 200, 0.5, noise=0.01)
    far = spark.createDataFrame([(1000, 40.0, -40.0, 0.0), (1001, None, 1.0, 0.0)], df.schema)
    got = {r["id"]: (r["mu"], r["sigma"]) for r in fitted.score(df.union(far)).collect()}
    z = fitted.features(np.concatenate([x, [[40.0, -40.0]]]))
    k = z @ z.T  # by the kernel of all rows instead of by weights
    inverse = np.linalg.inv(k[:60, :60] + 0.01 * np.eye(60))
    mu = k[:, :60] @ inverse @ y
    sigma = np.sqrt(np.diag(k) - (k[:, :60] @ inverse * k[:, :60]).sum(1))
    for i, key in enumerate([*range(60), 1000]):
        assert abs(got[key][0] - mu[i]) < 1e-6 and abs(got[key][1] - sigma[i]) < 1e-5
    assert got[1001] == (None, None) and got[1000][1] > 3 * max(got[i][1] for i in range(60))
    assert np.sqrt(np.mean([(got[i][0] - y[i]) ** 2 for i in range(60)])) < 0.1


def test_hypervolume_equals_cells(spark):
    rng = np.random.default_rng(9)
    for dim, n, ranges in ((2, 40, 4), (3, 120, 5), (3, 60, 1), (4, 40, 3)):
        x = rng.integers(0, 8, (n, dim)).astype(float)
        names = [f"o{i}" for i in range(dim)]
        df = spark.createDataFrame([*[tuple(map(float, r)) for r in x], (None, *[0.0] * (dim - 1))], ", ".join(f"{c} double" for c in names))
        grid = np.stack(np.meshgrid(*[np.arange(7)] * dim, indexing="ij"), -1).reshape(-1, dim)  # unit cells below the reference
        covered = np.zeros(len(grid), bool)
        for p in x:
            covered |= (p <= grid).all(1)
        assert design.hypervolume_of_many(df, names, [7.0] * dim, ranges).first()[0] == covered.sum()
    assert design.hypervolume_of_many(df.limit(0), names, [7.0] * 4).first()[0] == 0


def test_inverse_normal_and_fronts(spark):
    from statistics import NormalDist

    from lodeworks.functions.scalars import inverse_normal_cdf

    shares = [1e-9, 1e-4, 0.02, 0.02425, 0.1, 0.5, 0.77, 0.98, 0.9999]
    got = spark.createDataFrame([(p,) for p in shares], "p double").select(inverse_normal_cdf(F.col("p"))).collect()
    assert np.allclose([r[0] for r in got], [NormalDist().inv_cdf(p) for p in shares], rtol=2e-9, atol=1e-12)
    rng = np.random.default_rng(0)
    for n, d in ((0, 2), (1, 3), (500, 2), (900, 4)):
        x = rng.integers(0, 12, (n, d)) / 10
        assert design.undominated(x).tolist() == [not any((y <= p).all() and (y < p).any() for y in x) for p in x]


def test_a_broken_search_comes_to_the_same_result(spark, tmp_path):
    space = [design.Dimension("a", 0, 1), design.Dimension("k", 1, 6, "integer"), design.Dimension("c", kind="categorical", categories=("x", "y"))]
    score = lambda d: d.withColumn("prediction", F.sin(9 * F.col("a")) - F.abs(F.col("k") - 4) + (F.col("c") == "y").cast("int"))
    whole, trace = (t.collect() for t in design.zoom_search(spark, space, score, pool=300))
    asked = []
    stopped = design.zoom_search(spark, space, score, pool=300, folder=f"{tmp_path}/s", stop=lambda: asked.append(1) or len(asked) > 2)[1]
    assert stopped.count() == 2
    asked = []
    resumed = design.zoom_search(spark, space, score, pool=300, folder=f"{tmp_path}/s", stop=lambda: bool(asked.append(1)))
    assert [t.collect() for t in resumed] == [whole, trace] and len(asked) == 2  # two rounds were left
    spread = [r["diversity"] for r in trace]
    assert spread[0] > spread[-1] > 0 and abs(spread[0] - (2 * (1 / 12) ** 0.5 + 0.05 + 0.5) / 3) < 0.05
    with np.testing.assert_raises(ValueError):
        design.zoom_search(spark, space, score, pool=301, folder=f"{tmp_path}/s")


def test_fold_scores_equal_fits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1e4, [1, 50, 0.1], (200, 3))
    y = x @ [3.0, -1.0, 20.0] + rng.normal(size=200)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))] + [(999, None, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, y double")
    held = {r["id"]: r["f"] for r in df.select("id", evaluate.fold(("id",), 4).alias("f")).collect()}
    cut = np.array([held[i] for i in range(200)])
    found = {(r["subset"], r["fold"]): (r["n_rows"], r["rmse"]) for r in select.subset_fold_scores(df, ("a", "b", "c"), "y", ("id",), 4).collect()}
    assert len(found) == 28
    for (subset, k), (n, rmse) in found.items():
        at = ["abc".index(c) for c in subset.split(",")]
        z = np.column_stack([np.ones(200), x[:, at] - 1e4])
        w = np.linalg.lstsq(z[cut != k], y[cut != k], rcond=None)[0]
        assert n == (cut == k).sum() and abs(rmse - np.sqrt(np.mean((y - z @ w)[cut == k] ** 2))) < 1e-6


def test_equal_rows_are_learned_from_as_one_with_a_weight(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, (600, 2)).astype(float)
    rows = [(float(a), float(b), float(a + b > 3)) for a, b in x] + [(None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, y double").repartition(3)
    table = gradient.table_of(df, ("a", "b"), "y")
    assert table.count() == len({r for r in rows if r[0] is not None}) and gradient.rows_of(table) == 600
    short = gradient.kernel_machine(df, ("a", "b"), "y", draws=16, rounds=8), gradient.one_class_machine(df, ("a", "b"), 0.1, 16, rounds=4)
    assert np.allclose(gradient.spread_of(table), (np.mean([r[2] for r in rows[:-1]]), np.std([r[2] for r in rows[:-1]])))
    monkeypatch.setattr(gradient, "COPIES", 1000)
    assert gradient.table_of(df, ("a", "b"), "y").count() == 600
    long = gradient.kernel_machine(df, ("a", "b"), "y", draws=16, rounds=8), gradient.one_class_machine(df, ("a", "b"), 0.1, 16, rounds=4)
    for one, other in zip(short, long):
        assert np.allclose(one.weights, other.weights, atol=1e-9) and abs(one.rho - other.rho) < 1e-9


def test_models_are_fitted_to_bounded_partitions(spark, monkeypatch):
    from lodeworks.operators import model

    df = spark.createDataFrame([(float(i % 7), float(i % 7 > 3) * 5 + i % 2) for i in range(400)], "a double, y double").coalesce(1)
    seen, plain = [], model.pipeline
    monkeypatch.setattr(model, "pipeline", lambda own, *a, **k: (seen.append(own.rdd.getNumPartitions()), plain(own, *a, **k))[1])
    whole = model.fit(df, ("a",), "y", "boosting", "regression", maxIter=2, seed=1)
    monkeypatch.setattr(model, "PART_ROWS", 50)
    parts = model.fit(df, ("a",), "y", "boosting", "regression", maxIter=2, seed=1)
    assert seen == [1, 8]
    assert np.allclose(*([r["prediction"] for r in model.predict(m, df).orderBy("a", "y").collect()] for m in (whole, parts)))


def test_linear_folds_from_moments_equal_fits_to_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n = 400
    a, b, c = rng.normal(1e6, 1, n), rng.integers(0, 50, n), rng.normal(0, 1e-3, n)
    y = 5 * (a - 1e6) + 0.1 * b - 1000 * c + rng.normal(0, 0.5, n) + 200
    gap = [None if k % 7 == 0 else float("nan") if k % 11 == 0 else float(v) for k, v in enumerate(c)]
    rows = [(i, float(a[i]), int(b[i]), gap[i], 0.1, float(y[i]), 3 * float(b[i]), None if i % 5 == 0 else int(b[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b int, c double, same double, y double, exact double, holed int").repartition(3)
    grid = [{"regParam": r, "elasticNetParam": e, "fitIntercept": i, "standardization": s} for r, e, i, s in ((0.0, 0.0, True, True), (0.3, 0.0, True, False), (5.0, 0.0, False, True), (0.5, 0.5, True, True), (1e6, 1.0, True, True))]
    cases = [(("a", "b", "c", "same"), "y", grid), (("b",), "exact", grid[:2]), (("a", "b"), "same", grid[:1])]
    cases += [(("a", "holed"), "y", grid[:1]), (("b", "exact"), "y", grid[1:2])]  # left to fits to the rows
    by_rows = lambda *_: None
    for features, target, tried in cases:
        found = []
        for how in (model.moments, by_rows):
            with monkeypatch.context() as m:
                m.setattr(model, "moments", how)
                found.append(model.cross_validate(df, ["id"], features, target, "linear", "regression", tried, 2).collect())
                if features == ("b",):
                    found[-1] += model.nested_cross_validate(df, ["id"], features, target, "linear", "regression", tried, 2, 2).select("parameters", "fold", "metric").collect()
        got, want = found
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert np.allclose([r["metric"] for r in got], [r["metric"] for r in want], rtol=1e-6, atol=1e-9), (features, target, got, want)


def test_nested_folds_read_rows_a_fixed_number_of_times(spark, monkeypatch):
    df = spark.range(500).select("id", F.rand(1).alias("a"), F.rand(2).alias("y"))
    written, store = [], model.materialised
    monkeypatch.setattr(model, "materialised", lambda df, name: written.append(name) or store(df, name))
    monkeypatch.setattr(model, "pipeline", None)  # a fit to the rows themselves reads them several times for each fold and parameter set
    model.nested_cross_validate(df, ["id"], ("a",), "y", "linear", "regression", model.grid_search({"regParam": [0.0, 0.1, 0.2]}), 3, 3)
    assert written == ["outer-folds"]
