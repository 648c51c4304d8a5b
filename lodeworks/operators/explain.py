"""Shapley values: exactly for linear models and trees, and by all coalitions for any model that scores a table."""

from __future__ import annotations

import itertools
import math
import random
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.storage import discard, shared_folder


def linear_shap(df: DataFrame, weights: Mapping[str, float], key: Sequence[str]) -> DataFrame:
    """(key, feature, value, phi) in long form: weight * (value - mean of the feature), exact for independent features."""
    means = df.agg(*[F.avg(c).alias(c) for c in weights]).first()
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), (w * (F.col(c) - means[c])).cast("double").alias("phi")) for c, w in weights.items()]
    return df.select(*key, F.explode(F.array(*cells)).alias("x")).select(*key, "x.*")


def coalition_shap(df: DataFrame, features: Sequence[str], score: Callable[[DataFrame], DataFrame], key: str, most: int = 10) -> DataFrame:
    """(key, feature, value, phi) for any model, by all 2**p coalitions of at most ``most`` features: absent features take their
    means. ``score`` adds ``prediction`` to a table of features; it is called once, over all coalitions of all rows."""
    p = len(features)
    if p > most:
        raise ValueError(f"at most {most} features: the coalitions are 2**p for each row")
    means = df.agg(*[F.avg(c).alias(c) for c in features]).first()
    posted = df.select(key, *features).withColumn("_set", F.explode(F.sequence(F.lit(0), F.lit(2**p - 1))))
    has = lambda i: F.col("_set").bitwiseAND(F.lit(1 << i)) != 0
    mixed = posted.select(key, "_set", *[F.col(c).alias(f"_own_{c}") for c in features], *[F.when(has(i), F.col(c).cast("double")).otherwise(F.lit(means[c])).alias(c) for i, c in enumerate(features)])
    scored = score(mixed)
    size = F.bit_count("_set")
    weight = lambda s: math.factorial(s) * math.factorial(p - s - 1) / math.factorial(p) if 0 <= s < p else 0.0
    joining = F.array(*[F.lit(weight(s)) for s in range(p + 1)])[size]  # of a coalition without the feature
    leaving = F.array(*[F.lit(weight(s - 1)) for s in range(p + 1)])[size]  # of one with it
    sums = [F.sum(F.col("prediction") * F.when(has(i), leaving).otherwise(-joining)).alias(f"_phi_{c}") for i, c in enumerate(features)]
    one = scored.groupBy(key).agg(*sums, *[F.first(f"_own_{c}").alias(f"_own_{c}") for c in features])
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"_own_{c}").cast("double").alias("value"), F.col(f"_phi_{c}").alias("phi")) for c in features]
    return one.select(key, F.explode(F.array(*cells)).alias("x")).select(key, "x.*")


def kernel_coalitions(p: int, most: int, seed: int = 0) -> list[tuple[int, float]]:
    """(coalition as bits, weight) of at most about ``most`` coalitions of p features: whole sizes from the outside in, as far as they fit, with the
    kernel's own weights; of the sizes left, as many drawn ones, each beside its complement, that share the weight of their sizes."""
    share = {s: (p - 1) / (s * (p - s)) for s in range(1, p)}  # of all coalitions of a size together
    out, left = [], list(range(1, p // 2 + 1))
    while left:
        s = left[0]
        sizes = {s, p - s}
        n = sum(math.comb(p, k) for k in sizes)
        if len(out) + n > most:
            break
        for k in sizes:
            out += [(sum(1 << i for i in c), share[k] / math.comb(p, k)) for c in itertools.combinations(range(p), k)]
        left.pop(0)
    if left:
        rng, sizes = random.Random(seed), [s for s in share if s in left or p - s in left]
        total, drawn = sum(share[s] for s in sizes), {}
        for _ in range(max(1, (most - len(out)) // 2)):
            s = rng.choices(sizes, [share[k] for k in sizes])[0]
            c = sum(1 << i for i in rng.sample(range(p), s))
            for one in (c, (1 << p) - 1 - c):
                drawn[one] = drawn.get(one, 0) + 1
        out += [(c, total * n / sum(drawn.values())) for c, n in drawn.items()]
    return out


def kernel_shap(df: DataFrame, features: Sequence[str], score: Callable[[DataFrame], DataFrame], key: str, background: DataFrame | None = None, coalitions: int = 2048, seed: int = 0) -> DataFrame:
    """(key, feature, value, phi) for any model and up to 62 features, by weighted least squares over coalitions: absent features take the values of the rows
    of ``background``, a table of few rows, over whose scores the mean is taken; without one, the means of ``df``. All coalitions are taken where there
    are no more than ``coalitions`` (then phis are exact), else as many by ``kernel_coalitions``. The phis of a row add up to its score less the
    mean score of the background. ``score`` adds ``prediction``; it is called once, over rows times coalitions times background rows.

    The normal equations have one matrix for all rows, that of the coalitions; what differs by row is one weighted sum for each feature, all of
    them from one aggregate."""
    p = len(features)
    if not 0 < p <= 62:
        raise ValueError("from one to 62 features")
    if background is None:
        background = df.agg(*[F.avg(c).alias(c) for c in features])
    known = background.select(F.array(*[F.col(c).cast("double") for c in features]).alias("_other"))
    chosen = kernel_coalitions(p, coalitions, seed) if p > 1 else []
    every = [(0, 0.0), ((1 << p) - 1, 0.0), *chosen]  # none and all give the ends
    sets = df.sparkSession.createDataFrame(every, "_set long, _weight double")
    # Both tables are of bounded size, whatever that of df.
    posted = df.select(key, *features).join(F.broadcast(sets)).join(F.broadcast(known))
    has = lambda i: F.col("_set").bitwiseAND(F.lit(1 << i)) != 0
    mixed = posted.select(key, "_set", "_weight", *[F.col(c).cast("double").alias(f"_own_{c}") for c in features], *[F.when(has(i), F.col(c).cast("double")).otherwise(F.col("_other")[i]).alias(c) for i, c in enumerate(features)])
    own = [F.first(f"_own_{c}").alias(f"_own_{c}") for c in features]
    means = score(mixed).groupBy(key, "_set", "_weight").agg(F.avg("prediction").alias("_y"), *own)
    y, last = F.col("_y") * F.col("_weight"), has(p - 1).cast("int")
    ends = [F.max(F.when(F.col("_set") == c, F.col("_y"))).alias(n) for c, n in ((0, "_none"), ((1 << p) - 1, "_all"))]
    sums = [F.sum(y * (has(i).cast("int") - last)).alias(f"_s{i}") for i in range(p - 1)]
    rows = means.groupBy(key).agg(*ends, *sums, *[F.first(f"_own_{c}").alias(f"_own_{c}") for c in features])
    if p == 1:
        phis = [F.col("_all") - F.col("_none")]
    else:
        z = np.array([[c >> i & 1 for i in range(p)] for c, _ in chosen], float)
        w = np.array([v for _, v in chosen])
        x = z[:, :-1] - z[:, [-1]]
        inverse = np.linalg.pinv(x.T @ (x * w[:, None]))
        fixed, tail = x.T @ w, x.T @ (w * z[:, -1])  # what the two ends subtract
        right = [F.col(f"_s{i}") - F.col("_none") * float(fixed[i]) - (F.col("_all") - F.col("_none")) * float(tail[i]) for i in range(p - 1)]
        phis = [sum((right[j] * float(inverse[i, j]) for j in range(p - 1)), F.lit(0.0)) for i in range(p - 1)]
        phis.append(F.col("_all") - F.col("_none") - sum(phis[1:], phis[0]))
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"_own_{c}").alias("value"), phi.alias("phi")) for c, phi in zip(features, phis)]
    return rows.select(key, F.explode(F.array(*cells)).alias("x")).select(key, "x.*")


def global_importance(phi: DataFrame) -> DataFrame:
    """Mean absolute Shapley value of each feature."""
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))


def waterfall(phi: DataFrame, base: float, key: Sequence[str]) -> DataFrame:
    """For each row of the model the steps from the base value to the prediction, the largest first."""
    order = Window.partitionBy(*key).orderBy(F.desc(F.abs("phi")), "feature")
    step = F.sum("phi").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return phi.select(*key, "feature", "phi", F.row_number().over(order).alias("step"), (F.lit(base) + step).alias("reached"))


def dependence(phi: DataFrame, feature: str, other: str, key: Sequence[str]) -> DataFrame:
    """(key, value, phi, other value) of one feature, with the value of another beside it."""
    own = phi.where(F.col("feature") == feature).select(*key, "value", "phi")
    return own.join(phi.where(F.col("feature") == other).select(*key, F.col("value").alias("other_value")), list(key))


# Trees

LINEAR = ("LinearRegressionModel", "GeneralizedLinearRegressionModel", "LogisticRegressionModel", "LinearSVCModel")
TREES = ("DecisionTreeRegressionModel", "RandomForestRegressionModel", "GBTRegressionModel", "DecisionTreeClassificationModel", "RandomForestClassificationModel", "GBTClassificationModel")


def explainer_of(fitted: PipelineModel) -> str:
    """'linear', 'tree' or 'coalition', by the class of the last stage."""
    name = type(fitted.stages[-1]).__name__
    return "linear" if name in LINEAR else "tree" if name in TREES else "coalition"


def explain(fitted: PipelineModel, df: DataFrame, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(key, feature, value, phi) by the explainer that suits the model; models without one of their own go by coalitions, all of them up to ten
    features and sampled ones beyond, which take numeric features and a single key column."""
    kind = explainer_of(fitted)
    if kind == "tree":
        return tree_shap(fitted, df, features, key)
    if kind == "linear":
        return pipeline_linear_shap(fitted, df, features, key)
    (one,) = key
    score = lambda d: fitted.transform(d).withColumn("prediction", F.col("prediction").cast("double"))
    return coalition_shap(df, features, score, one) if len(features) <= 10 else kernel_shap(df, features, score, one)


def _slots(fitted: PipelineModel, df: DataFrame, features: Sequence[str]) -> list[int]:
    """For each place of the assembled vector the number of the feature it comes from."""
    numeric = fitted.stages[0].getInputCols() if type(fitted.stages[0]).__name__ == "ImputerModel" else []
    attributes = fitted.transform(df.limit(0)).schema["_features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a.get("name", "") for group in attributes.values() for a in group}
    out = []
    for i in range(len(names)):
        own = names[i]
        if own.startswith("_scaled_"):
            out.append(features.index(numeric[int(own.removeprefix("_scaled_"))]))
        else:
            out.append(next(k for k, f in enumerate(features) if own == f or own.startswith(f"{f}__hot_")))
    return out


def _before_model(fitted: PipelineModel, df: DataFrame) -> DataFrame:
    for stage in fitted.stages[:-1]:
        df = stage.transform(df)
    return df.withColumn("_x", vector_to_array("_features"))


def pipeline_linear_shap(fitted: PipelineModel, df: DataFrame, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """As ``linear_shap``, for a fitted linear pipeline: a feature's value is the sum over its places in the assembled vector of weight
    times (value - mean), on the scale of the linear predictor. ``value`` is null for a feature that is no number."""
    slots, weights = _slots(fitted, df, features), fitted.stages[-1].coefficients.toArray()
    rows = _before_model(fitted, df)
    means = rows.agg(*[F.avg(F.col("_x")[i]).alias(f"m{i}") for i in range(len(slots))]).first()
    phi = [sum(((F.col("_x")[i] - means[i]) * float(weights[i]) for i, k in enumerate(slots) if k == j), F.lit(0.0)) for j in range(len(features))]
    return _long(rows, features, key, phi)


def _long(rows: DataFrame, features: Sequence[str], key: Sequence[str], phi: Sequence) -> DataFrame:
    kinds = dict(rows.dtypes)
    value = lambda f: F.col(f).cast("double") if kinds[f] != "string" else F.lit(None).cast("double")
    cells = [F.struct(F.lit(f).alias("feature"), value(f).alias("value"), p.alias("phi")) for f, p in zip(features, phi)]
    return rows.select(*key, F.explode(F.array(*cells)).alias("x")).select(*key, "x.*")


def _trees(fitted: PipelineModel, df: DataFrame) -> list[tuple[float, list]]:
    """(weight, nodes by number) of each tree, from the table of nodes that the model is stored as: as many rows as it has nodes.
    A node is (value, rows, left, right, feature, threshold or None, left categories)."""
    model, spark = fitted.stages[-1], df.sparkSession
    path = f"{shared_folder(spark)}/lodeworks-trees-{uuid.uuid4().hex}"
    model.write().save(path)
    table = spark.read.parquet(f"{path}/data")
    rows = table.select("treeID", "nodeData.*").collect() if "treeID" in table.columns else table.select(F.lit(0).alias("treeID"), "*").collect()
    discard(spark, path)
    by_probability = "Classification" in type(model).__name__ and "GBT" not in type(model).__name__
    trees: dict[int, dict[int, tuple]] = {}
    for r in rows:
        stats, split = r["impurityStats"], r["split"]
        value = stats[-1] / sum(stats) if by_probability else r["prediction"]
        nominal = split["numCategories"] > 0
        edge = split["leftCategoriesOrThreshold"]
        trees.setdefault(r["treeID"], {})[r["id"]] = (value, r["rawCount"], r["leftChild"], r["rightChild"], split["featureIndex"], None if nominal or not edge else edge[0], list(edge) if nominal else [])
    weights = list(model.treeWeights) if "GBT" in type(model).__name__ else [1 / len(trees)] * len(trees)
    return [(w, [nodes[i] for i in range(len(nodes))]) for w, (_, nodes) in zip(weights, sorted(trees.items()))]


@dataclass(frozen=True)
class _Leaf:
    """A leaf and the features that its path splits on: of each the tests (node, whether to go left) and the share of training rows that pass them."""

    value: float
    features: list[int]
    shares: np.ndarray
    tests: list[list[tuple[int, bool]]]


def leaves(nodes: list, slots: Sequence[int], at: int = 0, path: tuple = ()) -> Iterator[_Leaf]:
    value, n, left, right, feature, *_ = nodes[at]
    if left >= 0:
        for child, goes_left in ((left, True), (right, False)):
            yield from leaves(nodes, slots, child, (*path, (slots[feature], at, goes_left, nodes[child][1] / (nodes[left][1] + nodes[right][1]))))
        return
    own = sorted({f for f, *_ in path})
    shares = np.array([math.prod(s for f, _, _, s in path if f == g) for g in own])
    yield _Leaf(value, own, shares, [[(node, goes) for f, node, goes, _ in path if f == g] for g in own])


def leaf_values(leaf: _Leaf, passed: np.ndarray) -> np.ndarray:
    """Shapley values of the leaf's features for rows that pass the tests of some (a boolean each): a coalition reaches the leaf with the
    product of what its features pass and the shares of the others, so coalitions of one size sum up to a coefficient of the product of
    (share + passed * t) over the other features."""
    m = len(leaf.features)
    weight = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
    out = np.zeros((len(passed), m))
    for i in range(m):
        poly = np.zeros((len(passed), m))
        poly[:, 0] = 1
        for j in range(m):
            if j != i:
                poly[:, 1:] = poly[:, 1:] * leaf.shares[j] + poly[:, :-1] * passed[:, [j]]
                poly[:, 0] *= leaf.shares[j]
        out[:, i] = leaf.value * (passed[:, i] - leaf.shares[i]) * (poly @ weight)
    return out


def tree_shap(fitted: PipelineModel, df: DataFrame, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(key, feature, value, phi) of a tree, forest or boosted trees, path-dependent and exact for any number of features: over the paths of
    its leaves, whose work grows with the cube of the depth. A feature stands for all places of the vector that come from it. The phis of a row add
    up to its prediction less the mean prediction of the training rows; of the probability of the last class for a classification tree or
    forest, of the margin for boosted ones. The nodes, as many as the model has, go to the tasks; rows are independent."""
    p, slots, trees = len(features), _slots(fitted, df, features), _trees(fitted, df)
    paths = [(w, nodes, list(leaves(nodes, slots))) for w, nodes in trees]
    shipped = df.sparkSession.sparkContext.broadcast(paths)

    def values(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), p))
        for w, nodes, own in shipped.value:
            left = {i: np.isin(x[:, f], categories) if threshold is None else x[:, f] <= threshold for i, (_, _, child, _, f, threshold, categories) in enumerate(nodes) if child >= 0}
            for leaf in own:
                if not leaf.features:
                    continue
                passed = np.stack([np.logical_and.reduce([left[n] == goes for n, goes in tests]) for tests in leaf.tests], 1)
                # Few of the ways to pass occur, whatever the number of rows.
                kinds, at = np.unique(passed, axis=0, return_inverse=True)
                out[:, leaf.features] += w * leaf_values(leaf, kinds.astype(float))[at.ravel()]
        return out

    @F.pandas_udf("array<double>")
    def phi(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(values(np.array(batch.tolist(), float).reshape(len(batch), -1))), index=batch.index)

    rows = _before_model(fitted, df).withColumn("_phi", phi("_x"))
    return _long(rows, features, key, [F.col("_phi")[j] for j in range(p)])


def mean_prediction(fitted: PipelineModel, df: DataFrame) -> float:
    """What the phis of ``tree_shap`` start from."""
    return float(sum(w * _mean(nodes) for w, nodes in _trees(fitted, df)))


def _mean(nodes: list, at: int = 0) -> float:
    value, _, left, right, *_ = nodes[at]
    if left < 0:
        return value
    n, m = nodes[left][1], nodes[right][1]
    return (_mean(nodes, left) * n + _mean(nodes, right) * m) / (n + m)
