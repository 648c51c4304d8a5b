"""Model training over Spark ML: one fitted pipeline holds preparation and model; search, importance, metadata, storage."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from lodeworks.functions.storage import materialised
from lodeworks.operators.evaluate import fold
from lodeworks.operators.moments import PARAMETERS, moments

AVAILABLE = {
    "regression": {"linear": LinearRegression, "glm": GeneralizedLinearRegression, "tree": DecisionTreeRegressor, "forest": RandomForestRegressor, "boosting": GBTRegressor},
    "classification": {"logistic": LogisticRegression, "svm": LinearSVC, "tree": DecisionTreeClassifier, "forest": RandomForestClassifier, "boosting": GBTClassifier, "neural": MultilayerPerceptronClassifier},
}
#: Rows of a partition that models are fitted to, about.
PART_ROWS = 1_000_000
#: Ranges that a search takes unless told otherwise; this library's choice.
DEFAULTS = {
    "linear": {"regParam": [0.0, 0.01, 0.1]}, "logistic": {"regParam": [0.0, 0.01, 0.1]}, "svm": {"regParam": [0.01, 0.1]},
    "tree": {"maxDepth": [3, 5, 8]}, "forest": {"maxDepth": [3, 5], "numTrees": [20, 50]}, "boosting": {"maxDepth": [3, 5], "maxIter": [10, 20]}, "glm": {"family": ["gaussian", "gamma"], "link": ["log"]}, "neural": {"hidden": [(8,), (16, 8)]},
}


def available_models(task: str) -> dict[str, type]:
    return dict(AVAILABLE[task])


def pipeline(df: DataFrame, features: Sequence[str], target: str, model: str, task: str, **parameters) -> Pipeline:
    """Means for missing numbers, standard scores, one-hot categories (unseen ones apart), booleans as 0/1, then the model. The
    pipeline is fitted on training rows only, and takes raw tables ever after. ``neural`` takes ``hidden``, the sizes of its hidden
    layers; its first layer has a place for each number, flag and category (and one for unseen ones), its last one for each class."""
    kinds = {f: df.schema[f].dataType for f in features}
    numeric = [f for f, t in kinds.items() if isinstance(t, NumericType)]
    flags = [f for f, t in kinds.items() if isinstance(t, BooleanType)]
    text = [f for f in features if f not in numeric and f not in flags]
    stages = []
    if numeric:
        stages += [Imputer(inputCols=numeric, outputCols=[f"{f}__filled" for f in numeric]), VectorAssembler(inputCols=[f"{f}__filled" for f in numeric], outputCol="_numbers"), StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True)]
    if text:
        stages += [StringIndexer(inputCols=text, outputCols=[f"{f}__index" for f in text], handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=[f"{f}__index" for f in text], outputCols=[f"{f}__hot" for f in text], dropLast=False)]
    stages.append(VectorAssembler(inputCols=[*(["_scaled"] if numeric else []), *[f"{f}__hot" for f in text], *flags], outputCol="_features", handleInvalid="keep"))
    if model == "neural":
        n = df.agg(*[F.count_distinct(f).alias(f) for f in [*text, target]]).first()
        parameters = {k: v for k, v in parameters.items() if k != "hidden"} | {"layers": [len(numeric) + len(flags) + sum(n[f] + 1 for f in text), *parameters.get("hidden", (8,)), max(n[target], 2)]}
    stages.append(AVAILABLE[task][model](featuresCol="_features", labelCol=target, **parameters))
    return Pipeline(stages=stages)


def fit(df: DataFrame, features: Sequence[str], target: str, model: str, task: str, **parameters) -> PipelineModel:
    """The pipeline fitted to ``df``, of which features and target are written once: every stage reads them again. Tree models keep whole partitions
    as objects, many times the size of what Parquet holds, so none has many more than PART_ROWS rows."""
    own = materialised(df.select(*features, target), "training")
    parts = -(-own.count() // PART_ROWS)
    if parts > own.rdd.getNumPartitions():
        own = own.repartition(parts)
    return pipeline(own, features, target, model, task, **parameters).fit(own)


def what_if(fitted: PipelineModel, df: DataFrame, row: Mapping, changes: Sequence[Mapping] = ({},)) -> DataFrame:
    """(change, the columns of ``row``, prediction): the model's answer to one row, as it is and with each set of changes. ``df`` gives the
    types. A table as long as ``changes``."""
    cases = [{**row, **c} for c in changes]
    kinds = dict(df.dtypes)
    schema = ", ".join(["change int", *(f"`{c}` {kinds[c]}" for c in row)])
    table = df.sparkSession.createDataFrame([(i, *(case[c] for c in row)) for i, case in enumerate(cases)], schema)
    return predict(fitted, table)


def predict(fitted: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with ``prediction``."""
    out = fitted.transform(df)
    return out.select(*df.columns, "prediction")


def _metric(task: str, target: str):
    return RegressionEvaluator(labelCol=target, metricName="rmse") if task == "regression" else BinaryClassificationEvaluator(labelCol=target)


Case = tuple[Mapping, Sequence[int], Sequence[int]]


def _scorer(cut: DataFrame, features: Sequence[str], target: str, model: str, task: str, grid: Sequence[Mapping], parallel: int) -> Callable[[Sequence[Case]], list[float]]:
    """A function of (parameters, cells to train on, cells to score) cases to their metrics. ``cut`` has the cell of each row in ``_cell``.
    Linear models of numbers come from moments by cell, two passes for any number of cases; others are fitted side by side to the rows."""
    known = moments(cut, features, target, "_cell") if task == "regression" and model == "linear" and all(set(g) <= PARAMETERS for g in grid) else None

    def fitted_rows(case: Case) -> float:
        parameters, train, test = case
        own = cut.where(F.col("_cell").isin(*train))
        fitted = pipeline(own, features, target, model, task, **parameters).fit(own)
        return float(_metric(task, target).evaluate(fitted.transform(cut.where(F.col("_cell").isin(*test)))))

    def score(cases: Sequence[Case]) -> list[float]:
        sets = {tuple(train): None for _, train, _ in cases}
        if known:
            sets = {train: known.training(train) for train in sets}

        def one(case: Case) -> float:
            parameters, train, test = case
            own = sets[tuple(train)]
            return known.rmse(own, parameters, test) if own and known.over(test)[0, 0] > 0 else fitted_rows(case)

        with ThreadPool(max(1, parallel)) as pool:
            return pool.map(one, cases, 1)

    return score


def cross_validate(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, model: str, task: str, grid: Sequence[Mapping], folds: int = 3, parallel: int = 4) -> DataFrame:
    """(parameters, fold, metric) of each parameter set and fold: RMSE, or area under the ROC curve. Folds come from an md5 of the keys,
    so they are the same in every run. ``parallel`` fits run at a time, as Spark jobs side by side over one written table."""
    cut = materialised(df.withColumn("_cell", fold(keys, folds)).select(*features, target, "_cell"), "folds")
    cases = [(parameters, [i for i in range(folds) if i != k], [k]) for parameters in grid for k in range(folds)]
    metrics = _scorer(cut, features, target, model, task, grid, parallel)(cases)
    return df.sparkSession.createDataFrame([(_name(parameters), test[0], m) for (parameters, _, test), m in zip(cases, metrics)], "parameters string, fold int, metric double")


def _name(parameters: Mapping) -> str:
    return str(dict(sorted(parameters.items())))


def nested_cross_validate(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, model: str, task: str, grid: Sequence[Mapping], outer: int = 3, inner: int = 2, parallel: int = 4) -> DataFrame:
    """(fold, parameters, metric): in each outer fold the parameters that win the inner folds of its training rows, and what they reach on the
    rows left out. A cell holds the rows of one outer and one inner fold, in one table written for all."""
    cut = materialised(df.withColumn("_cell", fold(keys, outer, seed=1) * inner + fold(keys, inner)).select(*features, target, "_cell"), "outer-folds")
    score = _scorer(cut, features, target, model, task, grid, parallel)
    cells = lambda out, own: [o * inner + i for o in range(outer) for i in range(inner) if out(o) and own(i)]
    tries = [(k, g, i) for k in range(outer) for g in grid for i in range(inner)]
    reached = score([(g, cells(lambda o: o != k, lambda j: j != i), cells(lambda o: o != k, lambda j: j == i)) for k, g, i in tries])
    best = []
    for k in range(outer):
        found: dict[str, list[float]] = {}
        for (at, g, _), m in zip(tries, reached):
            if at == k:
                found.setdefault(_name(g), []).append(m if task == "regression" else -m)
        best.append(min(found, key=lambda name: (sum(found[name]) / len(found[name]), name)))
    chosen = [next(g for g in grid if _name(g) == name) for name in best]
    metrics = score([(g, cells(lambda o: o != k, lambda j: True), cells(lambda o: o == k, lambda j: True)) for k, g in enumerate(chosen)])
    return df.sparkSession.createDataFrame(list(zip(range(outer), best, metrics)), "fold int, parameters string, metric double")


def objectives(candidates: DataFrame, fitted: Mapping[str, PipelineModel]) -> DataFrame:
    """``candidates`` with one column of predictions for each named model."""
    out = candidates
    for name, one in fitted.items():
        out = predict(one, out).withColumnRenamed("prediction", name)
    return out


def forest_surrogate(fitted: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with ``mu`` and ``sigma``: mean and spread over the trees of a fitted regression forest, each scored on the JVM."""
    *before, forest = fitted.stages
    out = df
    for stage in before:
        out = stage.transform(out)
    names = []
    for i, tree in enumerate(forest.trees):
        names.append(f"_tree_{i}")
        out = tree.setFeaturesCol("_features").setPredictionCol(names[-1]).transform(out)
    mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
    spread = F.sqrt(sum(((F.col(n) - F.col("mu")) * (F.col(n) - F.col("mu")) for n in names), F.lit(0.0)) / len(names))
    return out.withColumn("mu", mean).withColumn("sigma", spread).select(*df.columns, "mu", "sigma")


def grid_search(ranges: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(ranges, values)) for values in itertools.product(*ranges.values())]


def random_search(ranges: Mapping[str, Sequence], n: int, seed: int = 0) -> list[dict]:
    """``n`` different parameter sets, or all there are."""
    every = grid_search(ranges)
    return random.Random(seed).sample(every, min(n, len(every)))


def importances(fitted: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, importance) of a tree model, or absolute weights of a linear one, by the names in the assembled column."""
    model = fitted.stages[-1]
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
    attributes = fitted.transform(df.limit(0)).schema["_features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a.get("name", str(a["idx"])) for group in attributes.values() for a in group}
    return df.sparkSession.createDataFrame([(names.get(i, f"feature_{i}"), float(v)) for i, v in enumerate(values)], "feature string, importance double")


def describe_model(fitted: PipelineModel, df: DataFrame) -> DataFrame:
    """(stage, type, parameter, value) of every stage."""
    rows = [(i, type(s).__name__, p.name, str(v)) for i, s in enumerate(fitted.stages) for p, v in s.extractParamMap().items()]
    return df.sparkSession.createDataFrame(rows, "stage int, type string, parameter string, value string")


def save(fitted: PipelineModel, path: str) -> None:
    fitted.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
