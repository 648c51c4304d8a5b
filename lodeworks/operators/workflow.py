"""From a table to tables: an audit with its clusters, and a plan of how to model it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.storage import materialised
from lodeworks.operators import cluster, prepare, profile


def cluster_report(df: DataFrame, key: str, cols: Sequence[str], k: int, seed: int = 1) -> dict[str, DataFrame]:
    """The tables of a cluster analysis: ``audit`` (a quality profile of the numeric columns), ``actions`` (what the audit advises), ``clusters``
    (key, cluster) by k-means over the columns that are left once the advice has been followed, standardised; ``metrics`` (centroid indices), and ``profile``, the
    means of each cluster against all rows, of the columns as they came. Rows that still miss a value are in no cluster."""
    audit = materialised(profile.quality_profile(df, cols), "audit")
    actions = materialised(profile.recommendations(df, cols), "actions")
    clean = profile.apply_recommendations(df.select(key, *cols), actions)
    left = [c for c in cols if c in clean.columns]
    if not left:
        raise ValueError("the audit leaves no column to cluster by")
    scaled = prepare.fit_standard(clean, left).transform(clean)
    rows = materialised(scaled.dropna(subset=left).select(key, F.array(*[F.col(c).cast("double") for c in left]).alias("v")), "scaled")
    fitted = cluster.fit(rows, "v", "kmeans", k, seed)
    found = materialised(fitted.transform(cluster.with_features(rows, "v")).select(key, "v", F.col("prediction").alias("cluster")), "clusters")
    named = df.join(found.select(key, "cluster"), key)
    return {"audit": audit, "actions": actions, "clusters": found.select(key, "cluster"), "metrics": cluster.centroid_indices(found, "v", "cluster"), "profile": cluster.interpret(named, "cluster", cols)}


def long_report(tables: dict[str, DataFrame], keys: dict[str, Sequence[str]]) -> DataFrame:
    """(section, item, name, value) of report tables: every column that isn't a key of its table, as text, under the names of the keys."""
    out = None
    for section, own in keys.items():
        table = tables[section]
        item = F.concat_ws(" / ", *[F.col(c).cast("string") for c in own]) if own else F.lit("")
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in table.columns if c not in own]))
        rows = table.select(F.lit(section).alias("section"), item.alias("item"), cells.alias("x")).select("section", "item", "x.*")
        out = rows if out is None else out.union(rows)
    return out


def model_plan(df: DataFrame, numeric: Sequence[str], target: str, many_features: int = 50, high: float = 0.95, few_rows: int = 1000, many_rows: int = 100_000) -> DataFrame:
    """(step, choice) for selection, models, search, evaluation and the order of work, by rules over the table: how many rows and features there are, whether
    two features say the same, what kind of target it is, and whether anything is missing or out of bounds. The limits are this library's choice."""
    task = profile.suggest_task(df, [target]).select("task")
    actions = profile.recommendations(df, numeric).agg(F.count(F.when(F.col("action") != "keep", 1)).alias("repairs"))
    n_features = len(df.columns) - 1
    pairs = profile.correlations(df, list(numeric)).agg(F.count(F.when(F.abs("r") > high, 1)).alias("alike"))
    one = df.agg(F.count(F.lit(1)).alias("n")).join(task).join(actions).join(pairs)  # a row each
    n, regression = F.col("n"), F.col("task") == "regression"
    selection = F.when(F.lit(n_features > many_features), "importance").when(F.col("alike") > 0, "correlation").otherwise("none")
    models = F.when(regression & (n < few_rows), "linear, tree").when(regression, "forest, boosting").when(n < few_rows, "logistic, tree").otherwise("forest, boosting")
    search = F.when(n < few_rows, "grid").otherwise("random")
    evaluation = F.when(n < few_rows, "nested cross-validation").when(n < many_rows, "cross-validation").otherwise("split")
    order = F.concat_ws(", ", F.when(F.col("repairs") > 0, "clean"), F.lit("encode"), F.lit("scale"), F.when(selection != "none", "select"), F.lit("train"), F.lit("evaluate"))
    steps = (("task", F.col("task")), ("selection", selection), ("models", models), ("search", search), ("evaluation", evaluation), ("order", order))
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("step"), c.alias("choice")) for s, c in steps])).alias("x")).select("x.*")
