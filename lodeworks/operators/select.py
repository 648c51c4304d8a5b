"""Feature selection over a table of importances, over correlations, and over subsets of features."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.operators.evaluate import fold
from lodeworks.operators.prepare import scaled_solution
from lodeworks.operators.profile import correlations

MAX_EXHAUSTIVE = 15


def keep_top(importances: DataFrame, k: int) -> DataFrame:
    """The ``k`` features of the largest importance, ties by name; importances is (feature, importance)."""
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


def keep_above(importances: DataFrame, threshold: float) -> DataFrame:
    return importances.where(F.col("importance") > threshold)


def keep_cumulative(importances: DataFrame, share: float = 0.95) -> DataFrame:
    """The fewest features, largest first, that hold ``share`` of all importance; the one that crosses it is kept. One row per
    feature, so a window over all is bounded by the number of columns."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")
    before = F.sum("importance").over(order.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("importance").over(Window.partitionBy(F.lit(0)))
    ran = importances.withColumns({"before": F.coalesce(before, F.lit(0.0)) / total, "cumulative": F.sum("importance").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total})
    return ran.where(F.col("before") < share).drop("before")


def drop_correlated(df: DataFrame, features: Sequence[str], target: str, limit: float = 0.95) -> DataFrame:
    """(feature, target_r, kept, dropped_for): of each pair of features correlated above ``limit``, taken from the strongest
    on, the one less correlated with the target goes (ties: the later name), unless its partner has gone already."""
    found = {(r["col_a"], r["col_b"]): abs(r["r"] or 0.0) for r in correlations(df, [*features, target]).collect()}  # of bounded columns
    to_target = {f: found[f, target] for f in features}
    gone: dict[str, str] = {}
    pairs = sorted(((found[a, b], a, b) for a, b in itertools.combinations(features, 2)), key=lambda p: (-p[0], p[1], p[2]))
    for r, a, b in pairs:
        if r > limit and a not in gone and b not in gone:
            loser = min((a, b), key=lambda f: (to_target[f], [-ord(x) for x in f]))
            gone[loser] = a if loser == b else b
    rows = [(f, float(to_target[f]), f not in gone, gone.get(f)) for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, target_r double, kept boolean, dropped_for string")


Score = Callable[[Sequence[str]], float]


def drop_correlated_by_model(df: DataFrame, features: Sequence[str], score: Score, limit: float = 0.95) -> DataFrame:
    """(feature, kept, dropped_for, score_without): of each pair of features correlated above ``limit``, from the strongest on, the one
    without which the model of all features still kept scores better goes (ties: the later name), unless its partner has gone already."""
    found = {(r["col_a"], r["col_b"]): abs(r["r"] or 0.0) for r in correlations(df, features).collect()}  # of bounded columns
    kept, gone = list(features), {}
    for r, a, b in sorted(((found[a, b], a, b) for a, b in itertools.combinations(features, 2)), key=lambda p: (-p[0], p[1], p[2])):
        if r > limit and a in kept and b in kept:
            without = {f: score([k for k in kept if k != f]) for f in (a, b)}
            loser = max((a, b), key=lambda f: (without[f], f))
            gone[loser] = (a if loser == b else b, without[loser])
            kept.remove(loser)
    rows = [(f, f in kept, *gone.get(f, (None, None))) for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, kept boolean, dropped_for string, score_without double")


def roles(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The chosen columns, features first, and (column_name, role, type) of each; a column can't be both, and must be there."""
    both = set(features) & set(targets)
    if both:
        raise ValueError(f"both feature and target: {sorted(both)}")
    kinds = dict(df.dtypes)
    absent = [c for c in (*features, *targets) if c not in kinds]
    if absent:
        raise ValueError(f"no such column: {absent}")
    rows = [(c, role, kinds[c]) for role, names in (("feature", features), ("target", targets)) for c in names]
    return df.select(*features, *targets), df.sparkSession.createDataFrame(rows, "column_name string, role string, type string")


def least_squares_score(df: DataFrame, features: Sequence[str], target: str) -> Score:
    """R squared of least squares for any subset of ``features``, all from one aggregate of second moments."""
    import numpy as np

    names = [*features, target]
    full = df.select(*names).dropna()
    row = full.agg(*[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    gram = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))])

    def score(subset: Sequence[str]) -> float:
        at = [names.index(f) for f in subset]
        if not at or gram[-1, -1] == 0:
            return 0.0
        w = scaled_solution(gram[np.ix_(at, at)], gram[at, -1])
        return float(w @ gram[at, -1] / gram[-1, -1])

    return score


def subset_fold_scores(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], folds: int = 3, subsets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """(subset, fold, n_rows, rmse): how far least squares on each subset (all, of at most 15 features, unless given) miss the rows of a fold when they
    are fitted to the other folds. Folds come from an md5 of the keys. One aggregate gives counts, means and covariances by fold; those of the
    other folds together, and the misses, follow from them without another pass. Rows with a missing value are left out."""
    import numpy as np

    names = [*features, target]
    if subsets is None:
        if len(features) > MAX_EXHAUSTIVE:
            raise ValueError(f"at most {MAX_EXHAUSTIVE} features")
        subsets = [s for k in range(1, len(features) + 1) for s in itertools.combinations(features, k)]
    full = df.withColumn("_fold", fold(keys, folds)).select("_fold", *names).dropna()
    pairs = [F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    rows = full.groupBy("_fold").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *pairs).orderBy("_fold").collect()  # a row a fold
    parts = [(r["_fold"], r["n"], np.array([r[f"m{i}"] for i in range(len(names))]), np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])) for r in rows]
    out = []
    for k, n, mean, cov in parts:
        others = [p for p in parts if p[0] != k]
        if not others:
            continue
        total = sum(p[1] for p in others)
        centre = sum(p[1] * p[2] for p in others) / total
        inside = sum(p[1] * (p[3] + np.outer(p[2] - centre, p[2] - centre)) for p in others) / total
        here = cov + np.outer(mean - centre, mean - centre)
        for subset in subsets:
            at = [names.index(f) for f in subset]
            w = scaled_solution(inside[np.ix_(at, at)], inside[at, -1])
            v, own = np.append(-w, 1.0), [*at, len(names) - 1]
            out.append((",".join(subset), k, n, float(max(v @ here[np.ix_(own, own)] @ v, 0.0) ** 0.5)))
    return df.sparkSession.createDataFrame(out, "subset string, fold int, n_rows long, rmse double")


def exhaustive(features: Sequence[str], score: Score) -> list[tuple[tuple[str, ...], float]]:
    """Every subset with its score, best first; at most 15 features."""
    if len(features) > MAX_EXHAUSTIVE:
        raise ValueError(f"at most {MAX_EXHAUSTIVE} features")
    found = [(s, score(s)) for k in range(1, len(features) + 1) for s in itertools.combinations(features, k)]
    return sorted(found, key=lambda x: (-x[1], len(x[0]), x[0]))


def sequential(features: Sequence[str], score: Score, forward: bool = True, size: int | None = None) -> list[tuple[str, float]]:
    """Greedy steps: the feature that is added (or removed) and the score after it, up to ``size`` features (down to it)."""
    chosen = [] if forward else list(features)
    size = size if size is not None else (len(features) if forward else 1)
    steps = []
    while len(chosen) != size:
        options = [f for f in features if (f in chosen) != forward]
        after = {f: score([*chosen, f] if forward else [c for c in chosen if c != f]) for f in options}
        best = min(options, key=lambda f: (-after[f], f))
        chosen = [*chosen, best] if forward else [c for c in chosen if c != best]
        steps.append((best, after[best]))
    return steps
