"""Cleaning and preparation: outliers, missing values, scaling, encoding, history.

Statistics are fitted by one eager aggregate and enter the plan as constants, so the rows themselves stream through
without a shuffle. Null and NaN both count as missing; a missing value is never an outlier.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.quantiles import exact_quantiles
from lodeworks.functions.scalars import clean, inverse_normal_cdf, yeo_johnson
from lodeworks.functions.storage import materialised


def _number(x: float | None) -> Column:
    return F.lit(x).cast("double")


# Outliers


def iqr_fences(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> dict[str, tuple[float | None, float | None]]:
    """Lower and upper fence of each column: ``k`` ranges between quartiles beyond them (1.5: Tukey's convention)."""
    q = exact_quantiles(df, {c: (0.25, 0.75) for c in cols})
    return {c: (None, None) if a is None else (a - k * (b - a), b + k * (b - a)) for c, (a, b) in q.items()}


def zscore_fences(df: DataFrame, cols: Sequence[str], limit: float = 3.0, ddof: int = 0) -> dict[str, tuple[float | None, float | None]]:
    """Mean minus and plus ``limit`` standard deviations."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = df.agg(*[x for c in cols for x in (F.avg(clean(F.col(c))).alias(f"m_{c}"), std(clean(F.col(c))).alias(f"s_{c}"))]).first()
    return {c: (None, None) if row[f"s_{c}"] is None else (row[f"m_{c}"] - limit * row[f"s_{c}"], row[f"m_{c}"] + limit * row[f"s_{c}"]) for c in cols}


Fences = Mapping[str, tuple[float | None, float | None]]


def outside(col: str, fence: tuple[float | None, float | None]) -> Column:
    """True for a value beyond its fence, false for others and for missing ones."""
    x = clean(F.col(col))
    return F.coalesce((x < _number(fence[0])) | (x > _number(fence[1])), F.lit(False))


def count_outliers(df: DataFrame, fences: Fences) -> DataFrame:
    """(column_name, lo, hi, n_outliers)"""
    one = df.agg(*[F.count(F.when(outside(c, f), 1)).alias(f"n_{i}") for i, (c, f) in enumerate(fences.items())])
    cells = [F.struct(F.lit(c).alias("column_name"), _number(lo).alias("lo"), _number(hi).alias("hi"), F.col(f"n_{i}").alias("n_outliers")) for i, (c, (lo, hi)) in enumerate(fences.items())]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def drop_outliers(df: DataFrame, fences: Fences) -> DataFrame:
    """Rows without an outlier in any of the columns."""
    for c, f in fences.items():
        df = df.where(~outside(c, f))
    return df


def blank_outliers(df: DataFrame, fences: Fences) -> DataFrame:
    """Outliers become missing."""
    return df.withColumns({c: F.when(~outside(c, f), F.col(c)) for c, f in fences.items()})


def replace_outliers(df: DataFrame, fences: Fences, by: str = "median") -> DataFrame:
    """Outliers become the mean or median of the values that are none."""
    return df.withColumns({c: F.when(outside(c, f), _number(centre)).otherwise(clean(F.col(c))) for (c, f), centre in zip(fences.items(), centres(blank_outliers(df, fences), list(fences), by).values())})


def cap(df: DataFrame, cols: Sequence[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Values are held between their exact ``lo`` and ``hi`` quantiles; missing ones stay missing."""
    q = exact_quantiles(df, {c: (lo, hi) for c in cols})
    return df.withColumns({c: F.when(clean(F.col(c)).isNotNull(), F.greatest(F.least(clean(F.col(c)), _number(q[c][1])), _number(q[c][0]))) for c in cols})


# Missing values


def centres(df: DataFrame, cols: Sequence[str], by: str) -> dict[str, float | None]:
    """mean, exact median or mode (the smallest of the most frequent values) of each column."""
    if by == "median":
        return {c: v[0] for c, v in exact_quantiles(df, {c: (0.5,) for c in cols}).items()}
    if by == "mean":
        row = df.agg(*[F.avg(clean(F.col(c))).alias(c) for c in cols]).first()
        return {c: row[c] for c in cols}
    return {c: mode(df, c) for c in cols}


def mode(df: DataFrame, col: str):
    """The most frequent value, the smallest of several; counts are taken before any row moves."""
    x = clean(F.col(col)) if dict(df.dtypes)[col] in ("double", "float") else F.col(col)
    row = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n")).alias("m"), F.count(F.lit(1)).alias("c")).first()
    if not row["c"]:
        return None
    counts = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") == row["m"]["n"]).agg(F.min("v").alias("v")).first()["v"]


def impute(df: DataFrame, cols: Sequence[str], by: str = "median") -> DataFrame:
    """Missing values become the mean, median or mode of their column; a column without values stays missing."""
    found = centres(df, cols, by)
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(clean(F.col(c)) if kinds[c] in ("double", "float") else F.col(c), F.lit(found[c])) for c in cols})


def impute_iterative(df: DataFrame, cols: Sequence[str], rounds: int = 3) -> DataFrame:
    """Missing values of each column are predicted by least squares from the other columns, in turn, ``rounds`` times, from
    means. Each fit is one aggregate of second moments; what was observed is never changed."""
    missing = {c: clean(F.col(c)).isNull() for c in cols}
    own = df.select("*", *[missing[c].alias(f"_missing_{c}") for c in cols])
    means = centres(df, cols, "mean")
    current: dict[str, Column] = {c: F.coalesce(clean(F.col(c)), _number(means[c])) for c in cols}
    own = own.withColumns({f"_x_{c}": current[c] for c in cols})
    for _ in range(rounds):
        for c in cols:
            others = [o for o in cols if o != c]
            weights = least_squares(own.where(~F.col(f"_missing_{c}")), [f"_x_{o}" for o in others], f"_x_{c}")
            guess = sum((F.col(f"_x_{o}") * w for o, w in zip(others, weights[1:])), _number(weights[0]))
            own = own.withColumn(f"_x_{c}", F.when(F.col(f"_missing_{c}"), guess).otherwise(F.col(f"_x_{c}")))
        own = materialised(own, "imputed")  # else every round computes those before it again
    return own.select(*[F.col(f"_x_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def scaled_solution(gram, products):
    """The least-squares solution of gram @ w = products, with columns scaled to one size first, so that small ones count."""
    import numpy as np

    size = np.sqrt(np.diag(gram))
    size[size == 0] = 1
    return np.linalg.lstsq(gram / np.outer(size, size), products / size, rcond=1e-12)[0] / size


def least_squares(df: DataFrame, features: Sequence[str], target: str) -> list[float]:
    """Intercept and weights. One aggregate of centred products, and a system of len(features) equations on the driver."""
    import numpy as np

    names = [*features, target]
    full = df.select(*[clean(F.col(c)).alias(c) for c in names]).dropna()
    means = full.agg(*[F.avg(c).alias(c) for c in names]).first()
    if means[target] is None:
        return [0.0] * (len(features) + 1)
    p = len(names)
    products = [F.sum((F.col(names[i]) - means[names[i]]) * (F.col(names[j]) - means[names[j]])).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]
    row = full.agg(*products).first()
    gram = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    w = scaled_solution(gram[:-1, :-1], gram[:-1, -1])
    return [float(means[target] - sum(a * means[c] for a, c in zip(w, features))), *map(float, w)]


# Scaling


@dataclass
class Scaler:
    """Columns as (x - shift) / width, fitted once and applied to any table. Width 0 (a constant column) gives 0."""

    shift: dict[str, float | None]
    width: dict[str, float | None]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.when(clean(F.col(c)).isNotNull(), F.lit(0.0) if not self.width[c] else (clean(F.col(c)) - _number(self.shift[c])) / self.width[c]) for c in self.shift})

    def restore(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * (self.width[c] or 0.0) + _number(self.shift[c]) for c in self.shift})


def fit_standard(df: DataFrame, cols: Sequence[str], ddof: int = 0) -> Scaler:
    """Mean 0 and standard deviation 1 (of the population by default)."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = df.agg(*[x for c in cols for x in (F.avg(clean(F.col(c))).alias(f"m_{c}"), std(clean(F.col(c))).alias(f"s_{c}"))]).first()
    return Scaler({c: row[f"m_{c}"] for c in cols}, {c: row[f"s_{c}"] for c in cols})


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> Scaler:
    """0 for the smallest value, 1 for the largest."""
    row = df.agg(*[x for c in cols for x in (F.min(clean(F.col(c))).alias(f"a_{c}"), F.max(clean(F.col(c))).alias(f"b_{c}"))]).first()
    return Scaler({c: row[f"a_{c}"] for c in cols}, {c: None if row[f"a_{c}"] is None else row[f"b_{c}"] - row[f"a_{c}"] for c in cols})


def fit_robust(df: DataFrame, cols: Sequence[str]) -> Scaler:
    """Median 0, and the range between the exact quartiles 1."""
    q = exact_quantiles(df, {c: (0.25, 0.5, 0.75) for c in cols})
    return Scaler({c: v[1] for c, v in q.items()}, {c: None if v[0] is None else v[2] - v[0] for c, v in q.items()})


def yeo_johnson_power(df: DataFrame, col: str, lo: float = -2.0, hi: float = 4.0, rounds: int = 5, points: int = 9) -> float:
    """The power of the largest likelihood, by ``rounds`` grids of ``points`` each inside the last one's best cell; every
    grid is one aggregate."""
    import math

    x = clean(F.col(col))
    for _ in range(rounds):
        grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
        row = df.agg(F.count(x).alias("n"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("jacobian"), *[F.var_pop(yeo_johnson(x, p)).alias(f"v{i}") for i, p in enumerate(grid)]).first()
        if not row["n"]:
            return 1.0
        fit = [-row["n"] / 2 * math.log(max(row[f"v{i}"], 1e-300)) + (p - 1) * row["jacobian"] for i, p in enumerate(grid)]
        best = max(range(points), key=lambda i: fit[i])
        lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, points - 1)]
    return (lo + hi) / 2


def power_transform(df: DataFrame, powers: Mapping[str, float]) -> DataFrame:
    """The Yeo-Johnson transform of each column with its power."""
    return df.withColumns({c: yeo_johnson(clean(F.col(c)), p) for c, p in powers.items()})


def quantile_transform(df: DataFrame, col: str, out: str = "quantile", normal: bool = False, clip: float = 1e-7) -> DataFrame:
    """Adds each row's share of the values below its own among all others: 0 for the smallest, 1 for the largest, ties alike,
    missing stays missing; with ``normal`` the value of a standard normal variate at that share, which is held between ``clip`` and 1 - ``clip``.
    Ranks are taken over distinct values in ranges, and joined to the rows by value."""
    from lodeworks.functions.running import running

    x = clean(F.col(col))
    counts = df.where(x.isNotNull()).groupBy(x.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    ranks = running(counts, "_v", {"_below": (F.sum, "_n")}).join(F.broadcast(total)).select("_v", (F.coalesce("_below", F.lit(0)) / F.greatest(F.col("_all") - 1, F.lit(1))).alias(out))
    if normal:
        ranks = ranks.withColumn(out, inverse_normal_cdf(F.least(F.greatest(out, F.lit(clip)), F.lit(1 - clip))))
    return df.withColumn("_x", x).join(ranks, F.col("_x") == F.col("_v"), "left").drop("_x", "_v")


# Encoding


@dataclass
class Encoding:
    """The categories of each encoded column, in order. Unseen and missing categories encode as all zero, or as null."""

    categories: dict[str, list[str]]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], most: int = 10_000) -> Encoding:
        """Distinct values in order of their text. ``most`` guards the driver: a wider column raises, it is no category."""
        found = {}
        for c in cols:
            values = [r[0] for r in df.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().limit(most + 1).collect()]
            if len(values) > most:
                raise ValueError(f"{c} has more than {most} categories")
            found[c] = sorted(values)
        return cls(found)

    def encoded_name(self, col: str, category: str) -> str:
        return f"{col}_{category}"

    def one_hot(self, df: DataFrame) -> DataFrame:
        """Each column is replaced by a 0/1 column for each category."""
        kept = [F.col(c) for c in df.columns if c not in self.categories]
        return df.select(*kept, *[F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0)).alias(self.encoded_name(c, v)) for c, values in self.categories.items() for v in values])

    def labels(self, df: DataFrame) -> DataFrame:
        """Each column is replaced by its category's number, from 0."""
        at = lambda c: F.array_position(F.array(*[F.lit(v) for v in self.categories[c]]), F.col(c).cast("string"))
        return df.withColumns({c: F.nullif(at(c), F.lit(0)) - 1 for c in self.categories})

    def mapping(self, df: DataFrame) -> DataFrame:
        """(original, category, encoded, readable) of every encoded column. ``df`` gives the session."""
        rows = [(c, v, self.encoded_name(c, v), f"{c}: {v}") for c, values in self.categories.items() for v in values]
        return df.sparkSession.createDataFrame(rows, "original string, category string, encoded string, readable string")


def readable_names(names: DataFrame, mapping: DataFrame, col: str = "feature") -> DataFrame:
    """Adds ``readable``; a name that is not in the mapping stays as it is. Names are joined, never split: they may hold '_'."""
    known = F.broadcast(mapping.select(F.col("encoded").alias("_encoded"), F.col("readable").alias("_readable")))  # of bounded categories
    return names.join(known, names[col] == F.col("_encoded"), "left").withColumn("readable", F.coalesce("_readable", col)).drop("_encoded", "_readable")


# History


@dataclass
class History:
    """Undo and redo over lazy tables, with a log of the steps. Nothing is computed or copied by a step."""

    current: DataFrame
    done: list[tuple[str, DataFrame]] = field(default_factory=list)
    undone: list[tuple[str, DataFrame]] = field(default_factory=list)
    steps: list[tuple[int, str, str]] = field(default_factory=list)

    def apply(self, name: str, step, **parameters) -> DataFrame:
        self.done.append((name, self.current))
        self.undone.clear()
        self.current = step(self.current, **parameters)
        self._note(name, str(parameters))
        return self.current

    def undo(self) -> DataFrame:
        if self.done:
            name, before = self.done.pop()
            self.undone.append((name, self.current))
            self.current = before
            self._note("undo", name)
        return self.current

    def redo(self) -> DataFrame:
        if self.undone:
            name, after = self.undone.pop()
            self.done.append((name, self.current))
            self.current = after
            self._note("redo", name)
        return self.current

    def _note(self, op: str, parameters: str) -> None:
        self.steps.append((len(self.steps) + 1, op, parameters))

    def log(self) -> DataFrame:
        return self.current.sparkSession.createDataFrame(self.steps, "step int, operation string, parameters string")
