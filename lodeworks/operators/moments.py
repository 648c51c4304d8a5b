"""Linear models of many sets of rows, all from one aggregate of second moments by cell of rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, NumericType

from lodeworks.operators.prepare import scaled_solution

#: Parameters of a linear model under which it depends on rows by their moments alone; this leaves out other losses and solvers.
PARAMETERS = {"regParam", "elasticNetParam", "fitIntercept", "standardization", "maxIter", "tol"}
#: The least share of a feature's variance, by axes of all, below which features are held to depend on each other.
DEPENDENT = 1e-10
#: Columns whose products one aggregate sums; wider tables are fitted row by row.
WIDEST = 40


class Training(NamedTuple):
    """What a model of some cells is fitted to: rows in place of theirs, of the same mean and covariance, and the map that prepares their features."""

    rows: DataFrame
    prepare: np.ndarray
    target: np.ndarray


class Moments:
    """Sums of products of [1, whether each feature with gaps is there, each feature less its mean over all rows (0 where missing), what a plane
    through all rows leaves of the target], by cell. As the plane is taken off first, misses of a close fit aren't lost in the sums."""

    def __init__(self, spark: SparkSession, centre: np.ndarray, plane: np.ndarray, present: Sequence[int], rows: Iterable) -> None:
        self.spark, self.centre, self.plane = spark, centre, plane
        self.p, self.present = len(plane), list(present)  # the place of what says that a feature is there: 0, the ones, if it always is
        self.width = max(self.present, default=0) + self.p + 2
        self.values = np.arange(self.width - self.p - 1, self.width - 1)
        self.sums, self.ends = {}, {}
        for r in rows:
            upper = np.zeros((self.width, self.width))
            upper[np.triu_indices(self.width)] = r["sums"]
            self.sums[r["cell"]] = upper + np.triu(upper, 1).T
            self.ends[r["cell"]] = np.array([[np.nan if v is None else v for v in r[k]] for k in ("least", "most")])

    def over(self, cells: Sequence[int]) -> np.ndarray:
        return sum((self.sums[c] for c in cells if c in self.sums), np.zeros((self.width, self.width)))

    def training(self, cells: Sequence[int]) -> Training | None:
        """Missing values are the mean of the rows' own values, and features have standard scores, as in ``model.pipeline``; constant features, of
        no weight there, are left out. None where there are no rows, no value of a feature, no feature that varies, or where features depend on
        each other: the solver then comes to weights that its path decides, not the moments."""
        sums, p = self.over(cells), self.p
        if (sums[0, [0, *self.present]] <= 0).any():
            return None
        n, features = sums[0, 0], range(p)
        shift = sums[0, self.values] / sums[0, self.present]
        prepare = np.zeros((p + 1, self.width))
        prepare[features, self.values] = 1
        prepare[features, self.present] -= shift
        prepare[p, self.values], prepare[p, -1] = self.plane, 1
        target = prepare[p].copy()
        mean = target @ sums[0] / n
        prepare[p, 0] -= mean
        cov = prepare @ sums @ prepare.T / n
        ends = [self.ends[c] for c in cells if c in self.ends]
        varies = (np.fmax.reduce([e[1] for e in ends]) > np.fmin.reduce([e[0] for e in ends])) & (np.diag(cov) > 0)
        kept = np.flatnonzero(varies[:p])
        if not len(kept):
            return None
        at = [*kept, p]
        size = np.sqrt(np.where(varies, np.diag(cov), 1))[at]
        shape = np.where(np.outer(varies[at], varies[at]), cov[np.ix_(at, at)], 0) / np.outer(size, size)
        if np.linalg.eigvalsh(shape[:-1, :-1])[0] < DEPENDENT:
            return None
        values, axes = np.linalg.eigh(shape)
        # Points on either side of the mean along each axis of the covariance, as far as gives that covariance.
        axes = (axes * np.sqrt(np.maximum(values, 0) * len(at))).T
        points = np.vstack([axes, -axes])
        whole = np.sqrt((n - 1) / n)  # standard scores are by the deviation of a sample
        rows = [((r[:-1] * whole).tolist(), float(self.centre[p] + mean + r[-1] * size[-1])) for r in points]
        table = self.spark.createDataFrame(rows, "x array<double>, label double").coalesce(1)
        return Training(table.select(array_to_vector("x").alias("features"), "label"), prepare[kept] * (whole / size[:-1])[:, None], target)

    def rmse(self, training: Training, parameters: Mapping, cells: Sequence[int]) -> float:
        """How far the linear model of ``training`` misses the rows of ``cells``."""
        fitted = LinearRegression(**parameters).fit(training.rows)
        miss = training.target - fitted.coefficients.toArray() @ training.prepare
        miss[0] += self.centre[self.p] - fitted.intercept
        sums = self.over(cells)
        return float(np.sqrt(max(miss @ sums @ miss, 0.0) / sums[0, 0]))


def moments(df: DataFrame, features: Sequence[str], target: str, cell: str) -> Moments | None:
    """The moments by ``cell``, in two passes; None where rows have to be fitted themselves: there are none, the target has gaps, values are
    infinite, features with gaps aren't doubles (their means would be cut to their type), aren't numbers or are too many."""
    kinds, p = {f: df.schema[f].dataType for f in features}, len(features)
    if not p or len(set(features)) < p or any(not isinstance(df.schema[c].dataType, NumericType) or isinstance(df.schema[c].dataType, DecimalType) for c in (*features, target)) or p + 2 > WIDEST:
        return None
    number = [F.col(f"`{c}`").cast("double") for c in (*features, target)]
    number = [F.when(~F.isnan(c), c) for c in number]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.count(c) for c in number]).alias("there"), F.array(*[F.avg(c) for c in number]).alias("centre"), F.array(*[F.covar_pop(number[i], number[j]) for i, j in pairs]).alias("cov")).first()
    if not whole["n"] or whole["there"][p] < whole["n"] or 0 in whole["there"]:
        return None
    gaps = [i for i in range(p) if whole["there"][i] < whole["n"]]
    centre, cov = np.array(whole["centre"]), np.zeros((p + 1, p + 1))
    for (i, j), v in zip(pairs, whole["cov"]):
        cov[i, j] = cov[j, i] = v or 0.0  # null where two features are never there together
    if any(not isinstance(kinds[features[i]], DoubleType) for i in gaps) or not (np.isfinite(centre).all() and np.isfinite(cov).all()) or len(gaps) + p + 2 > WIDEST:
        return None
    plane = scaled_solution(cov[:p, :p], cov[:p, p])
    values = [F.coalesce(c - float(m), F.lit(0.0)) for c, m in zip(number, centre)]
    left = values[p] - sum((float(w) * v for w, v in zip(plane, values)), F.lit(0.0))
    parts = [F.lit(1.0), *[number[i].isNotNull().cast("double") for i in gaps], *values[:p], left]
    cut = df.select(F.col(cell).alias("cell"), *[c.alias(f"v{i}") for i, c in enumerate(parts)], *[c.alias(f"x{i}") for i, c in enumerate(number)])
    products = [F.sum(F.col(f"v{i}") * F.col(f"v{j}")) for i in range(len(parts)) for j in range(i, len(parts))]
    ends = [F.array(*[end(f"x{i}") for i in range(p + 1)]) for end in (F.min, F.max)]
    rows = cut.groupBy("cell").agg(F.array(*products).alias("sums"), ends[0].alias("least"), ends[1].alias("most")).orderBy("cell").collect()  # a row a cell
    if not all(np.isfinite(r["sums"]).all() for r in rows):
        return None
    return Moments(df.sparkSession, centre, np.array(plane), [gaps.index(i) + 1 if i in gaps else 0 for i in range(p)], rows)
