"""Models that Spark ML lacks, fitted by gradients that are sums over all rows: kernel machines, one-class machines, a regression
network, and Gaussian-process surrogates on random features.

Features are standardised by one aggregate. A round is one pass: parameters, of fixed size, go to the tasks; a task adds up the gradient of
its rows, and the sums are added up by a shuffle of one row for each parameter and task. Fitting reads a table of features and target that is
written once, with a row for equal ones and their number where that makes it much shorter. Scoring is a vectorised function of the row.

Kernels are random Fourier features: the inner product of cos(w x + b) times sqrt(2 / D) over D draws of w and b has the Gaussian kernel
exp(-gamma |x - y|^2) as its mean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.quantiles import exact_quantiles
from lodeworks.functions.scalars import clean
from lodeworks.functions.storage import materialised

#: Rows that a task takes at a time.
CHUNK = 2048
#: Ranges of scores that a one-class round tells apart.
SCORES = 64
#: Equal rows become one with a weight where there are at least so many rows for each distinct one.
COPIES = 4


@dataclass
class Features:
    """How columns become a matrix: standardised, then mapped to random features, or left as they are with a one in front."""

    cols: list[str]
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray | None = None
    b: np.ndarray | None = None

    @property
    def width(self) -> int:
        return len(self.cols) + 1 if self.w is None else self.w.shape[1]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = self.standard(x)
        if self.w is None:
            return np.concatenate([np.ones((len(z), 1)), z], 1)
        return np.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b)


def features_of(df: DataFrame, cols: Sequence[str], draws: int | None = 128, gamma: float | None = None, seed: int = 0) -> Features:
    """Means and deviations of the columns over all rows (missing values left out), and ``draws`` random features of the Gaussian kernel, whose ``gamma``
    is one over the number of columns unless given; with ``draws`` None plain columns."""
    row = df.agg(*[f(clean(F.col(c))).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(len(cols))])
    scale = np.array([row[f"s{i}"] or 1.0 for i in range(len(cols))])
    if draws is None:
        return Features(list(cols), mean, scale)
    rng, gamma = np.random.default_rng(seed), gamma or 1 / len(cols)
    return Features(list(cols), mean, scale, rng.normal(0, np.sqrt(2 * gamma), (len(cols), draws)), rng.uniform(0, 2 * np.pi, draws))


def table_of(df: DataFrame, cols: Sequence[str], target: str | None = None) -> DataFrame:
    """(x array, y, w) of the rows without a missing value, written once; ``w`` rows are equal to this one."""
    x = F.array(*[clean(F.col(c)) for c in cols])
    y = clean(F.col(target)) if target else F.lit(0.0)
    rows = df.select(x.alias("x"), y.alias("y"))
    rows = materialised(rows.where(~F.exists("x", lambda v: v.isNull()) & F.col("y").isNotNull()), "training")
    n, distinct = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("x", "y"))).first()
    if n < COPIES * distinct:
        return rows.withColumn("w", F.lit(1.0))
    return materialised(rows.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")), "distinct-training")


def rows_of(table: DataFrame) -> float:
    """How many rows the table of ``table_of`` stands for, 1 at least."""
    return max(1.0, table.agg(F.sum("w")).first()[0] or 0.0)


def spread_of(table: DataFrame) -> tuple[float, float]:
    """Mean and deviation of the target; 0 and 1 where there are none."""
    mean = table.agg(F.sum(F.col("w") * F.col("y")) / F.sum("w")).first()[0] or 0.0
    square = table.agg(F.sum(F.col("w") * (F.col("y") - mean) * (F.col("y") - mean)) / F.sum("w")).first()[0] or 0.0
    return mean, square**0.5 or 1.0


def summed(table: DataFrame, size: int, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``part``(x, y, w), an array of ``size`` numbers for a chunk of rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                own = batch.slice(lo, CHUNK)
                x = own.column(0).flatten().to_numpy().reshape(own.num_rows, -1)
                total += part(x, own.column(1).to_numpy(), own.column(2).to_numpy())
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "v"])

    out = np.zeros(size)
    for i, v in table.mapInArrow(work, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # a row for each parameter
        out[i] = v
    return out


def descended(table: DataFrame, start: np.ndarray, gradient: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], penalty: Callable[[np.ndarray], np.ndarray], rounds: int, rate: float, shrink: bool = True) -> np.ndarray:
    """Parameters after ``rounds`` passes of Adam over the mean of ``gradient``(parameters, x, y, w) plus the gradient of a penalty; ``shrink``: steps shrink
    with the root of the round, as losses with edges need."""
    n = rows_of(table)
    theta, first, second = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, rounds + 1):
        own = table.sparkSession.sparkContext.broadcast(theta)
        g = summed(table, len(theta), lambda x, y, w, own=own: gradient(own.value, x, y, w)) / n + penalty(theta)
        own.unpersist()
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - rate / (np.sqrt(t) if shrink else 1.0) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return theta


def _applied(df: DataFrame, cols: Sequence[str], name: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``df`` with f of the columns; null where one of them is missing."""

    @F.pandas_udf("double")
    def value(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in columns], 1)
        whole = np.isfinite(x).all(1)
        return pd.Series(np.where(whole, f(np.where(whole[:, None], x, 0.0)), np.nan))

    return df.withColumn(name, value(*[clean(F.col(c)) for c in cols])).withColumn(name, F.when(~F.isnan(name), F.col(name)))


# Kernel machines


@dataclass
class Machine:
    """A linear function of features; ``rho`` is the offset of a one-class machine, ``spread`` the unit of a regression target."""

    features: Features
    weights: np.ndarray
    rho: float = 0.0
    centre: float = 0.0
    spread: float = 1.0

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """``df`` with the decision value, or the predicted target."""
        return _applied(df, self.features.cols, name, lambda x: (self.features(x) @ self.weights[: self.features.width] + (self.weights[-1] if len(self.weights) > self.features.width else 0.0) - self.rho) * self.spread + self.centre)


def hinge_gradient(map_: Features, theta: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray | float = 1.0) -> np.ndarray:
    """Of the sum, weighted by ``w``, of max(0, 1 - s (v z + b)), s = 1 for y > 0 and -1 else; theta is v and then b."""
    z, s = map_(x), np.where(y > 0, 1.0, -1.0)
    short = -s * w * (1 - s * (z @ theta[:-1] + theta[-1]) > 0)
    return np.append(short @ z, short.sum())


def tube_gradient(map_: Features, epsilon: float, theta: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray | float = 1.0) -> np.ndarray:
    """Of the sum, weighted by ``w``, of max(0, |v z + b - y| - epsilon)."""
    z = map_(x)
    miss = z @ theta[:-1] + theta[-1] - y
    side = w * np.sign(miss) * (np.abs(miss) > epsilon)
    return np.append(side @ z, side.sum())


def lowest_sums(map_: Features, v: np.ndarray, x: np.ndarray, w: np.ndarray | float = 1.0) -> np.ndarray:
    """For each of SCORES ranges of the score v z the number of rows in it and the sum of their features, weighted by ``w``."""
    z = map_(x)
    reach = np.sqrt(2 * (v * v).sum()) + 1e-12  # no score is farther from 0
    at = np.clip(((z @ v / reach + 1) * (SCORES / 2)).astype(int), 0, SCORES - 1)
    out, order = np.zeros((SCORES, len(v) + 1)), np.argsort(at, kind="stable")
    first = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
    own = np.broadcast_to(w, len(z))[order]
    out[at[order][first]] = np.add.reduceat(np.concatenate([own[:, None], z[order] * own[:, None]], 1), first)
    return out.ravel()


def mean_of_lowest(sums: np.ndarray, share: float) -> np.ndarray:
    """The mean feature of the ``share`` of rows with the lowest scores, a range that only some of them are in taken in part."""
    ranges = sums.reshape(SCORES, -1)
    n = ranges[:, 0]
    left = np.clip(share * n.sum() - np.concatenate([[0.0], np.cumsum(n)[:-1]]), 0, n)
    return ((left / np.maximum(n, 1))[:, None] * ranges[:, 1:]).sum(0) / max(share * n.sum(), 1e-300)


def kernel_machine(df: DataFrame, cols: Sequence[str], target: str, task: str = "classification", draws: int | None = 128, gamma: float | None = None, penalty: float = 1e-3, epsilon: float = 0.1, rounds: int = 60, rate: float = 0.3, seed: int = 0) -> Machine:
    """A support vector machine with the Gaussian kernel (``draws`` None: linear), over numeric columns: for ``classification`` of a target above 0 or not, or for
    ``regression`` within a tube of ``epsilon`` standard deviations of the target. ``penalty`` weighs half the squared length of the weights. Rows with a
    missing value are not learned from."""
    map_, table = features_of(df, cols, draws, gamma, seed), table_of(df, cols, target)
    centre, spread = 0.0, 1.0
    if task == "regression":
        centre, spread = spread_of(table)
        loss = lambda theta, x, y, w: tube_gradient(map_, epsilon, theta, x, (y - centre) / spread, w)
    else:
        loss = lambda theta, x, y, w: hinge_gradient(map_, theta, x, y, w)
    theta = descended(table, np.zeros(map_.width + 1), loss, lambda t: np.append(penalty * t[:-1], 0.0), rounds, rate)
    return Machine(map_, theta, 0.0, centre, spread)


def one_class_machine(df: DataFrame, cols: Sequence[str], nu: float = 0.05, draws: int = 128, gamma: float | None = None, rounds: int = 20, seed: int = 0) -> Machine:
    """A one-class support vector machine with the Gaussian kernel: about a share of ``nu`` of the rows has a score below 0. Weights start at the mean
    of the features, and each round moves them towards the mean of the ``nu`` rows with the lowest scores as far as that shortens them: to the shortest
    vector among the means of all ways to weigh rows, none with more than 1 / (nu n). The offset is the exact quantile of all scores."""
    map_, table = features_of(df, cols, draws, gamma, seed), table_of(df, cols)
    w = summed(table, map_.width, lambda x, _, n: n @ map_(x)) / rows_of(table)
    for _ in range(rounds):
        own = table.sparkSession.sparkContext.broadcast(w)
        sums = summed(table, SCORES * (map_.width + 1), lambda x, _, n, own=own: lowest_sums(map_, own.value, x, n))
        own.unpersist()
        step = w - mean_of_lowest(sums, nu)  # a subgradient of half the squared length less the mean of the lowest scores
        length = float((step * step).sum())
        w = w - min(1.0, max(0.0, float((w * step).sum()) / max(length, 1e-300))) * step
    found = Machine(map_, w)
    limit = exact_quantiles(materialised(found.score(df).select("score"), "scores"), {"score": [nu]})["score"][0]
    return Machine(map_, w, limit or 0.0)


def one_class_outliers(df: DataFrame, cols: Sequence[str], nu: float = 0.05, **options) -> DataFrame:
    """``df`` with ``score`` and ``is_outlier``, of which about a share of ``nu`` is true; both null where a column is missing."""
    return one_class_machine(df, cols, nu, **options).score(df).withColumn("is_outlier", F.col("score") < 0)


# A regression network


def _split(theta: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def network_output(theta: np.ndarray, sizes: Sequence[int], z: np.ndarray) -> np.ndarray:
    layers = _split(theta, sizes)
    for w, b in layers[:-1]:
        z = np.tanh(z @ w + b)
    return (z @ layers[-1][0] + layers[-1][1])[:, 0]


def network_gradient(theta: np.ndarray, sizes: Sequence[int], z: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0) -> np.ndarray:
    """Of half the sum of squared errors, weighted by ``n``."""
    layers, held = _split(theta, sizes), [z]
    for w, b in layers[:-1]:
        held.append(np.tanh(held[-1] @ w + b))
    back = (held[-1] @ layers[-1][0] + layers[-1][1] - y[:, None]) * np.reshape(n, (-1, 1))
    parts = []
    for (w, _), inner in zip(reversed(layers), reversed(held)):
        parts += [back.sum(0), (inner.T @ back).ravel()]
        back = back @ w.T * (1 - inner**2)
    return np.concatenate(parts[::-1])


@dataclass
class Network:
    features: Features
    theta: np.ndarray
    sizes: list[int]
    centre: float
    spread: float

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return _applied(df, self.features.cols, name, lambda x: network_output(self.theta, self.sizes, self.features.standard(x)) * self.spread + self.centre)


def regression_network(df: DataFrame, cols: Sequence[str], target: str, hidden: Sequence[int] = (16,), rounds: int = 150, rate: float = 0.05, penalty: float = 1e-4, seed: int = 0) -> Network:
    """A network of tanh layers for a numeric target, by gradients summed over all rows in each round. Rows with a missing value are not learned from."""
    map_, table = features_of(df, cols, None), table_of(df, cols, target)
    (centre, spread), sizes = spread_of(table), [len(cols), *hidden, 1]
    rng = np.random.default_rng(seed)
    start = np.concatenate([np.append(rng.normal(0, 1 / np.sqrt(a), a * b), np.zeros(b)) for a, b in zip(sizes, sizes[1:])])
    theta = descended(table, start, lambda t, x, y, w: network_gradient(t, sizes, map_.standard(x), (y - centre) / spread, w), lambda t: penalty * t, rounds, rate, shrink=False)
    return Network(map_, theta, sizes, centre, spread)


# Surrogates


@dataclass
class Surrogate:
    """A Bayesian linear model of features: mean and covariance of its weights, and the variance of the noise."""

    features: Features
    mean: np.ndarray
    covariance: np.ndarray
    noise: float

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``mu`` and ``sigma``, the spread of the function at a row, without noise."""
        out = _applied(df, self.features.cols, "mu", lambda x: self.features(x) @ self.mean)
        return _applied(out, self.features.cols, "sigma", lambda x: np.sqrt(np.maximum(((z := self.features(x)) @ self.covariance * z).sum(1), 0)))


def inverse(a: np.ndarray) -> np.ndarray:
    """Of a symmetric positive definite matrix, by elimination, which needs no pivots there."""
    n = len(a)
    both = np.concatenate([a, np.eye(n)], 1)
    for i in range(n):
        both[i] /= both[i, i]
        rest = both[:, i].copy()
        rest[i] = 0
        both -= rest[:, None] * both[i][None]
    return both[:, n:]


def gaussian_surrogate(df: DataFrame, cols: Sequence[str], target: str, draws: int | None = 128, gamma: float | None = None, noise: float = 1.0, prior: float = 1.0, seed: int = 0) -> Surrogate:
    """A Gaussian process with the Gaussian kernel on ``draws`` random features (None: a plane over the standardised columns), fitted to all rows by the
    one matrix of products of features and target. ``noise`` and ``prior`` are the variances of the target around the function and of its weights."""
    map_, table = features_of(df, cols, draws, gamma, seed), table_of(df, cols, target)
    d = map_.width

    def part(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = map_(x)
        own = z * w[:, None]
        return np.append((own.T @ z).ravel(), own.T @ y)

    sums = summed(table, d * d + d, part)
    covariance = inverse(sums[: d * d].reshape(d, d) / noise + np.eye(d) / prior)
    return Surrogate(map_, (covariance * sums[d * d :]).sum(1) / noise, covariance, noise)
