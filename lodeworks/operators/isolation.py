"""Isolation forests: how few random cuts set a row apart.

Every tree is grown on a sample of its own, of fixed size, that a hash of the row's key picks among all rows, so that a sample doesn't
depend on partitions. All samples together are of bounded size; the trees that cut them at random places between their values are
one bounded table of nodes, which goes to the tasks and scores every row there, many rows at a time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.scalars import clean

TREES, SAMPLE = 100, 256


def usual_depth(n: int) -> float:
    """The mean depth at which a row of ``n`` is found in a random search tree."""
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def samples(full: DataFrame, names: Sequence[str], keys: Sequence[str], trees: int, sample: int, seed: int) -> list[np.ndarray]:
    """For each tree the ``sample`` rows of the smallest hashes, in order of hash and values; all rows of a table of fewer."""
    n = full.count()
    draw = lambda t: F.xxhash64(F.lit(seed), t, *[F.col(k) for k in keys])
    # As many as a tree needs, and six standard deviations more; the smallest of them are kept.
    share = min(1.0, (sample + 6 * math.sqrt(sample)) / max(n, 1))
    most = min(int(share * 2**64) - 2**63, 2**63 - 1)
    own = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(draw(t).alias("h"), t.alias("t"))), lambda s: s["h"] <= F.lit(most))
    rows = full.select(F.explode(own).alias("s"), *names).select("s.t", "s.h", *names).toPandas()  # about trees * sample rows
    out = []
    for t in range(trees):
        part = rows[rows["t"] == t].sort_values(["h", *names], kind="stable")[: min(sample, n)]
        out.append(part[list(names)].to_numpy(float))
    return out


def grown(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, length) of the nodes of a tree as a heap from 0: rows with x[feature] > cut go to the second child. Feature -1: a leaf, where
    ``length`` is its depth and the usual depth of a tree of the rows that are still together there."""
    size = (2 << depth) - 1
    feature, cut, length = np.full(size, -1), np.zeros(size), np.zeros(size)
    left = [(0, 0, x)]
    while left:
        node, at, rows = left.pop()
        open_ = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
        if at == depth or not len(open_):
            length[node] = at + usual_depth(len(rows))
            continue
        f = int(rng.choice(open_))
        lo, hi = rows[:, f].min(), rows[:, f].max()
        c = lo + rng.random() * (hi - lo)
        c = c if c < hi else lo  # so that both sides have rows
        feature[node], cut[node] = f, c
        above = rows[:, f] > c
        left += [(2 * node + 2, at + 1, rows[above]), (2 * node + 1, at + 1, rows[~above])]
    return feature, cut, length


def isolation_scores(df: DataFrame, cols: Sequence[str], keys: Sequence[str] | None = None, trees: int = TREES, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """Adds ``isolation``, between 0 and 1, larger for rows that are sooner alone: 2 to the power of minus the mean path length over the usual one
    of a sample. Null where a column is missing. ``keys``, by which samples are drawn, are to tell rows apart; without any, all columns are hashed, so
    that equal rows are in a sample together. Equal rows score alike; a table of equal rows scores them all 0.5."""
    names = [f"x{i}" for i in range(len(cols))]
    full = df.select(*[F.col(k) for k in keys or df.columns], *[clean(F.col(c)).alias(n) for n, c in zip(names, cols)]).dropna(subset=names)
    picked = samples(full, names, list(keys or df.columns), trees, sample, seed)
    if not len(picked[0]):
        return df.withColumn("isolation", F.lit(None).cast("double"))
    depth = max(1, math.ceil(math.log2(max(len(picked[0]), 2))))
    grown_trees = [grown(x, depth, np.random.default_rng((seed, t))) for t, x in enumerate(picked)]
    table = tuple(np.stack(c) for c in zip(*grown_trees))
    shipped, usual = df.sparkSession.sparkContext.broadcast(table), max(usual_depth(len(picked[0])), 1e-9)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        values = np.stack([c.to_numpy(float) for c in columns], 1)
        whole = np.isfinite(values).all(1)
        total, rows = np.zeros(len(values)), np.arange(len(values))
        for feature, cut, length in zip(*shipped.value):
            node = np.zeros(len(values), np.int64)
            for _ in range(depth):
                inner = feature[node] >= 0
                node = np.where(inner, 2 * node + 1 + (values[rows, feature[node]] > cut[node]), node)
            total += length[node]
        return pd.Series(np.where(whole, np.exp2(-total / len(shipped.value[0]) / usual), np.nan))

    found = score(*[clean(F.col(c)) for c in cols])
    return df.withColumn("isolation", found).withColumn("isolation", F.when(~F.isnan("isolation"), F.col("isolation")))
