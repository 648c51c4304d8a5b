"""Exact nearest neighbours and near pairs of all rows, over blocks of a metric index.

Equal vectors are one node, so that copies cost rows in proportion. Blocks meet in rounds: first each block with the few that may be
nearest to it, then, bounded by the distance of the k-th neighbour found so far, with more of them, and last with all that the bound leaves.
A task returns only pairs that its rows' bounds let through. On tables without any structure nothing can be left out, and the
work grows with the square of the table, as exactness then needs; for approximate neighbours over very large tables, Spark ML's
BucketedRandomProjectionLSH takes the place of ``nearest``.

Vectors of different length count as if zeros followed the shorter one. Rows without a key, without a vector, or with a missing component are
left out. Keys are of any type that can be ordered; ties go by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodeworks.functions.storage import materialised
from lodeworks.operators.metric import BLOCK, CHUNK, Block, Index, Product, index, near_blocks, padded, pivots_of, places, together, unpacked, whole

#: Blocks that a block meets in the first rounds; the last round has no limit.
ROUNDS = (4, 32)
#: Stands where a list of neighbours has none yet.
NOBODY = np.iinfo(np.int64).max


def rounds(n_blocks: int) -> list[int | None]:
    """How many blocks a block meets at most in each round."""
    return [*(n for n in ROUNDS if n < n_blocks), None]


@dataclass
class Numbered:
    """Rows as (k long, x), and the keys that the numbers stand for; None where keys are whole numbers themselves."""

    rows: DataFrame
    names: DataFrame | None

    def named(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        if self.names is None:
            return df
        order = df.columns
        for c in columns:
            df = df.join(self.names.select(F.col("k").alias(c), F.col("key").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
        return df.select(order)


def numbered(tables: Sequence[DataFrame], key: str, vector: str) -> tuple[list[Numbered], int]:
    """Tables with keys as numbers in the order of keys, and the length of the longest vector."""
    kept = [t.where(F.col(key).isNotNull() & whole(F.col(vector))) for t in tables]
    names = None
    if not isinstance(tables[0].schema[key].dataType, IntegralType):
        keys = kept[0].select(F.col(key).alias("key"))
        for t in kept[1:]:
            keys = keys.union(t.select(key))
        # Sorted by key, so that numbers, which rise with partitions, are in order of keys.
        names = materialised(keys.distinct().orderBy("key").withColumn("k", F.monotonically_increasing_id()), "keys")
        kept = [t.join(names.withColumnRenamed("key", key), key) for t in kept]
    k = F.col("k") if names is not None else F.col(key).cast("long")
    plain = [materialised(t.select(k.alias("k"), F.col(vector).cast("array<double>").alias("x")), "vectors") for t in kept]
    dim = max(t.agg(F.coalesce(F.max(F.size("x")), F.lit(1))).first()[0] for t in plain)
    return [Numbered(t.select("k", padded(F.col("x"), dim).alias("x")), names) for t in plain], dim


def copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, node) of all rows, and their nodes (k, w, x): the smallest key of each distinct vector and how many rows have it."""
    signed = rows.withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(1), "x")})
    nodes = materialised(signed.groupBy("h1", "h2").agg(F.min("k").alias("node"), F.count(F.lit(1)).alias("w"), F.first("x").alias("x")), "nodes")
    members = signed.select("k", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("k", "node")
    return members, nodes.select(F.col("node").alias("k"), "w", "x")


def _compared(pairs: DataFrame, left: Index, right: Index, k: int, beside: DataFrame | None) -> DataFrame:
    """(a, q, neighbour, distance): for each query the k nearest of each cell, as far as its bound in ``beside`` reaches."""

    def work(met: list[tuple[Block, list[tuple[Block, float]]]]) -> Iterator[pa.RecordBatch]:
        for a, others in met:
            n = len(a.keys)
            reach = unpacked(a.extra).copy() if a.extra else np.full(n, np.inf)
            dist, near = np.full((n, k), np.inf), np.full((n, k), NOBODY)
            for b, bound in others:
                open_ = np.flatnonzero(reach >= bound)
                for lo in range(0, len(open_), CHUNK):
                    at = open_[lo : lo + CHUNK]
                    product = Product(a, at, b)
                    hit = product.possible(reach[at])
                    endless = np.flatnonzero(np.isinf(reach[at]))
                    if len(endless):
                        hit[endless] = Product(a, at[endless], b).first(k)
                    p, q = places(hit)
                    d = product.exact(p, q)
                    good = d <= reach[at][p]
                    _taken(dist, near, reach, at[p[good]], d[good], b.keys[q[good]])
            p, r = np.nonzero(near != NOBODY)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), a.number)), pa.array(a.keys[p]), pa.array(near[p, r]), pa.array(dist[p, r])], ["a", "q", "neighbour", "distance"])

    return together(pairs, left, right, work, "a long, q long, neighbour long, distance double", beside)


def _taken(dist: np.ndarray, near: np.ndarray, reach: np.ndarray, p: np.ndarray, d: np.ndarray, keys: np.ndarray) -> None:
    """Puts what was found for rows p into their lists of the nearest, in order of (distance, key), and lowers their reach to the end of a full list."""
    rows, at = np.unique(p, return_inverse=True)
    k = dist.shape[1]
    place, far, name = np.concatenate([np.repeat(np.arange(len(rows)), k), at]), np.concatenate([dist[rows].ravel(), d]), np.concatenate([near[rows].ravel(), keys])
    order = np.lexsort((name, far, place))
    place = place[order]
    rank = np.arange(len(place)) - np.searchsorted(place, np.arange(len(rows)))[place]
    keep = rank < k
    dist[rows[place[keep]], rank[keep]] = far[order][keep]
    near[rows[place[keep]], rank[keep]] = name[order][keep]
    reach[rows] = np.minimum(reach[rows], dist[rows, k - 1])


def _reached(left: Index, best: DataFrame, k: int) -> DataFrame:
    """(block, extra, limit): the distance of the k-th neighbour so far of each row, in order of keys, and the largest of a block."""
    kth = best.groupBy("a", "q").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("kth"))
    rows = kth.groupBy(F.col("a").alias("block")).agg(F.collect_list(F.struct("q", "kth")).alias("rows"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra, limit = [], []
            for i in range(batch.num_rows):
                k, own = unpacked(batch.column(1)[i].as_py(), np.int64), batch.column(2)[i].values
                reach = np.full(len(k), np.inf)
                if own is not None and len(own):
                    reach[np.searchsorted(k, own.field("q").to_numpy())] = own.field("kth").to_numpy()
                extra.append(reach.tobytes())
                limit.append(reach.max())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(extra, pa.binary()), pa.array(limit, pa.float64())], ["block", "extra", "limit"])

    return left.blocks.select("block", "keys").join(rows, "block", "left").mapInArrow(work, "block long, extra binary, limit double")


def k_nearest(left: Index, right: Index, k: int, report: dict | None = None) -> DataFrame:
    """(q, neighbour, distance, rank): for each row of ``left`` its k nearest of ``right``, itself included where it is one of them."""
    order = Window.partitionBy("q").orderBy("distance", "neighbour")
    best, reached, last, compared = None, None, None, 0
    for first in rounds(right.n_blocks):
        limits: DataFrame | float = float("inf")
        if reached is not None:
            limits = reached.select("block", "limit").join(last, "block", "left").na.fill({"after_bound": -1.0, "after_b": -1})
        pairs = near_blocks(left, right, limits, first)
        n = pairs.count()
        if not n:
            break
        compared += n
        found = _compared(pairs, left, right, k, None if reached is None else reached.select("block", "extra"))
        found = found if best is None else found.union(best)
        best = materialised(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "nearest")
        if first is None:
            break
        reached = materialised(_reached(left, best, k), "reached")
        done = pairs.groupBy(F.col("a").alias("block")).agg(F.max(F.struct("bound", "b")).alias("m")).select("block", F.col("m.bound").alias("after_bound"), F.col("m.b").alias("after_b"))
        last = done if last is None else done.union(last).groupBy("block").agg(F.max(F.struct("after_bound", "after_b")).alias("m")).select("block", "m.*")
        last = materialised(last, "last-pairs")
    if report is not None:
        report |= {"block_pairs": left.n_blocks * right.n_blocks, "compared": compared}
    if best is None:
        return left.blocks.sparkSession.createDataFrame([], "q long, neighbour long, distance double, rank int")
    return best.select("q", "neighbour", "distance", F.row_number().over(order).alias("rank"))


def nearest(queries: DataFrame, points: DataFrame, key: str, vector: str, k: int, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """(key, neighbour, distance, rank): for each query the ``k`` nearest points of another key, from rank 1, ties by key. ``report`` is
    told how many pairs of blocks there are, and how many were compared."""
    same = queries is points
    tables, dim = numbered([queries] if same else [queries, points], key, vector)
    asked, known = tables[0], tables[-1]
    # Of equal points only the k + 1 smallest keys can be among anyone's k nearest.
    few = Window.partitionBy(F.xxhash64("x"), F.xxhash64(F.lit(1), "x")).orderBy("k")
    points_k = materialised(known.rows.withColumn("_n", F.row_number().over(few)).where(F.col("_n") <= k + 1).select("k", F.lit(1).cast("long").alias("w"), "x"), "points")
    members, nodes = copies(asked.rows)
    pivots = pivots_of(points_k, dim, block)
    right = index(points_k, dim, pivots, block)
    found = materialised(k_nearest(index(nodes, dim, pivots, block), right, k + 1, report), "nearest").select(F.col("q").alias("node"), "neighbour", "distance")
    own = members.join(found, "node").where(F.col("k") != F.col("neighbour")).select(F.col("k").alias(key), "neighbour", "distance")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("distance", "neighbour"))).where(F.col("rank") <= k)
    return asked.named(ranked, (key, "neighbour"))


def _near(ix: Index, eps: float, work: Callable, schema: str, beside: DataFrame | None = None, report: dict | None = None) -> DataFrame:
    """``work`` for every pair of blocks of an index that may hold rows within ``eps``, each pair once; see ``together``."""
    pairs = near_blocks(ix, ix, eps, once=True)
    if report is not None:
        report |= {"block_pairs": ix.n_blocks * (ix.n_blocks + 1) // 2, "compared": pairs.count()}
    return together(pairs, ix, ix, work, schema, beside, both=True)


def _linked(a: Block, b: Block, eps: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, which pairs are within ``eps``) of some rows of ``a`` and all of ``b`` at a time; no row is near itself."""
    for lo in range(0, len(a.keys), CHUNK):
        at = np.arange(lo, min(len(a.keys), lo + CHUNK))
        product, reach = Product(a, at, b), np.full(len(at), eps)
        hit, maybe = product.sure(reach), product.possible(reach)
        if np.count_nonzero(hit) != np.count_nonzero(maybe):
            p, q = places(maybe & ~hit)
            hit[p, q] = product.exact(p, q) <= eps
        if a.number == b.number:
            hit[np.arange(len(at)), at] = False
        yield lo, hit


def within(df: DataFrame, key: str, vector: str, eps: float, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """(key, neighbour): pairs of different keys no farther apart than ``eps``, both ways. As many rows as there are such
    pairs; for counts alone see ``count_within``."""
    (own,), dim = numbered([df], key, vector)
    rows = own.rows.select("k", F.lit(1).cast("long").alias("w"), "x")

    def work(met: list[tuple[Block, list[tuple[Block, float]]]]) -> Iterator[pa.RecordBatch]:
        for a, others in met:
            for b, _ in others:
                for lo, hit in _linked(a, b, eps):
                    p, q = places(hit)
                    one, other = a.keys[lo + p], b.keys[q]
                    apart = one != other
                    one, other = one[apart], other[apart]
                    if a.number != b.number:
                        one, other = np.concatenate([one, other]), np.concatenate([other, one])
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(other)], [key, "neighbour"])

    found = _near(index(rows, dim, pivots_of(rows, dim, block), block), eps, work, f"`{key}` long, neighbour long", report=report)
    return own.named(found, (key, "neighbour"))


def node_counts(ix: Index, eps: float, report: dict | None = None) -> DataFrame:
    """(k, n): how many rows, copies counted, are no farther than ``eps`` from each node, itself left out with its copies."""

    def work(met: list[tuple[Block, list[tuple[Block, float]]]]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, tuple[Block, np.ndarray]] = {}
        of = lambda b: counts.setdefault(b.number, (b, np.zeros(len(b.keys), np.int64)))[1]
        for a, others in met:
            for b, _ in others:
                n, m = of(a), of(b)
                for lo, hit in _linked(a, b, eps):
                    own, some = a.weights[lo : lo + len(hit)], hit.astype(float)
                    n[lo : lo + len(hit)] += (some @ b.weights.astype(float)).astype(np.int64)
                    if a.number != b.number:
                        m += (own.astype(float) @ some).astype(np.int64)
        for b, n in counts.values():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(b.keys[at]), pa.array(n[at])], ["k", "n"])

    return _near(ix, eps, work, "k long, n long", report=report).groupBy("k").agg(F.sum("n").alias("n"))


def count_within(df: DataFrame, key: str, vector: str, eps: float, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """(key, n_neighbours): how many other rows are no farther than ``eps``, where there is one. A cell returns a row a node."""
    (own,), dim = numbered([df], key, vector)
    members, nodes = copies(own.rows)
    counts = node_counts(index(nodes, dim, pivots_of(nodes, dim, block), block), eps, report)
    total = nodes.select(F.col("k").alias("node"), "w").join(counts.withColumnRenamed("k", "node"), "node", "left").select("node", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_neighbours"))
    found = members.join(total, "node").where("n_neighbours > 0").select(F.col("k").alias(key), "n_neighbours")
    return own.named(found, (key,))


def local_outlier_factors(df: DataFrame, key: str, vector: str, k: int = 20, block: int = BLOCK) -> DataFrame:
    """(key, k_distance, lof) with exactly ``k`` neighbours, ties by key. A point among copies of itself (reach distance 0) has a
    density of 1e10, as is usual. A table of ``k`` rows or fewer uses all neighbours there are."""
    near = materialised(nearest(df, df, key, vector, k, block), "neighbours")
    reach = near.groupBy(key).agg(F.max("distance").alias("k_distance"))
    other = reach.select(F.col(key).alias("neighbour"), F.col("k_distance").alias("_reach"))
    density = near.join(other, "neighbour").groupBy(key).agg((1.0 / (F.avg(F.greatest("distance", "_reach")) + 1e-10)).alias("density"))
    ratio = near.join(density.select(F.col(key).alias("neighbour"), F.col("density").alias("_other")), "neighbour").groupBy(key).agg(F.avg("_other").alias("_mean"))
    return reach.join(density, key).join(ratio, key).select(key, "k_distance", (F.col("_mean") / F.col("density")).alias("lof"))


def impute_nearest(df: DataFrame, key: str, target: str, vector: str, k: int = 5, block: int = BLOCK) -> DataFrame:
    """``df`` with missing ``target`` values replaced by the mean of the ``k`` nearest rows that have one; ``vector`` holds the
    observed features. Without such rows, or without a vector, the value stays missing."""
    x = F.when(~F.isnan(F.col(target).cast("double")), F.col(target).cast("double"))
    near = nearest(df.where(x.isNull()), df.where(x.isNotNull()), key, vector, k, block)
    values = df.where(x.isNotNull()).select(F.col(key).alias("neighbour"), x.alias("_value"))
    means = near.join(values, "neighbour").groupBy(key).agg(F.avg("_value").alias("_mean"))
    return df.join(means, key, "left").withColumn(target, F.coalesce(x, "_mean")).drop("_mean").select(*df.columns)
