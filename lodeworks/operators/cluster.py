"""Clustering and its evaluation: assignment, density clusters, silhouettes and centroid indices, advice on parameters.

Vectors are arrays of numbers. Models that Spark ML has (k-means, bisecting k-means, Gaussian mixtures, power iteration) are
taken from there; see ``models``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans, PowerIterationClustering
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.storage import materialised
from lodeworks.operators.graph import components
from lodeworks.operators.metric import BLOCK, CHUNK, Block, all_distances, distances, index, pivots_of, places, together, unpacked
from lodeworks.operators.neighbours import _linked, _near, copies, count_within, nearest, node_counts, numbered

MODELS = {"kmeans": KMeans, "bisecting": BisectingKMeans, "gaussian_mixture": GaussianMixture}


def fit(df: DataFrame, vector: str, algorithm: str, k: int, seed: int = 1):
    """A fitted Spark ML model on the column ``features``; transform tables with ``with_features`` first."""
    return MODELS[algorithm](k=k, seed=seed, featuresCol="features").fit(with_features(df, vector))


def with_features(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def squared_distance(vector: Column, centre: Sequence[float]) -> Column:
    x = F.zip_with(vector.cast("array<double>"), F.array(*[F.lit(float(c)) for c in centre]), lambda a, b: (a - b) * (a - b))
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def assign(df: DataFrame, vector: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    """Adds ``cluster``, the number of the nearest centre (ties: the lower), and the squared distance to it."""
    options = F.array(*[F.struct(squared_distance(F.col(vector), c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    return df.withColumn("_best", F.array_min(options)).withColumns({"cluster": F.col("_best.i"), "squared_distance": F.col("_best.d")}).drop("_best")


def power_iteration(df: DataFrame, key: str, vector: str, k: int, neighbours: int = 10, rounds: int = 20) -> DataFrame:
    """(key, cluster) by power iteration over the graph of nearest neighbours, a relative of spectral clustering; the weight of a link
    falls with the distance."""
    near = nearest(df, df, key, vector, neighbours)
    links = near.select(F.least(key, "neighbour").alias("src"), F.greatest(key, "neighbour").alias("dst"), (1 / (1 + F.col("distance"))).alias("weight")).distinct()
    found = PowerIterationClustering(k=k, maxIter=rounds, initMode="degree", weightCol="weight").assignClusters(links)
    return found.select(F.col("id").alias(key), "cluster")


def principal_components(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """(key, pc1 .. pck): coordinates along the first principal components, of either sign."""
    from pyspark.ml.functions import vector_to_array

    with_x = with_features(df, vector)
    out = PCA(k=k, inputCol="features", outputCol="_pc").fit(with_x).transform(with_x)
    return out.withColumn("_pc", vector_to_array("_pc")).select(key, *[F.col("_pc")[i].alias(f"pc{i + 1}") for i in range(k)])


def inertia(df: DataFrame, vector: str, ks: Sequence[int], seed: int = 1) -> DataFrame:
    """(k, inertia) of k-means for each k: the elbow table that advises on k."""
    rows = [(k, float(fit(df, vector, "kmeans", k, seed).summary.trainingCost)) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def inertia_of(df: DataFrame, vector: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    """(k, inertia): the sum of squared distances to the nearest of given centres."""
    return assign(df, vector, centres).agg(F.lit(len(centres)).alias("k"), F.coalesce(F.sum("squared_distance"), F.lit(0.0)).alias("inertia"))


def preview(df: DataFrame, vector: str, key: str, centres: Sequence[Sequence[float]], n: int) -> DataFrame:
    """The clusters of ``n`` rows that an md5 of their key picks, the same in every run: for a look while parameters are tuned."""
    picked = df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)
    return assign(picked, vector, centres).select(key, "cluster", "squared_distance")


def core_points(df: DataFrame, key: str, vector: str, eps: float, min_samples: int = 5, block: int = BLOCK) -> DataFrame:
    """(key, n_neighbours) of the points with at least ``min_samples`` points within ``eps``, themselves counted."""
    return count_within(df, key, vector, eps, block).where(F.col("n_neighbours") + 1 >= min_samples)


def dbscan(df: DataFrame, key: str, vector: str, eps: float, min_samples: int = 5, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """(key, cluster, is_core): the cluster of a core point is the smallest key of the core points it is connected to; a border
    point belongs to the smallest cluster of the core points near it; noise has null. Rows without a vector are noise.

    A first pass over near blocks counts; in a second one a cell of blocks returns a forest of its links between core points, and for each
    other point the trees near it, so that no table of near pairs is ever written."""
    (own,), dim = numbered([df], key, vector)
    members, nodes = copies(own.rows)
    ix = index(nodes, dim, pivots_of(nodes, dim, block), block)
    counted = nodes.select("k", "w").join(node_counts(ix, eps, report), "k", "left").select("k", (F.col("w") + F.coalesce("n", F.lit(0)) >= min_samples).alias("is_core"))
    core = materialised(counted.where("is_core").select("k"), "core")

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.isin(unpacked(batch.column(1)[i].as_py(), np.int64), batch.column(2)[i].values.to_numpy()).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["block", "extra"])

    def unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = unpacked(batch.column(1)[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), batch.column(0)[i].as_py())), pa.array(keys)], ["block", "k"])

    where = ix.blocks.select("block", "keys").mapInArrow(unfolded, "block long, k long")
    per_block = where.join(core, "k").groupBy("block").agg(F.collect_list("k").alias("ks"))  # of one block each
    flagged = materialised(ix.blocks.select("block", "keys").join(per_block, "block").select("block", "keys", "ks").mapInArrow(flags, "block long, extra binary"), "core-flags")

    def work(met: list[tuple[Block, list[tuple[Block, float]]]]) -> Iterator[pa.RecordBatch]:
        blocks = {b.number: b for a, others in met for b in (a, *(o for o, _ in others))}
        first = dict(zip(blocks, np.cumsum([0, *(len(b.keys) for b in blocks.values())])))
        keys = np.concatenate([b.keys for b in blocks.values()])
        is_core = np.concatenate([np.frombuffer(b.extra, bool) if b.extra else np.zeros(len(b.keys), bool) for b in blocks.values()])
        root, borders = np.arange(len(keys)), [np.zeros((2, 0), np.int64)]
        for a, others in met:
            for b, _ in others:
                if not (a.extra or b.extra):
                    continue
                near = []
                for lo, hit in _linked(a, b, eps):
                    p, q = places(hit)
                    i, j = first[a.number] + lo + p, first[b.number] + q
                    both = is_core[i] & is_core[j] & (root[i] != root[j])
                    grow_trees(root, i[both], j[both])
                    one = is_core[i] != is_core[j]
                    i, j = i[one], j[one]
                    near.append(np.where(is_core[i], (j, i), (i, j)))
                # The point, and a core point that it is near; one of each tree, as it is now.
                near = np.concatenate(near, 1)
                borders.append(np.unique(np.stack([near[0], root[near[1]]]), axis=1) if near.size else near)
        near = np.concatenate(borders, 1)
        near = np.unique(np.stack([near[0], root[near[1]]]), axis=1)
        at = np.flatnonzero(is_core & (root != np.arange(len(keys))))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys[at], keys[near[0]]])), pa.array(np.concatenate([keys[root[at]], keys[root[near[1]]]])), pa.array(np.arange(len(at) + near.shape[1]) < len(at))], ["k", "root", "core"])

    found = materialised(_near(ix, eps, work, "k long, root long, core boolean", flagged), "trees")
    joined = materialised(components(found.where("core"), "k", "root"), "clusters")
    of_core = core.join(joined, F.col("k") == F.col("node"), "left").select("k", F.coalesce("component", "k").alias("cluster"))
    border = found.where("not core").join(of_core.withColumnRenamed("k", "root"), "root").groupBy("k").agg(F.min("cluster").alias("_border"))
    clusters = of_core.withColumn("is_core", F.lit(True)).unionByName(border.select("k", F.col("_border").alias("cluster"), F.lit(False).alias("is_core")))
    rows = members.join(clusters.withColumnRenamed("k", "node"), "node").select(F.col("k").alias(key), "cluster", "is_core")
    rows = own.named(rows, (key, "cluster")).withColumnRenamed(key, "_key")
    out = df.select(key).join(rows.distinct(), F.col(key) == F.col("_key"), "left")
    return out.select(key, "cluster", F.coalesce("is_core", F.lit(False)).alias("is_core"))


def grow_trees(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of the places i and j, each named in ``root`` by its smallest place."""
    while len(i):
        x, y = root[i], root[j]
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while len(i) and (root[root] != root).any():
            root[:] = root[root]


def k_distances(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, k_distance): distance of the k-th nearest other point; its upper quantiles advise on eps, and it is the core distance of
    reachability plots."""
    return nearest(df, df, key, vector, k).where(F.col("rank") == k).select(key, F.col("distance").alias("k_distance"))


def silhouette(df: DataFrame, key: str, vector: str, label: str, block: int = BLOCK) -> DataFrame:
    """(key, label, silhouette) by Euclidean distance; 0 for the only member of a cluster. Every cell of blocks returns sums by
    point and cluster, never pairs of points; all pairs of blocks meet, one way round, as a silhouette needs all distances. Vectors are of one length."""
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(label).cast("long").alias("w"), F.col(vector).cast("array<double>").alias("x"))
    rows = materialised(rows, "points")
    dim = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(1))).first()[0]
    ix = index(rows, dim, np.zeros((1, dim)), block)
    # Of numbers of blocks, a thousandth of the rows.
    numbers = ix.blocks.select("block")
    pairs = numbers.select(F.col("block").alias("a")).join(F.broadcast(numbers.select(F.col("block").alias("b"))), F.col("a") <= F.col("b")).select("a", "b", F.lit(0.0).alias("bound"))

    def work(met: list[tuple[Block, list[tuple[Block, float]]]]) -> Iterator[pa.RecordBatch]:
        blocks = {b.number: b for a, others in met for b in (a, *(o for o, _ in others))}
        names = np.unique(np.concatenate([b.weights for b in blocks.values()]))
        member = {n: np.eye(len(names))[np.searchsorted(names, b.weights)] for n, b in blocks.items()}
        sums = {n: np.zeros((2, len(b.keys), len(names))) for n, b in blocks.items()}
        for a, others in met:
            for b, _ in others:
                shared = np.isin(a.keys, b.keys).any()
                for lo in range(0, len(a.keys), CHUNK):
                    at = np.arange(lo, min(len(a.keys), lo + CHUNK))
                    d, seen = all_distances(a, at, b), np.ones((len(at), len(b.keys)))
                    if shared:
                        apart = a.keys[at][:, None] != b.keys[None]
                        d, seen = d * apart, apart.astype(float)
                    for out, v in zip((0, 1), (d, seen)):
                        if out and not shared:
                            sums[a.number][1, at] += member[b.number].sum(0)
                            if a.number != b.number:
                                sums[b.number][1] += member[a.number][at].sum(0)
                            continue
                        sums[a.number][out, at] += v @ member[b.number]
                        if a.number != b.number:
                            sums[b.number][out] += v.T @ member[a.number][at]
        for n, b in blocks.items():
            some = np.repeat(b.keys, len(names)), np.repeat(b.weights, len(names)), np.tile(names, len(b.keys)), sums[n][0].ravel(), sums[n][1].ravel()
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in some], [key, "own", "other", "total", "n"])

    sums = together(pairs, ix, ix, work, f"`{key}` long, own long, other long, total double, n double").groupBy(key, "own", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = F.col("total") / F.nullif(F.col("n"), F.lit(0.0))
    per = sums.groupBy(key, "own").agg(F.max(F.when(F.col("own") == F.col("other"), mean)).alias("a"), F.min(F.when(F.col("own") != F.col("other"), mean)).alias("b"))
    return per.select(key, F.col("own").alias(label), F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)).alias("silhouette"))


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, position, centre, n): means by cluster and position, partly summed up before any row moves."""
    long = df.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("position", "x"))
    return long.groupBy(label, "position").agg(F.avg("x").alias("centre"), F.count(F.lit(1)).alias("n"))


def centroid_indices(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin indices, from centroids and spreads. As many centroids as clusters are held together."""
    c = centroids(df, vector, label).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "centre"))), lambda s: s["centre"]).alias("centre"), F.max("n").alias("n"))
    d2 = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.col("centre"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    spread = df.join(F.broadcast(c), label).groupBy(label).agg(F.sum(d2).alias("within"), F.avg(F.sqrt(d2)).alias("scatter"))
    rows = c.join(spread, label).orderBy(label).collect()  # a row for each cluster
    x, n = np.array([r["centre"] for r in rows]), np.array([r["n"] for r in rows], float)
    k, total = len(rows), float(n.sum())
    mean = (x * n[:, None]).sum(0) / total
    between, inside = float((n * ((x - mean) ** 2).sum(1)).sum()), sum(r["within"] for r in rows)
    gaps, scatter = distances(x, x), np.array([r["scatter"] for r in rows])
    np.fill_diagonal(gaps, np.inf)
    db = float(((scatter[:, None] + scatter[None]) / gaps).max(1).mean()) if k > 1 else 0.0
    ch = between / (k - 1) / (inside / (total - k)) if k > 1 and inside > 0 else 0.0
    return df.sparkSession.createDataFrame([(k, float(ch), db)], "n_clusters int, calinski_harabasz double, davies_bouldin double")


def interpret(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """(cluster, column_name, n, mean, overall, shift): the mean of each column in each cluster against that of all rows, also in
    standard deviations."""
    whole = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    per = df.groupBy(F.col(label).alias("cluster")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"own_{c}") for c in cols]).join(F.broadcast(whole))
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"own_{c}").alias("mean"), F.col(f"m_{c}").alias("overall"), ((F.col(f"own_{c}") - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0))).alias("shift")) for c in cols]
    return per.select("cluster", "n", F.explode(F.array(*cells)).alias("x")).select("cluster", "n", "x.*")
