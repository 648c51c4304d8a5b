"""Clusters by way of grid cells: cluster features (BIRCH) and mean shift.

A cell holds the mergeable features of its points: their number, sum and smallest key. They are partly summed before any row moves, and don't depend on
the order of rows. What follows works on cells, whose number the width bounds, not on points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.storage import materialised
from lodeworks.operators.hierarchy import single_linkage
from lodeworks.operators.metric import BLOCK, brought_together, distances, index, near_blocks, pivots_of, unpacked
from lodeworks.operators.neighbours import Numbered, nearest, numbered


def _cells(df: DataFrame, key: str, vector: str, width: float) -> tuple[Numbered, DataFrame, DataFrame, int]:
    """The numbered rows; (k, cell) of all points; (cell, n, total): the features of each cell, named by its smallest key."""
    (own,), dim = numbered([df], key, vector)
    placed = own.rows.withColumn("at", F.transform("x", lambda v: F.floor(v / width)))
    sums = F.array(*[F.sum(F.col("x")[i]) for i in range(dim)])
    cells = materialised(placed.groupBy("at").agg(F.min("k").alias("cell"), F.count(F.lit(1)).alias("n"), sums.alias("total")), "cells")
    points = placed.join(cells.select("at", "cell"), "at").select("k", "cell")
    return own, points, cells.select("cell", "n", "total"), dim


def cell_features(df: DataFrame, key: str, vector: str, width: float) -> DataFrame:
    """(cell, n, centre) of the cells of a grid that hold points, named by the smallest key there. Rows without a vector are left out."""
    own, _, cells, _ = _cells(df, key, vector, width)
    return own.named(cells.select("cell", "n", F.transform("total", lambda v: v / F.col("n")).alias("centre")), ("cell",))


def birch(df: DataFrame, key: str, vector: str, width: float, k: int, block: int = BLOCK) -> DataFrame:
    """(key, cluster): points are gathered in cells ``width`` wide, and the centres of these clustered by nearest members down to ``k`` clusters; a cluster is
    named by its smallest key. Rows without a vector have null."""
    own, points, cells, _ = _cells(df, key, vector, width)
    centres = cells.select("cell", F.transform("total", lambda v: v / F.col("n")).alias("centre"))
    label = single_linkage(centres, "cell", "centre", k=k, block=block)
    found = own.named(points.join(label, "cell").select(F.col("k").alias("_key"), "cluster"), ("_key", "cluster"))
    return df.select(key).join(found.distinct(), F.col(key) == F.col("_key"), "left").select(key, "cluster")


def _parts(batch: pa.RecordBatch, i: int, s: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, w, x = (batch.column(f"{s}_{c}")[i].as_py() for c in ("keys", "weights", "x"))
    k = unpacked(k, np.int64)
    return k, unpacked(w, np.int64), unpacked(x).reshape(len(k), -1)


def mean_shift(df: DataFrame, key: str, vector: str, bandwidth: float, rounds: int = 50, tolerance: float = 1e-3, block: int = BLOCK) -> DataFrame:
    """(key, cluster, mode): seeds, one for each cell ``bandwidth`` wide, move to the mean of the points within ``bandwidth`` until none moves farther than
    ``tolerance`` times that, or for so many rounds; seeds that end within half a bandwidth of each other, link by link, are one cluster, and a point belongs to
    that of the nearest end. A cluster is named by the smallest key of its seeds' cells, and its mode is where that seed has come to. Rows without a vector have null.

    A round brings blocks of seeds and blocks of points together that are near enough, whatever the dimension, and returns a sum for each pair of a
    seed and a block."""
    own, points, cells, dim = _cells(df, key, vector, bandwidth)
    rows = own.rows.select("k", F.lit(1).cast("long").alias("w"), "x")
    pivots = pivots_of(rows, dim, block)
    right = index(rows, dim, pivots, block)
    seeds = materialised(cells.select(F.col("cell").alias("k"), F.lit(1).cast("long").alias("w"), F.transform("total", lambda v: v / F.col("n")).alias("x")), "seeds")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ka, _, xa), (_, _, xb) = _parts(batch, i, "a"), _parts(batch, i, "b")
                near = (distances(xa, xb) <= bandwidth).astype(float)
                n = near.sum(1).astype(np.int64)
                total = np.stack([(near * xb[:, d][None]).sum(1) for d in range(xb.shape[1])], 1)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ka[at]), pa.array(n[at]), pa.array(list(total[at]), pa.list_(pa.float64()))], ["k", "n", "total"])

    for _ in range(rounds):
        left = index(seeds, dim, pivots, block)
        met = brought_together(near_blocks(left, right, bandwidth), left, right).mapInArrow(sums, "k long, n long, total array<double>")
        moved = met.groupBy("k").agg(F.array(*[F.sum(F.col("total")[d]) / F.sum("n") for d in range(dim)]).alias("to"))
        gone = F.sqrt(F.aggregate(F.zip_with("x", "to", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
        # A seed that has no point near it any more stays.
        both = seeds.join(moved, "k", "left").select("k", "w", F.coalesce("to", "x").alias("to"), "x")
        both = materialised(both.select("k", "w", F.col("to").alias("x"), gone.alias("step")), "seeds")
        seeds = both.drop("step")
        if not both.where(F.col("step") > tolerance * bandwidth).limit(1).count():
            break
    label = materialised(single_linkage(seeds.select("k", "x"), "k", "x", height=bandwidth / 2, block=block), "modes")
    end = seeds.select(F.col("k").alias("cluster"), F.col("x").alias("mode"))
    ends = seeds.select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("_id"), "x")  # names apart from those of points
    asked = own.rows.select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("_id"), "x")
    found = nearest(asked, ends, "_id", "x", 1, block).select(F.substring("_id", 2, 20).cast("long").alias("_key"), F.substring("neighbour", 2, 20).cast("long").alias("k"))
    named = own.named(found.join(label, "k").join(end, "cluster").select("_key", "cluster", "mode"), ("_key", "cluster"))
    return df.select(key).join(named.dropDuplicates(["_key"]), F.col(key) == F.col("_key"), "left").select(key, "cluster", "mode")
