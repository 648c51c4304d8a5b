"""Connected components by alternating large and small stars, in joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.joins import spread_join
from lodeworks.functions.storage import discard, stored


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for every node of a link the smallest node that it reaches.

    Each round hangs the neighbours of a node that are larger than it below the smallest of its neighbourhood, then the
    smaller ones likewise, until every link leads straight to the smallest node of its component: a number of rounds that
    grows with the logarithm of the longest path. A node in which very many links meet is aggregated partly before the
    shuffle, and its links are joined to its minimum in several tasks. Only sums about the links reach the driver, and the
    tables of earlier rounds are deleted. Null nodes and self-links are ignored.
    """
    spark = links.sparkSession
    start = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    path, before = stored(start, "links"), None
    while True:
        edges = spark.read.schema(start.schema).parquet(path)
        sides = edges.union(edges.select("v", "u"))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(sides, low, ["u"], ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = spread_join(large, small, ["u"], ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        done, path = path, stored(moved.union(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        edges = spark.read.schema(start.schema).parquet(path)
        discard(spark, done)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
