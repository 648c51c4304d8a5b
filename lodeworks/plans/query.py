"""Registering queries beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A key of lineitem, with what tells its rare repeats apart.
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as the last digits of sums depend on their order; -0 is 0."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def holed(lines: DataFrame) -> DataFrame:
    """lineitem with quantities missing on every third line number, as no test table holds a null."""
    return lines.withColumn("l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))


HOLED = "(SELECT * REPLACE (CASE WHEN l_linenumber <> 3 THEN l_quantity END AS l_quantity) FROM lineitem)"


def number(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")
