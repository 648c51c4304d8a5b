"""Running aggregates over a whole table in order of one column, without a single-task window.

The table is cut at fixed values of the ordering column into ranges of about equal size; a window runs inside each range,
and what the ranges before add is joined from a table of one row a range.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.storage import materialised

#: Ranges at least, rows of one about, and ranges at most: of each, one row goes through a single task.
RANGES, ROWS, MOST = 64, 4_000_000, 4096


def ranges_for(n: int) -> int:
    """More ranges for larger tables, so that what one task orders doesn't grow with the table."""
    return min(max(RANGES, -(-n // ROWS)), MOST)


def _placed(df: DataFrame, key: str, cuts: list[float]) -> DataFrame:
    """Adds ``_range``: how many of the sorted ``cuts`` lie below the key; among many of them, first which group of cuts."""
    x = F.col(key).cast("double")
    below = lambda values: sum(((x > c).cast("int") for c in values), F.lit(0))
    if len(cuts) <= RANGES:
        return df.withColumn("_range", below(cuts))
    step = math.isqrt(len(cuts)) + 1
    groups = F.array(*[F.array(*[F.lit(float(c)) for c in cuts[i : i + step - 1]]) for i in range(0, len(cuts) + 1, step)])
    coarse = df.withColumn("_range", below(cuts[step - 1 :: step]))
    return coarse.withColumn("_range", F.col("_range") * step + F.coalesce(F.size(F.filter(F.get(groups, F.col("_range")), lambda c: c < x)), F.lit(0)))


def cut_points(df: DataFrame, key: str, ranges: int = RANGES) -> list[float]:
    """At most ``ranges`` - 1 values of ``key``; where they lie affects the load only, never results."""
    if ranges < 2:
        return []
    return sorted(set(df.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.25 / ranges)))


def running(df: DataFrame, key: str, values: Mapping[str, tuple[Callable[[Column], Column], str]], descending: bool = False, ranges: int | None = None) -> DataFrame:
    """Adds to each row, for every name -> (aggregate, column), the aggregate over all rows strictly before it in order of the
    numeric column ``key``, null for the first. Keys are to be unique and not null. Aggregates are such as combine with themselves: sum, min, max.
    """
    df = materialised(df, "ordered")  # read four times: counted, cut, added up, ordered
    cut = _placed(df, key, cut_points(df, key, ranges or ranges_for(df.count())))
    if descending:
        cut = cut.withColumn("_range", -F.col("_range"))
    each = cut.groupBy("_range").agg(*[f(F.col(c)).alias(f"_all_{n}") for n, (f, c) in values.items()])
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # of at most ``ranges`` rows
    before = each.select("_range", *[f(F.col(f"_all_{n}")).over(earlier).alias(f"_far_{n}") for n, (f, _) in values.items()])
    inside = Window.partitionBy("_range").orderBy(F.col(key).desc() if descending else F.col(key)).rowsBetween(Window.unboundedPreceding, -1)
    near = cut.select("*", *[f(F.col(c)).over(inside).alias(f"_near_{n}") for n, (f, c) in values.items()])
    joined = near.join(F.broadcast(before), "_range")
    both = {n: _combined(f, F.col(f"_far_{n}"), F.col(f"_near_{n}")) for n, (f, _) in values.items()}
    return joined.select(*df.columns, *[c.alias(n) for n, c in both.items()])


def _combined(f: Callable[[Column], Column], a: Column, b: Column) -> Column:
    if f is F.max:
        return F.greatest(a, b)
    if f is F.min:
        return F.least(a, b)
    return F.coalesce(a + b, a, b)
