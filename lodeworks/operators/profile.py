"""Profiles of a table: counts, summaries, distributions, correlations, duplicates, quality.

Null and NaN both count as missing. Every function returns a small table of results; statistics of several columns come
from one aggregate.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from lodeworks.functions.quantiles import exact_quantiles
from lodeworks.functions.scalars import clean


def _missing(df: DataFrame, c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c) if dict(df.dtypes)[c] in ("double", "float") else F.col(c).isNull()


def unpivoted(one_row: DataFrame, names: Sequence[str], parts: Sequence[str], label: str = "column_name") -> DataFrame:
    """One row for each name from a single row with columns ``<part>__<name>``."""
    cells = [F.struct(F.lit(n).alias(label), *[F.col(f"`{p}__{n}`").alias(p) for p in parts]) for n in names]
    return one_row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def kinds(df: DataFrame) -> DataFrame:
    """How many columns are numeric, categorical, boolean or of another kind."""
    def kind(t) -> str:
        return "numeric" if isinstance(t, NumericType) else "categorical" if isinstance(t, StringType) else "boolean" if isinstance(t, BooleanType) else "other"

    found = [kind(f.dataType) for f in df.schema]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", *[F.lit(found.count(k)).cast("long").alias(f"n_{k}") for k in ("numeric", "categorical", "boolean", "other")])


def column_counts(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Type, rows, present, missing, share missing and distinct values of each column. ``approximate``: by HyperLogLog, for
    tables where exact distinct counts of many wide columns shuffle too much."""
    cols = list(cols or df.columns)
    kinds = dict(df.dtypes)
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    aggs = []
    for c in cols:
        aggs += [F.sum(_missing(df, c).cast("long")).alias(f"n_missing__{c}"), distinct(F.when(~_missing(df, c), F.col(c))).alias(f"n_unique__{c}")]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    one = one.select(*[x for c in cols for x in (F.lit(kinds[c]).alias(f"dtype__{c}"), F.col("n_rows").alias(f"n_rows__{c}"), F.coalesce(f"n_missing__{c}", F.lit(0)).alias(f"n_missing__{c}"), F.col(f"n_unique__{c}"))])
    out = unpivoted(one, cols, ("dtype", "n_rows", "n_missing", "n_unique"))
    return out.withColumns({"n_present": F.col("n_rows") - F.col("n_missing"), "missing_share": F.col("n_missing") / F.nullif(F.col("n_rows"), F.lit(0))})


def missing_map(df: DataFrame, key: str, cols: Sequence[str], buckets: int = 20) -> DataFrame:
    """Missing values of each column in each of ``buckets`` groups of rows, dealt by an integer key: the cells of a heat map."""
    per = df.withColumn("bucket", F.pmod(F.col(key), F.lit(buckets)).cast("long")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(_missing(df, c).cast("long")).alias(f"n_missing__{c}") for c in cols])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`n_missing__{c}`").alias("n_missing")) for c in cols])).alias("x")
    return per.select("bucket", "n_rows", cells).select("bucket", "n_rows", "x.*")


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample standard deviation, min, exact quartiles, max of each numeric column."""
    quartiles = exact_quantiles(df, {c: (0.25, 0.5, 0.75) for c in cols})
    aggs = []
    for c in cols:
        x = clean(F.col(c))
        aggs += [F.count(x).alias(f"n__{c}"), F.avg(x).alias(f"mean__{c}"), F.stddev_samp(x).alias(f"std__{c}"), F.min(x).alias(f"min__{c}"), F.max(x).alias(f"max__{c}")]
        aggs += [F.first(F.lit(q).cast("double")).alias(f"{n}__{c}") for n, q in zip(("q25", "q50", "q75"), quartiles[c])]
    return unpivoted(df.agg(*aggs), list(cols), ("n", "mean", "std", "min", "q25", "q50", "q75", "max"))


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Rows in each of ``bins`` equal ranges between the smallest and largest value; the last includes its upper end. Empty bins have a row."""
    x = clean(F.col(col))
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin long, lo double, hi double, n long")
    step = (hi - lo) / bins
    at = F.least(F.floor((x - lo) / step), F.lit(bins - 1)) if step else F.lit(0)
    counts = df.where(x.isNotNull()).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    ends = spark.range(bins).select(F.col("id").alias("bin"), (F.lit(lo) + F.col("id") * step).alias("lo"), (F.lit(lo) + (F.col("id") + 1) * step).alias("hi"))
    return ends.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def box(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """What a box plot draws: quartiles, whiskers (the outermost values within ``k`` ranges between quartiles) and outliers."""
    quartiles = exact_quantiles(df, {c: (0.25, 0.5, 0.75) for c in cols})
    aggs = []
    for c in cols:
        x, (a, m, b) = clean(F.col(c)), quartiles[c]
        lo, hi = (None, None) if a is None else (a - k * (b - a), b + k * (b - a))
        inside = (x >= F.lit(lo).cast("double")) & (x <= F.lit(hi).cast("double"))
        aggs += [F.first(F.lit(q).cast("double")).alias(f"{n}__{c}") for n, q in (("q25", a), ("q50", m), ("q75", b))]
        aggs += [F.min(F.when(inside, x)).alias(f"whisker_lo__{c}"), F.max(F.when(inside, x)).alias(f"whisker_hi__{c}"), F.count(F.when(~inside, 1)).alias(f"n_outliers__{c}")]
    return unpivoted(df.agg(*aggs), list(cols), ("q25", "q50", "q75", "whisker_lo", "whisker_hi", "n_outliers"))


def shares(df: DataFrame, col: str) -> DataFrame:
    """Rows and share of each category; a missing one has a row."""
    counts = df.groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    return counts.join(F.broadcast(total)).select("category", "n", (F.col("n") / F.col("_all")).alias("share"))


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, the first before the second in ``cols``; all in one pass."""
    pairs = list(itertools.combinations(cols, 2))
    one = df.agg(*[F.corr(clean(F.col(a)), clean(F.col(b))).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def drop_columns_missing(df: DataFrame, max_share: float) -> DataFrame:
    """Without the columns whose share of missing values exceeds ``max_share``."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(_missing(df, c).cast("long")).alias(f"m__{c}") for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if (row[f"m__{c}"] or 0) <= max_share * row["n"]])


def duplicates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows, distinct rows, and rows that repeat another one. Equal rows are summed up before the shuffle."""
    keys = list(cols or df.columns)
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def suggest_task(df: DataFrame, targets: Sequence[str], max_classes: int = 20) -> DataFrame:
    """For each possible target: 'classification' if it is no number or has at most ``max_classes`` values, else 'regression'."""
    numeric = [c for c in targets if isinstance(df.schema[c].dataType, NumericType)]
    counts = column_counts(df, targets).select("column_name", "n_unique")
    few = F.col("n_unique") <= max_classes
    return counts.withColumn("task", F.when(F.col("column_name").isin(numeric) & ~few, "regression").otherwise("classification"))


def quality_profile(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """For each numeric column: counts, missing, distinct, mean, deviation, quartiles, and values outside the quartile fences."""
    quartiles = exact_quantiles(df, {c: (0.25, 0.5, 0.75) for c in cols})
    aggs = []
    for c in cols:
        x, (a, m, b) = clean(F.col(c)), quartiles[c]
        lo, hi = (None, None) if a is None else (a - k * (b - a), b + k * (b - a))
        aggs += [F.count(F.lit(1)).alias(f"n_rows__{c}"), F.count(F.when(x.isNull(), 1)).alias(f"n_missing__{c}"), F.count_distinct(x).alias(f"n_unique__{c}"), F.avg(x).alias(f"mean__{c}"), F.stddev_samp(x).alias(f"std__{c}")]
        aggs += [F.first(F.lit(q).cast("double")).alias(f"{n}__{c}") for n, q in (("q25", a), ("q50", m), ("q75", b))]
        aggs += [F.count(F.when((x < F.lit(lo).cast("double")) | (x > F.lit(hi).cast("double")), 1)).alias(f"n_outliers__{c}")]
    return unpivoted(df.agg(*aggs), list(cols), ("n_rows", "n_missing", "n_unique", "mean", "std", "q25", "q50", "q75", "n_outliers"))


WEIGHTS = {"completeness": 0.2, "uniqueness": 0.2, "validity": 0.2, "consistency": 0.2, "relevance": 0.2}


def quality_score(df: DataFrame, numeric: Sequence[str], target: str, weights: dict[str, float] = WEIGHTS, high: float = 0.95, k: float = 1.5) -> DataFrame:
    """Five shares between 0 and 1 and their weighted sum (weights are this library's choice): completeness (present cells),
    uniqueness (distinct rows), validity (numeric cells within the quartile fences), consistency (pairs of columns that are
    not correlated above ``high``) and relevance (columns of any correlation with the target above 0.01)."""
    cells = column_counts(df).agg(F.sum("n_present").alias("present"), F.sum("n_rows").alias("cells"))
    rows = duplicates(df)
    valid = quality_profile(df, numeric, k).agg(F.sum("n_outliers").alias("outliers"), F.sum(F.col("n_rows") - F.col("n_missing")).alias("values"))
    pairs = correlations(df, [*numeric, target])
    related = pairs.agg(F.count(F.when((F.col("col_b") != target) & (F.abs("r") > high), 1)).alias("redundant"), F.count(F.when(F.col("col_b") != target, 1)).alias("pairs"), F.count(F.when((F.col("col_b") == target) & (F.abs("r") > 0.01), 1)).alias("relevant"), F.count(F.when(F.col("col_b") == target, 1)).alias("features"))
    one = cells.join(F.broadcast(rows)).join(F.broadcast(valid)).join(F.broadcast(related))  # one row each
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(1.0))
    scored = one.select(share("present", "cells").alias("completeness"), share("n_distinct", "n_rows").alias("uniqueness"), (1 - F.coalesce(F.col("outliers") / F.nullif(F.col("values"), F.lit(0)), F.lit(0.0))).alias("validity"), (1 - F.coalesce(F.col("redundant") / F.nullif(F.col("pairs"), F.lit(0)), F.lit(0.0))).alias("consistency"), share("relevant", "features").alias("relevance"))
    return scored.withColumn("score", sum((F.col(n) * w for n, w in weights.items()), F.lit(0.0)))


def recommendations(df: DataFrame, numeric: Sequence[str], max_missing: float = 0.5, many: int = 50) -> DataFrame:
    """A step for each numeric column by rules over its profile: drop it, impute it (median if it has outliers, else mean), treat
    its outliers, or nothing."""
    p = quality_profile(df, numeric)
    missing = F.col("n_missing") / F.nullif(F.col("n_rows"), F.lit(0))
    action = F.when(F.col("n_unique") <= 1, "drop: constant").when(missing > max_missing, "drop: mostly missing").when((F.col("n_missing") > 0) & (F.col("n_outliers") > 0), "impute median").when(F.col("n_missing") > 0, "impute mean").when(F.col("n_outliers") > 0, "cap outliers").otherwise("keep")
    return p.select("column_name", "n_missing", "n_unique", "n_outliers", action.alias("action"), F.lit(len(numeric) > many).alias("select_by_importance"))


def apply_recommendations(df: DataFrame, actions: DataFrame) -> DataFrame:
    """``df`` after the steps of a table (column_name, action), as ``recommendations`` gives it or a user has changed it: columns are dropped,
    filled and capped, in this order; 'keep' and unknown columns change nothing. The table has a row a column, so it is read whole."""
    from lodeworks.operators.prepare import cap, impute

    steps = {r["column_name"]: r["action"] for r in actions.select("column_name", "action").collect() if r["column_name"] in df.columns}
    unknown = {a for a in steps.values() if a not in ("keep", "impute median", "impute mean", "impute mode", "cap outliers") and not a.startswith("drop")}
    if unknown:
        raise ValueError(f"no such action: {sorted(unknown)}")
    of = lambda action: tuple(c for c, a in steps.items() if a == action)
    out = df.drop(*[c for c, a in steps.items() if a.startswith("drop")])
    for by in ("median", "mean", "mode"):
        if of(f"impute {by}"):
            out = impute(out, of(f"impute {by}"), by)
    return cap(out, of("cap outliers")) if of("cap outliers") else out
