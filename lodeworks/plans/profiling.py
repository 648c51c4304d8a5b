"""Queries over profiles of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.operators import profile as P
from lodeworks.plans.query import HOLED, LINE_KEY, holed, query, read, rounded

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def each(cols, sql: str) -> str:
    """The same SELECT for every column, united; {c} stands for the column."""
    return " UNION ALL ".join(sql.replace("{c}", c) for c in cols)


@query("q1_shape", "SELECT count(*) AS n_rows, 11::bigint AS n_columns FROM lineitem")
def shape(spark, sf):
    return P.shape(read(spark, sf, "lineitem"))


@query("q2_columns", each(("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), "SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_present, count(DISTINCT {c}) AS n_unique FROM orders"))
def columns(spark, sf):
    return P.column_counts(read(spark, sf, "orders"), ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")).select("column_name", "n_rows", "n_present", "n_unique")


@query("q3_preview", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def preview(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").orderBy("o_orderkey").limit(100)


@query("q4_missing", each(NUMBERS, f"SELECT '{{c}}' AS column_name, (count(*) - count({{c}})) AS n_missing, round((count(*) - count({{c}})) / count(*), 6) AS missing_share FROM {HOLED}"))
def missing(spark, sf):
    return rounded(P.column_counts(holed(read(spark, sf, "lineitem")), NUMBERS).select("column_name", "n_missing", "missing_share"))


@query("q4_missing_map", each(NUMBERS[:2], f"SELECT (l_orderkey % 20)::bigint AS bucket, count(*) AS n_rows, '{{c}}' AS column_name, (count(*) - count({{c}})) AS n_missing FROM {HOLED} GROUP BY 1"))
def missing_map(spark, sf):
    return P.missing_map(holed(read(spark, sf, "lineitem")), "l_orderkey", NUMBERS[:2])


@query("q5_describe", each(NUMBERS, "SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM " + HOLED))
def describe(spark, sf):
    return rounded(P.describe(holed(read(spark, sf, "lineitem")), NUMBERS), 4)


@query("q6_histogram", "WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT unnest(range(0, 20)) AS bin), c AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19)::bigint AS bin, count(*) AS n FROM orders, m GROUP BY 1) SELECT b.bin, round(lo + b.bin * ((hi - lo) / 20), 4) AS lo, round(lo + (b.bin + 1) * ((hi - lo) / 20), 4) AS hi, coalesce(n, 0)::bigint AS n FROM b LEFT JOIN c USING (bin), m")
def histogram(spark, sf):
    return rounded(P.histogram(read(spark, sf, "orders"), "o_totalprice", 20), 4)


@query("q7_box", each(("l_quantity", "l_extendedprice"), "SELECT '{c}' AS column_name, round(max(q25), 4) AS q25, round(max(q50), 4) AS q50, round(max(q75), 4) AS q75, round(min(CASE WHEN {c} BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) THEN {c} END), 4) AS whisker_lo, round(max(CASE WHEN {c} BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) THEN {c} END), 4) AS whisker_hi, count(CASE WHEN {c} NOT BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) THEN 1 END) AS n_outliers FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75 FROM lineitem)"))
def box(spark, sf):
    return rounded(P.box(read(spark, sf, "lineitem"), ("l_quantity", "l_extendedprice")), 4)


@query("q8_shares", "SELECT o_orderpriority AS category, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1")
def shares(spark, sf):
    return rounded(P.shares(read(spark, sf, "orders"), "o_orderpriority"))


@query("q9_correlations", " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]))
def correlations(spark, sf):
    return rounded(P.correlations(read(spark, sf, "lineitem"), NUMBERS))


@query("q10_drop_rows", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM {HOLED} WHERE l_quantity IS NOT NULL")
def drop_rows(spark, sf):
    return holed(read(spark, sf, "lineitem")).select(*LINE_KEY, "l_quantity").dropna(subset=["l_quantity"])


@query("q10_drop_columns", "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem")
def drop_columns(spark, sf):
    return P.drop_columns_missing(holed(read(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), 0.1)


@query("q12_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_discount FROM lineitem")
def distinct(spark, sf):
    return read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_discount").dropDuplicates()


@query("q13_duplicates", "SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_distinct, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_duplicates FROM lineitem")
def duplicates(spark, sf):
    return P.duplicates(read(spark, sf, "lineitem"), ("l_orderkey", "l_linenumber"))


@query("q15_task", each(("l_quantity", "l_extendedprice", "l_discount", "l_returnflag"), "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique, CASE WHEN typeof(any_value({c})) <> 'VARCHAR' AND count(DISTINCT {c}) > 20 THEN 'regression' ELSE 'classification' END AS task FROM lineitem"))
def task(spark, sf):
    return P.suggest_task(read(spark, sf, "lineitem"), ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag"))


# Spark's cast of a fraction truncates, that of the SQL would round.
@query("q16_cast_all", "SELECT event_id, try_cast(trunc(value) AS bigint) AS whole, try_cast(event_type AS double) AS no_number, cast(value AS varchar) IS NOT NULL AS has_text FROM events")
def cast_all(spark, sf):
    return read(spark, sf, "events").select("event_id", F.expr("try_cast(value as bigint)").alias("whole"), F.expr("try_cast(event_type as double)").alias("no_number"), F.col("value").cast("string").isNotNull().alias("has_text"))


@query("w1_statistics", "SELECT count(*) AS n_rows, 3::bigint AS n_numeric, 2::bigint AS n_categorical, 0::bigint AS n_boolean, 1::bigint AS n_other FROM orders")
def statistics(spark, sf):
    return P.kinds(read(spark, sf, "orders"))


PROFILE = each(NUMBERS, f"SELECT '{{c}}' AS column_name, count(*) AS n_rows, count(*) - count({{c}}) AS n_missing, count(DISTINCT {{c}}) AS n_unique, round(avg({{c}}), 4) AS mean, round(stddev_samp({{c}}), 4) AS std, round(max(a), 4) AS q25, round(max(m), 4) AS q50, round(max(b), 4) AS q75, count(CASE WHEN {{c}} < a - 1.5 * (b - a) OR {{c}} > b + 1.5 * (b - a) THEN 1 END) AS n_outliers FROM {HOLED}, (SELECT quantile_cont({{c}}, 0.25) AS a, quantile_cont({{c}}, 0.5) AS m, quantile_cont({{c}}, 0.75) AS b FROM {HOLED})")


@query("w2_quality_profile", PROFILE)
def quality_profile(spark, sf):
    return rounded(P.quality_profile(holed(read(spark, sf, "lineitem")), NUMBERS), 4)


@query("w5_recommendations", f"SELECT column_name, n_missing, n_unique, n_outliers, CASE WHEN n_unique <= 1 THEN 'drop: constant' WHEN n_missing > 0.5 * n_rows THEN 'drop: mostly missing' WHEN n_missing > 0 AND n_outliers > 0 THEN 'impute median' WHEN n_missing > 0 THEN 'impute mean' WHEN n_outliers > 0 THEN 'cap outliers' ELSE 'keep' END AS action, false AS select_by_importance FROM ({PROFILE})")
def recommendations(spark, sf):
    return P.recommendations(holed(read(spark, sf, "lineitem")), NUMBERS)


_SCORE = """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice FROM """ + HOLED + """),
 c AS (SELECT (5 * count(*) + count(l_quantity)) / (6 * count(*)) AS completeness, (SELECT count(*) FROM (SELECT DISTINCT * FROM x)) / count(*) AS uniqueness FROM x),
 v AS (SELECT """ + " + ".join(f"count(CASE WHEN {c} < q{c} - 1.5 * (r{c} - q{c}) OR {c} > r{c} + 1.5 * (r{c} - q{c}) THEN 1 END)" for c in ("l_quantity", "l_discount", "l_tax")) + """ AS outliers, count(l_quantity) + count(l_discount) + count(l_tax) AS n FROM x, (SELECT """ + ", ".join(f"quantile_cont({c}, 0.25) AS q{c}, quantile_cont({c}, 0.75) AS r{c}" for c in ("l_quantity", "l_discount", "l_tax")) + """ FROM x)),
 k AS (SELECT (abs(corr(l_quantity, l_discount)) > 0.95)::int + (abs(corr(l_quantity, l_tax)) > 0.95)::int + (abs(corr(l_discount, l_tax)) > 0.95)::int AS redundant,
   (abs(corr(l_quantity, l_extendedprice)) > 0.01)::int + (abs(corr(l_discount, l_extendedprice)) > 0.01)::int + (abs(corr(l_tax, l_extendedprice)) > 0.01)::int AS relevant FROM x),
 s AS (SELECT completeness, uniqueness, 1 - outliers / n AS validity, 1 - redundant / 3 AS consistency, relevant / 3 AS relevance FROM c, v, k)
 SELECT round(completeness, 6) AS completeness, round(uniqueness, 6) AS uniqueness, round(validity, 6) AS validity, round(consistency, 6) AS consistency, round(relevance, 6) AS relevance, round(0.2 * (completeness + uniqueness + validity + consistency + relevance), 6) AS score FROM s"""


@query("w3_quality_score", _SCORE)
def quality_score(spark, sf):
    x = holed(read(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return rounded(P.quality_score(x, ("l_quantity", "l_discount", "l_tax"), "l_extendedprice"))


@query("q14_roles", "SELECT * FROM (VALUES ('l_quantity', 'feature', 'double'), ('l_returnflag', 'feature', 'string'), ('l_extendedprice', 'target', 'double')) t(column_name, role, type)")
def column_roles(spark, sf):
    from lodeworks.operators.select import roles

    return roles(read(spark, sf, "lineitem"), ("l_quantity", "l_returnflag"), ("l_extendedprice",))[1]


ACTIONS = (("l_quantity", "impute median"), ("l_extendedprice", "cap outliers"), ("l_tax", "drop: constant"), ("l_discount", "keep"))


@query("w6_apply", f"WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount FROM {HOLED}), q AS (SELECT quantile_cont(l_quantity, 0.5) AS m, quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM x) SELECT * EXCLUDE (l_quantity, l_extendedprice, m, lo, hi), round(coalesce(l_quantity, m), 4) AS l_quantity, round(greatest(least(l_extendedprice, hi), lo), 4) AS l_extendedprice FROM x, q")
def apply_configuration(spark, sf):
    x = holed(read(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rounded(P.apply_recommendations(x, spark.createDataFrame(list(ACTIONS), "column_name string, action string")), 4)
