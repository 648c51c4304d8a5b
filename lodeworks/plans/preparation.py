"""Queries over outlier treatment, imputation, scaling, encoding and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.functions.scalars import inverse_normal_cdf_sql
from lodeworks.operators import neighbours as N
from lodeworks.operators import prepare as P
from lodeworks.plans.query import HOLED, LINE_KEY, holed, query, read, rounded

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
PRICE = "o_totalprice"
QUARTILES = f"(SELECT quantile_cont({PRICE}, 0.25) AS a, quantile_cont({PRICE}, 0.75) AS b FROM orders)"
#: Tukey's fences, narrowed to 0.5 so that the uniform test columns have outliers.
IQR = f"{PRICE} < a - 0.5 * (b - a) OR {PRICE} > b + 0.5 * (b - a)"


def orders(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", PRICE)


@query("o1_iqr_outliers", f"SELECT '{PRICE}' AS column_name, round(max(a - 0.2 * (b - a)), 4) AS lo, round(max(b + 0.2 * (b - a)), 4) AS hi, count(CASE WHEN {IQR.replace('0.5', '0.2')} THEN 1 END) AS n_outliers FROM orders, {QUARTILES}")
def iqr(spark, sf):
    o = orders(spark, sf)
    return rounded(P.count_outliers(o, P.iqr_fences(o, (PRICE,), 0.2)), 4)


@query("o2_zscore_outliers", f"WITH s AS (SELECT avg({PRICE}) AS m, stddev_pop({PRICE}) AS d FROM orders) SELECT '{PRICE}' AS column_name, round(max(m - 1.5 * d), 4) AS lo, round(max(m + 1.5 * d), 4) AS hi, count(CASE WHEN {PRICE} < m - 1.5 * d OR {PRICE} > m + 1.5 * d THEN 1 END) AS n_outliers FROM orders, s")
def zscore(spark, sf):
    o = orders(spark, sf)
    return rounded(P.count_outliers(o, P.zscore_fences(o, (PRICE,), 1.5)), 4)


@query("o6_drop_outliers", f"SELECT o_orderkey, {PRICE} FROM orders, {QUARTILES} WHERE NOT ({IQR.replace('0.5', '0.2')})")
def drop(spark, sf):
    o = orders(spark, sf)
    return P.drop_outliers(o, P.iqr_fences(o, (PRICE,), 0.2))


@query("o7_blank_outliers", f"SELECT o_orderkey, CASE WHEN NOT ({IQR.replace('0.5', '0.2')}) THEN {PRICE} END AS {PRICE} FROM orders, {QUARTILES}")
def blank(spark, sf):
    o = orders(spark, sf)
    return P.blank_outliers(o, P.iqr_fences(o, (PRICE,), 0.2))


@query("o8_replace_outliers", f"WITH f AS (SELECT o_orderkey, {PRICE}, ({IQR.replace('0.5', '0.2')}) AS gone FROM orders, {QUARTILES}), m AS (SELECT median({PRICE}) AS m FROM f WHERE NOT gone) SELECT o_orderkey, round(CASE WHEN gone THEN m ELSE {PRICE} END, 4) AS {PRICE} FROM f, m")
def replace(spark, sf):
    o = orders(spark, sf)
    return rounded(P.replace_outliers(o, P.iqr_fences(o, (PRICE,), 0.2)), 4)


@query("o9_cap", f"WITH q AS (SELECT quantile_cont({PRICE}, 0.01) AS lo, quantile_cont({PRICE}, 0.99) AS hi FROM orders) SELECT o_orderkey, round(greatest(least({PRICE}, hi), lo), 4) AS {PRICE} FROM orders, q")
def cap(spark, sf):
    return rounded(P.cap(orders(spark, sf), (PRICE,)), 4)


def lines(spark, sf):
    return holed(read(spark, sf, "lineitem")).select(*LINE_KEY, "l_quantity")


for _by, _sql in (("mean", "avg(l_quantity)"), ("median", "median(l_quantity)"), ("mode", "(SELECT min(v) FROM (SELECT l_quantity AS v, count(*) AS n, max(count(*)) OVER () AS m FROM x WHERE l_quantity IS NOT NULL GROUP BY 1) WHERE n = m)")):
    _from = "x" if _by != "mode" else "(SELECT 1)"

    @query(f"i{('mean', 'median', 'mode').index(_by) + 1}_impute_{_by}", f"WITH x AS (SELECT {KEY}, l_quantity FROM {HOLED}), c AS (SELECT {_sql} AS c FROM {_from}) SELECT {KEY}, round(coalesce(l_quantity, c), 6) AS l_quantity FROM x, c")
    def impute(spark, sf, by=_by):
        return rounded(P.impute(lines(spark, sf), ("l_quantity",), by))


@query(
    "i4_impute_nearest",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::double) AS x, CASE WHEN vec_id % 10 <> 0 THEN label::double END AS y FROM embeddings),
    d AS (SELECT a.vec_id, b.y, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) ** 2))), b.vec_id) AS k FROM e a JOIN e b ON a.y IS NULL AND b.y IS NOT NULL)
    SELECT vec_id, round(coalesce(e.y, m.y), 6) AS y FROM e LEFT JOIN (SELECT vec_id, avg(y) AS y FROM d WHERE k <= 5 GROUP BY 1) m USING (vec_id)""",
)
def impute_nearest(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 10 != 0, F.col("label").cast("double")).alias("y"))
    return rounded(N.impute_nearest(e, "vec_id", "y", "embedding").select("vec_id", "y"))


# Only one column has holes, so every round fits the same plane, to the rows where it is observed.
@query(
    "i5_impute_iterative",
    f"""WITH x AS (SELECT {', '.join(LINE_KEY)}, l_quantity AS y, l_extendedprice AS a, l_tax AS b FROM {HOLED}), m AS (SELECT covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x WHERE y IS NOT NULL),
    w AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM m)
    SELECT {', '.join(LINE_KEY)}, round(coalesce(y, my + wa * (a - ma) + wb * (b - mb)), 6) AS l_quantity, round(a, 6) AS l_extendedprice, round(b, 6) AS l_tax FROM x, w""",
)
def impute_iterative(spark, sf):
    x = holed(read(spark, sf, "lineitem")).select(*LINE_KEY, "l_quantity", "l_extendedprice", "l_tax")
    return rounded(P.impute_iterative(x, ("l_quantity", "l_extendedprice", "l_tax")))


@query(
    "o4_local_outlier_factor",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::double) AS x FROM embeddings),
    d AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) ** 2))) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM d) WHERE k <= 20),
    r AS (SELECT a, max(d) AS kd FROM n GROUP BY a), l AS (SELECT n.a, 1 / (avg(greatest(n.d, r.kd)) + 1e-10) AS lrd FROM n JOIN r ON r.a = n.b GROUP BY n.a)
    SELECT n.a AS vec_id, round(max(r.kd), 6) AS k_distance, round(avg(o.lrd) / max(l.lrd), 6) AS lof FROM n JOIN l o ON o.a = n.b JOIN l ON l.a = n.a JOIN r ON r.a = n.a GROUP BY n.a""",
)
def lof(spark, sf):
    return rounded(N.local_outlier_factors(read(spark, sf, "embeddings"), "vec_id", "embedding"))


def scaled(scaler: P.Scaler, o):
    return rounded(scaler.transform(o))


@query("t1_standard", f"SELECT o_orderkey, round(({PRICE} - m) / s, 6) AS {PRICE} FROM orders, (SELECT avg({PRICE}) AS m, stddev_pop({PRICE}) AS s FROM orders)")
def standard(spark, sf):
    o = orders(spark, sf)
    return scaled(P.fit_standard(o, (PRICE,)), o)


@query("t2_minmax", f"SELECT o_orderkey, round(({PRICE} - a) / (b - a), 6) AS {PRICE} FROM orders, (SELECT min({PRICE}) AS a, max({PRICE}) AS b FROM orders)")
def minmax(spark, sf):
    o = orders(spark, sf)
    return scaled(P.fit_minmax(o, (PRICE,)), o)


@query("t3_robust", f"SELECT o_orderkey, round(({PRICE} - m) / (b - a), 6) AS {PRICE} FROM orders, (SELECT median({PRICE}) AS m FROM orders), {QUARTILES}")
def robust(spark, sf):
    o = orders(spark, sf)
    return scaled(P.fit_robust(o, (PRICE,)), o)


@query("t4_yeo_johnson", f"SELECT o_orderkey, round((pow({PRICE} + 1, 0.5) - 1) / 0.5, 6) AS {PRICE} FROM orders")
def yeo_johnson(spark, sf):
    return rounded(P.power_transform(orders(spark, sf), {PRICE: 0.5}))


@query("t4_yeo_johnson_power")
def yeo_johnson_power(spark, sf):
    o = orders(spark, sf)
    return spark.createDataFrame([(PRICE, P.yeo_johnson_power(o, PRICE))], "column_name string, power double")


@query("t5_quantile", "WITH x AS (SELECT o_orderkey, o_custkey, (rank() OVER (ORDER BY o_custkey) - 1) / (count(*) OVER () - 1) AS q FROM orders) SELECT o_orderkey, o_custkey, round(q, 6) AS quantile FROM x")
def quantile(spark, sf):
    return rounded(P.quantile_transform(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey"))


_SHARE = "least(greatest((rank() OVER (ORDER BY o_custkey) - 1) / (count(*) OVER () - 1), 1e-7), 1 - 1e-7)"


@query("t5_quantile_normal", f"WITH x AS (SELECT o_orderkey, o_custkey, {_SHARE}::double AS p FROM orders) SELECT o_orderkey, o_custkey, round({inverse_normal_cdf_sql('p')}, 6) + 0.0 AS quantile FROM x")
def quantile_normal(spark, sf):
    return rounded(P.quantile_transform(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", normal=True))


_FLAGS = ("A", "N", "R")


@query("e1_one_hot", f"SELECT {KEY}, " + ", ".join(f"(l_returnflag = '{v}')::int AS l_returnflag_{v}" for v in _FLAGS) + " FROM lineitem")
def one_hot(spark, sf):
    x = read(spark, sf, "lineitem").select(*LINE_KEY, "l_returnflag")
    return P.Encoding({"l_returnflag": list(_FLAGS)}).one_hot(x)


@query("e2_labels", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::bigint AS o_orderpriority FROM orders")
def labels(spark, sf):
    x = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    out = P.Encoding.fit(x, ("o_orderpriority",)).labels(x)
    return out.withColumn("o_orderpriority", F.col("o_orderpriority").cast("long"))


@query("l1_encoding_map", "SELECT DISTINCT 'o_orderstatus' AS original, o_orderstatus AS category, 'o_orderstatus_' || o_orderstatus AS encoded, 'o_orderstatus: ' || o_orderstatus AS readable FROM orders")
def encoding_map(spark, sf):
    x = read(spark, sf, "orders")
    return P.Encoding.fit(x, ("o_orderstatus",)).mapping(x)


@query("l2_readable_names", "SELECT feature, coalesce('o_orderstatus: ' || o_orderstatus, feature) AS readable FROM (SELECT DISTINCT 'o_orderstatus_' || o_orderstatus AS feature, o_orderstatus FROM orders UNION ALL SELECT 'o_totalprice', NULL)")
def readable_names(spark, sf):
    x = read(spark, sf, "orders")
    mapping = P.Encoding.fit(x, ("o_orderstatus",)).mapping(x)
    names = mapping.select(F.col("encoded").alias("feature")).union(spark.createDataFrame([("o_totalprice",)], "feature string"))
    return P.readable_names(names, mapping)


@query("l3_original_to_encoded", "SELECT o_orderkey, (o_orderstatus = 'F')::int AS \"o_orderstatus_F\", (o_orderstatus = 'X')::int AS \"o_orderstatus_X\" FROM orders")
def original_to_encoded(spark, sf):
    return P.Encoding({"o_orderstatus": ["F", "X"]}).one_hot(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"))


@query("u1_undo", f"SELECT o_orderkey, {PRICE} * 2 AS {PRICE} FROM orders")
def undo(spark, sf):
    h = P.History(orders(spark, sf))
    h.apply("double", lambda d: d.withColumn(PRICE, F.col(PRICE) * 2))
    h.apply("negate", lambda d: d.withColumn(PRICE, -F.col(PRICE)))
    h.undo()
    h.undo()
    return h.redo()


@query("u2_log", f"SELECT t.*, n_rows, total FROM (VALUES (1, 'double', '{{}}'), (2, 'undo', 'double'), (3, 'redo', 'double')) t(step, operation, parameters), (SELECT count(*) AS n_rows, round(sum({PRICE} * 2), 2) AS total FROM orders)")
def log(spark, sf):
    h = P.History(orders(spark, sf))
    h.apply("double", lambda d: d.withColumn(PRICE, F.col(PRICE) * 2))
    h.undo()
    h.redo()
    reached = h.current.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(PRICE), 2).alias("total"))  # what the steps lead to
    return h.log().join(reached)


@query("n2_progress", "SELECT user_id, count(DISTINCT event_type)::bigint AS n_done, round(count(DISTINCT event_type) / 5, 6) AS share, max(ts) AS newest FROM events GROUP BY 1")
def task_progress(spark, sf):
    from lodeworks.streaming.monitor import progress

    return rounded(progress(read(spark, sf, "events"), "user_id", "event_type", "ts", 5))


@query("s4_csv_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def csv_round_trip(spark, sf):
    from lodeworks.functions.storage import shared_folder
    from lodeworks.sources.tabular import read_csv, write_csv
    import uuid

    x = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = f"{shared_folder(spark)}/lodeworks-csv-{uuid.uuid4().hex}"
    write_csv(x, path, ";")
    return read_csv(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double", ";")


@query("s8_match_ids", "SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def match_ids(spark, sf):
    from lodeworks.sources.tabular import match_targets

    docs = read(spark, sf, "documents").select("doc_id", "n_chars")
    return match_targets(docs, read(spark, sf, "labels").select("doc_id", "quality"), "doc_id")[0]


@query("s8_unmatched_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmatched_ids(spark, sf):
    from lodeworks.sources.tabular import match_targets

    return match_targets(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels").select("doc_id"), "doc_id")[1]


@query("s9_json", "SELECT event_id, (props::json->>'k')::bigint AS k FROM events")
def json_column(spark, sf):
    from lodeworks.sources.tabular import parse_json

    return parse_json(read(spark, sf, "events"), "props", "k long").select("event_id", F.col("props.k").alias("k"))


@query("j2_snapshot", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def snapshot(spark, sf):
    import uuid

    from lodeworks.functions.storage import shared_folder
    from lodeworks.operators.project import Project

    nation = read(spark, sf, "nation")
    p = Project(spark, f"{shared_folder(spark)}/lodeworks-project-{uuid.uuid4().hex}")
    p.snapshot(nation, "nation")
    p.snapshot(nation.where("n_regionkey = 0"), "nation")
    return p.restore("nation", 1)


@query("n3_alerts", "SELECT event_id, user_id, value FROM events WHERE value > 90")
def alerts(spark, sf):
    from lodeworks.streaming.monitor import alerts as over

    return over(read(spark, sf, "events").select("event_id", "user_id", "value"), "value", 90.0)


@query("n1_usage", "SELECT time_bucket(INTERVAL '1 hour', ts)::timestamp AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(max(value), 6) AS max_value FROM events GROUP BY 1, 2")
def usage(spark, sf):
    from lodeworks.streaming.monitor import usage as over

    out = rounded(over(read(spark, sf, "events"), "ts", "event_type", "value"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


