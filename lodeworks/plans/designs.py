"""Queries over candidate designs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.functions.scalars import normal_cdf_sql
from lodeworks.operators import design as D
from lodeworks.operators.prepare import least_squares
from lodeworks.plans.query import query, read, rounded

#: Mean and spread of a surrogate over parts, by arithmetic.
SURROGATE = "(SELECT p_partkey, (p_size * 37 % 101)::double / 10 AS mu, (p_partkey % 7)::double / 3 AS sigma FROM part)"


def surrogate(spark, sf):
    return read(spark, sf, "part").select("p_partkey", ((F.col("p_size") * 37 % 101).cast("double") / 10).alias("mu"), ((F.col("p_partkey") % 7).cast("double") / 3).alias("sigma"))


@query(
    "a1_latin_hypercube",
    """SELECT p_partkey, (row_number() OVER (ORDER BY ('0x' || substr(md5('5|' || p_partkey), 1, 13))::bigint) - 0.5) / count(*) OVER () AS u,
    (row_number() OVER (ORDER BY ('0x' || substr(md5('6|' || p_partkey), 1, 13))::bigint) - 0.5) / count(*) OVER () AS v FROM part""".replace("SELECT p_partkey, (", "SELECT p_partkey, round((", 1).replace("OVER () AS u", "OVER (), 6) AS u").replace("    (row", "    round((row").replace("OVER () AS v", "OVER (), 6) AS v"),
)
def latin_hypercube(spark, sf):
    return rounded(D.hash_hypercube(read(spark, sf, "part").select("p_partkey"), "p_partkey", ("u", "v"), 5))


@query("a1_generated_hypercube")
def generated_hypercube(spark, sf):
    space = [D.Dimension("a", 0, 10), D.Dimension("b", 1, 5, "integer"), D.Dimension("c", kind="categorical", categories=("x", "y", "z"))]
    return rounded(D.latin_hypercube(spark, space, 10_000))


#: Levels of a grid: the values that lineitem has of three columns.
LEVELS = {"a": "l_linenumber", "b": "l_tax", "c": "l_discount"}
GRID_SQL = "(SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS id, a, b, c FROM " + ", ".join(f"(SELECT DISTINCT {c}::double AS {n} FROM lineitem)" for n, c in LEVELS.items()) + ")"


def level_grid(spark, sf):
    row = read(spark, sf, "lineitem").agg(*[F.array_sort(F.collect_set(F.col(c).cast("double"))).alias(n) for n, c in LEVELS.items()]).first()  # of a few values each
    return D.grid(spark, {n: tuple(row[n]) for n in LEVELS})


@query("a2_grid", f"SELECT * FROM {GRID_SQL}")
def grid(spark, sf):
    return level_grid(spark, sf)


def _sobol_sql(names: tuple[str, ...], n: int) -> str:
    """A sum of direction numbers in place of exclusive ors: bit by bit, whether an odd number of them has it."""
    point = lambda k: " + ".join(f"(({' + '.join(f'(g >> {i} & 1) * {v >> b & 1}' for i, v in enumerate(D.direction_numbers(k)[: n.bit_length()]))}) % 2) * {1 << b}" for b in range(D.SOBOL_BITS - n.bit_length(), D.SOBOL_BITS))
    return f"SELECT id, {', '.join(f'({point(k)}) / {1 << D.SOBOL_BITS}::double AS {c}' for k, c in enumerate(names))} FROM (SELECT id, xor(id, id >> 1) AS g FROM (SELECT unnest(range(1, {n + 1})) AS id))"


# Points of the unit box, spread over the box of all parts.
@query("a3_sobol", f"SELECT id, round(lo_s + a * (hi_s - lo_s), 6) AS a, round(lo_p + b * (hi_p - lo_p), 6) AS b, c, d FROM ({_sobol_sql(('a', 'b', 'c', 'd'), 4096)}), (SELECT min(p_size) AS lo_s, max(p_size) AS hi_s, min(p_retailprice) AS lo_p, max(p_retailprice) AS hi_p FROM part)")
def sobol(spark, sf):
    box = read(spark, sf, "part").agg(F.min("p_size"), F.max("p_size"), F.min("p_retailprice"), F.max("p_retailprice")).first()
    spread = lambda c, lo, hi: F.round(lo + F.col(c) * (hi - lo), 6)
    return D.sobol(spark, ("a", "b", "c", "d"), 4096).withColumns({"a": spread("a", box[0], box[1]), "b": spread("b", box[2], box[3])})


@query("a5_expected_improvement", f"WITH s AS (SELECT *, (mu - 8) / nullif(sigma, 0) AS z FROM {SURROGATE}) SELECT p_partkey, round(CASE WHEN sigma > 0 THEN (mu - 8) * {normal_cdf_sql('z')} + sigma * (exp(-z * z / 2) / sqrt(2 * pi())) ELSE greatest(mu - 8, 0) END, 6) + 0.0 AS ei FROM s")
def expected_improvement(spark, sf):
    return rounded(surrogate(spark, sf).select("p_partkey", D.expected_improvement(F.col("mu"), F.col("sigma"), 8.0).alias("ei")))


@query("a6_upper_confidence_bound", f"SELECT p_partkey, round(mu + 2 * sigma, 6) AS ucb FROM {SURROGATE}")
def upper_confidence_bound(spark, sf):
    return rounded(surrogate(spark, sf).select("p_partkey", D.upper_confidence_bound(F.col("mu"), F.col("sigma")).alias("ucb")))


@query("a7_next_batch", f"SELECT p_partkey, round(mu + 2 * sigma, 6) AS ucb, row_number() OVER (ORDER BY round(mu + 2 * sigma, 6) DESC, p_partkey)::int AS rank FROM {SURROGATE} ORDER BY rank LIMIT 10")
def next_batch(spark, sf):
    return D.next_batch(upper_confidence_bound(spark, sf), "ucb", "p_partkey", 10)


@query("a8_absorb", "SELECT (SELECT count(*) FROM part WHERE p_partkey % 10 < 2) AS n_observed, (SELECT count(*) FROM part WHERE p_partkey % 10 >= 2) AS n_candidates")
def absorb(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_retailprice")
    old, new = p.where("p_partkey % 10 = 0"), p.where("p_partkey % 10 = 1")
    observed, left = D.absorb(old, p.join(old, "p_partkey", "left_anti"), new, "p_partkey")
    return observed.agg(F.count(F.lit(1)).alias("n_observed")).join(left.agg(F.count(F.lit(1)).alias("n_candidates")))


@query("a9_running_best", "SELECT o_orderkey, max(o_totalprice) OVER (ORDER BY o_orderkey) AS best FROM orders")
def running_best(spark, sf):
    return D.running_best(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice").select("o_orderkey", "best")


@query("a10_slice", f"SELECT a, c FROM {GRID_SQL} WHERE b = 0.05")
def design_slice(spark, sf):
    return level_grid(spark, sf).where("b = 0.05").select("a", "c")


@query("mo5_pareto", "SELECT o_orderkey, o_totalprice, o_custkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_totalprice >= a.o_totalprice AND b.o_custkey <= a.o_custkey AND (b.o_totalprice > a.o_totalprice OR b.o_custkey < a.o_custkey))")
def pareto(spark, sf):
    return D.pareto_front(read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), ("o_totalprice", "max"), ("o_custkey", "min"))


@query("mo5_pareto_three", "WITH p AS (SELECT p_partkey, p_retailprice AS a, p_size AS b, p_partkey % 97 AS c FROM part) SELECT p_partkey FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.a <= x.a AND y.b <= x.b AND y.c >= x.c AND (y.a < x.a OR y.b < x.b OR y.c > x.c))")
def pareto_of_three(spark, sf):
    p = read(spark, sf, "part").withColumn("c", F.col("p_partkey") % 97)
    return D.pareto_front_of_many(p, (("p_retailprice", "min"), ("p_size", "min"), ("c", "max"))).select("p_partkey")


@query("mo6_hypervolume", "WITH g AS (SELECT p_retailprice AS a, min(p_size)::double AS b FROM part GROUP BY 1), s AS (SELECT a, b, coalesce(min(b) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 60) AS m FROM g) SELECT round(sum((1100 - a) * greatest(m - b, 0)), 4) AS hypervolume FROM s")
def hypervolume(spark, sf):
    return rounded(D.hypervolume(read(spark, sf, "part"), "p_retailprice", "p_size", (1100.0, 60.0)), 4)


@query("mo8_repair", "SELECT p_partkey, round(greatest(least(p_retailprice, 950), 910), 6) AS p_retailprice, round(greatest(least(p_size + 0.25, 40), 5))::int AS p_size, CASE WHEN p_type IN (SELECT min(p_type) FROM part) THEN p_type ELSE (SELECT min(p_type) FROM part) END AS p_type FROM part")
def repair(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_retailprice", (F.col("p_size") + 0.25).cast("double").alias("p_size"), "p_type")
    first = p.agg(F.min("p_type")).first()[0]
    return rounded(D.repair(p, [D.Dimension("p_retailprice", 910, 950), D.Dimension("p_size", 5, 40, "integer"), D.Dimension("p_type", kind="categorical", categories=(first,))]))


@query("mo9_constraints", f"SELECT id, a, b, c, round(greatest(a + 20 * b - 5, 0) + greatest(c * a - 0.3, 0), 6) + 0.0 AS violation, round(a * a + 1000 * (greatest(a + 20 * b - 5, 0) + greatest(c * a - 0.3, 0)), 4) + 0.0 AS penalised FROM {GRID_SQL}")
def constraints(spark, sf):
    held = [F.col("a") + 20 * F.col("b") - 5, F.col("c") * F.col("a") - 0.3]
    out = level_grid(spark, sf).withColumns({"violation": D.violation(held), "penalised": D.penalised(F.col("a") * F.col("a"), held)})
    return out.select("id", "a", "b", "c", (F.round("violation", 6) + 0.0).alias("violation"), (F.round("penalised", 4) + 0.0).alias("penalised"))


@query("mo10_robust", "WITH d AS (SELECT p_partkey, p_size + (('0x' || substr(md5('0|' || p_partkey || '|' || d), 1, 8))::bigint % 101 / 50.0 - 1) * 2 AS s FROM part, (SELECT unnest(range(1, 9)) AS d)) SELECT p_partkey, round(avg((s - 25) ** 2), 5) AS mean_score, round(max((s - 25) ** 2), 5) AS worst_score FROM d GROUP BY 1")
def robust(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))
    return rounded(D.robust_scores(p, "p_partkey", {"p_size": 2.0}, (F.col("p_size") - 25) * (F.col("p_size") - 25)), 5)


@query("mo13_parallel_coordinates", " UNION ALL ".join(f"SELECT p_partkey, '{c}' AS column_name, round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS scaled FROM part" for c in ("p_size", "p_retailprice")))
def parallel_coordinates(spark, sf):
    return rounded(D.parallel_coordinates(read(spark, sf, "part"), "p_partkey", ("p_size", "p_retailprice")))


@query("z7_zoom_search")
def zoom_search(spark, sf):
    # The part that a plane fitted to all parts makes dearest, within their box and under a joint limit.
    parts = read(spark, sf, "part").select(F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 100).cast("double").alias("b"), F.col("p_retailprice").alias("y"))
    w = least_squares(parts, ("a", "b"), "y")
    lo_a, hi_a, lo_b, hi_b = parts.agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    space = [D.Dimension("a", lo_a, hi_a), D.Dimension("b", lo_b, hi_b), D.Dimension("k", 1, 6, "integer")]
    score = lambda d: d.withColumn("prediction", w[0] + w[1] * F.col("a") + w[2] * F.col("b") - (F.col("k") - 4) * (F.col("k") - 4))
    best, _ = D.zoom_search(spark, space, score, [F.col("a") / hi_a + F.col("b") / hi_b - 1])
    return rounded(best)
