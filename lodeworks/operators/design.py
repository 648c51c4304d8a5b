"""Candidate designs: generation, constraints, acquisition scores, dominance, feedback."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.functions.running import cut_points, running
from lodeworks.functions.scalars import clean, normal_cdf, normal_pdf
from lodeworks.functions.storage import materialised


@dataclass(frozen=True)
class Dimension:
    """A variable of a design space. kind: continuous, integer, binary or categorical."""

    name: str
    lo: float = 0.0
    hi: float = 1.0
    kind: str = "continuous"
    categories: tuple[str, ...] = ()

    def value(self, u: Column) -> Column:
        """From 0 <= u < 1 to a value of this variable."""
        if self.kind == "categorical":
            return F.array(*[F.lit(c) for c in self.categories])[F.floor(u * len(self.categories)).cast("int")]
        if self.kind == "binary":
            return (u >= 0.5).cast("int")
        if self.kind == "integer":
            return (F.lit(int(self.lo)) + F.floor(u * (int(self.hi) - int(self.lo) + 1))).cast("int")
        return F.lit(float(self.lo)) + u * (float(self.hi) - float(self.lo))

    def repaired(self, c: Column) -> Column:
        """The nearest allowed value."""
        if self.kind == "categorical":
            return F.when(c.isin(*self.categories), c).otherwise(F.lit(self.categories[0]))
        held = F.greatest(F.least(c, F.lit(float(self.hi))), F.lit(float(self.lo)))
        return F.round(held).cast("int") if self.kind in ("integer", "binary") else held


def grid(spark: SparkSession, levels: Mapping[str, Sequence[float]]) -> DataFrame:
    """All combinations of the levels, with an ``id``. Computed by arithmetic from a range, so made in parallel without a join."""
    total = reduce(lambda a, b: a * b, (len(v) for v in levels.values()), 1)
    out, below = spark.range(total), 1
    for name, values in reversed(list(levels.items())):
        out = out.withColumn(name, F.array(*[F.lit(float(v)) for v in values])[(F.floor(F.col("id") / below) % len(values)).cast("int")])
        below *= len(values)
    return out.select("id", *levels)


def latin_hypercube(spark: SparkSession, dimensions: Sequence[Dimension], n: int, seed: int = 0, rounds: int = 4) -> DataFrame:
    """``n`` candidates, each of the n strata of every dimension hit once, at its centre. Strata are permuted by a keyed
    bijection (a walk over the next power of two), so every row is computed by itself, without a sort."""
    bits = max(2, (n - 1).bit_length())
    bits += bits % 2
    half, mask = bits // 2, (1 << (bits // 2)) - 1

    def permuted(x: Column, key: int) -> Column:
        def once(v: Column) -> Column:
            left, right = F.shiftright(v, half), v.bitwiseAND(F.lit(mask))
            for r in range(rounds):
                mixed = F.pmod(F.xxhash64(right, F.lit(key), F.lit(r)), F.lit(mask + 1))
                left, right = right, left.bitwiseXOR(mixed)
            return F.shiftleft(left, half).bitwiseOR(right)

        return F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(x), lambda acc, _: F.when(acc < n, acc).otherwise(once(acc)))

    out = spark.range(n)
    for k, d in enumerate(dimensions):
        out = out.withColumn(d.name, d.value((permuted(F.col("id"), seed * 1000 + k) + 0.5) / n))
    return out


def hash_hypercube(ids: DataFrame, key: str, names: Sequence[str], seed: int = 0) -> DataFrame:
    """The same for the rows of a table: strata are the ranks of an md5 of its key, 0 .. n-1, centred and divided by n. Ranks are
    taken in ranges of the hash."""
    n = ids.count()
    out = ids
    for k, name in enumerate(names):
        hashed = ids.select(key, F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed + k)), F.col(key).cast("string"))), 1, 13), 16, 10).cast("long").alias("_h")).withColumn("_one", F.lit(1))
        ranks = running(hashed, "_h", {"_rank": (F.sum, "_one")}).select(key, ((F.coalesce("_rank", F.lit(0)) + 0.5) / n).alias(name))
        out = out.join(ranks, key)
    return out


# Primitive polynomials and initial direction numbers of Joe and Kuo (degree, coefficients, m).
SOBOL = [(1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3))]
SOBOL_BITS = 30


def direction_numbers(k: int) -> list[int]:
    """Those of dimension ``k``, from 0."""
    if k == 0:
        return [1 << (SOBOL_BITS - i - 1) for i in range(SOBOL_BITS)]
    s, a, m = SOBOL[k - 1]
    v = [m[i] << (SOBOL_BITS - i - 1) for i in range(s)]
    for i in range(s, SOBOL_BITS):
        x = v[i - s] ^ (v[i - s] >> s)
        for j in range(1, s):
            x ^= ((a >> (s - 1 - j)) & 1) * v[i - j]
        v.append(x)
    return v


def sobol(spark: SparkSession, names: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` points of the Sobol sequence in up to 6 dimensions, after the zero point, by their direction numbers."""
    if len(names) > len(SOBOL) + 1:
        raise ValueError("at most 6 dimensions")
    out = spark.range(1, n + 1)
    gray = F.col("id").bitwiseXOR(F.shiftright("id", 1))
    for k, name in enumerate(names):
        v = direction_numbers(k)
        used = max(1, n.bit_length())
        point = reduce(lambda acc, i: acc.bitwiseXOR(F.when(gray.bitwiseAND(F.lit(1 << i)) != 0, F.lit(v[i])).otherwise(F.lit(0))), range(used), F.lit(0))
        out = out.withColumn(name, point / float(1 << SOBOL_BITS))
    return out


def repair(df: DataFrame, dimensions: Sequence[Dimension]) -> DataFrame:
    """Every variable is moved to its nearest allowed value."""
    return df.withColumns({d.name: d.repaired(F.col(d.name)) for d in dimensions})


def violation(constraints: Sequence[Column]) -> Column:
    """How far constraints of the form (expression <= 0) are broken, in sum; 0 for a feasible row."""
    return sum((F.greatest(c.cast("double"), F.lit(0.0)) for c in constraints), F.lit(0.0))


def penalised(objective: Column, constraints: Sequence[Column], factor: float = 1e3) -> Column:
    """An objective to be minimised plus ``factor`` times the violation."""
    return objective + factor * violation(constraints)


_ROUND = "turn int, settings string, best string, generation int, reached double, n_feasible long, diversity double"


def _resumed(spark: SparkSession, folder: str, settings: str) -> list:
    """The rounds that a search with these settings has written, in order."""
    try:
        rows = spark.read.schema(_ROUND).parquet(f"{folder}/round-*").orderBy("turn").collect()  # a row a round
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    if any(r["settings"] != settings for r in rows):
        raise ValueError(f"{folder} holds the rounds of another search")
    return [r for i, r in enumerate(rows) if r["turn"] == i]


def diversity(dimensions: Sequence[Dimension]) -> Column:
    """An aggregate: how far candidates spread, from 0 for equal ones; the mean over dimensions of the deviation as a share of the whole
    range, or, of categories, the chance that two differ."""
    parts = []
    for d in dimensions:
        if d.kind in ("binary", "categorical"):
            values = d.categories if d.kind == "categorical" else (0, 1)
            parts.append(F.lit(1.0) - sum((F.pow(F.avg((F.col(d.name) == v).cast("double")), F.lit(2.0)) for v in values), F.lit(0.0)))
        else:
            parts.append(F.stddev_pop(d.name) / F.nullif(F.lit(float(d.hi) - float(d.lo)), F.lit(0.0)))
    return sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / len(parts)


def zoom_search(spark: SparkSession, dimensions: Sequence[Dimension], score: Callable[[DataFrame], DataFrame], constraints: Sequence[Column] = (), maximise: bool = True, pool: int = 20_000, rounds: int = 4, shrink: float = 0.4, seed: int = 0, stop: Callable[[], bool] = lambda: False, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The best feasible design found, and the trace (generation, best, n_feasible, diversity) of the search.

    Each round spreads ``pool`` candidates over a box by Latin hypercube, drops those that break a constraint (expression <= 0), scores
    the rest as one table (``score`` adds ``prediction``) and centres the next box, ``shrink`` times as wide in each continuous or integer
    dimension, on the best so far. Only that one design and the trace reach the driver. ``stop`` is asked before every round.
    Without a feasible candidate the box stays. ``diversity`` of a generation is that of its feasible candidates.

    With ``folder``, a shared one, every round is written there once it is done, with the settings of the search; a search that was broken off
    goes on behind the last whole round and comes to the same result. A folder of another search is an error.
    """
    box, best, trace, sign = list(dimensions), None, [], 1 if maximise else -1
    names = [d.name for d in dimensions]
    settings = json.dumps([[asdict(d) for d in dimensions], maximise, pool, shrink, seed])
    done = _resumed(spark, folder, settings)[:rounds] if folder else []
    for turn in range(rounds):
        if turn < len(done):
            best = json.loads(done[turn]["best"])
            trace.append(tuple(done[turn][c] for c in ("generation", "reached", "n_feasible", "diversity")))
        else:
            if stop():
                break
            candidates = latin_hypercube(spark, box, pool, seed + turn)
            feasible = score(candidates.where(violation(constraints) <= 0)).where(F.col("prediction").isNotNull())
            row = feasible.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct((F.col("prediction") * sign).alias("p"), (-F.col("id")).alias("i"), *names)).alias("best"), diversity(dimensions).alias("diversity")).first()
            if row["n"] and (best is None or row["best"]["p"] > best["p"]):
                best = row["best"].asDict()
            trace.append((turn, None if best is None else float(best["p"] * sign), row["n"], float(row["diversity"]) if row["n"] else None))
            if folder:
                spark.createDataFrame([(turn, settings, json.dumps(best), *trace[-1])], _ROUND).write.mode("overwrite").parquet(f"{folder}/round-{turn:05}")
        if best is not None:
            box = [d if d.kind in ("binary", "categorical") else _around(d, b, best[d.name], shrink) for d, b in zip(dimensions, box)]
    found = [] if best is None else [tuple(best[n] for n in names) + (float(best["p"] * sign),)]
    kinds = {"continuous": "double", "integer": "int", "binary": "int", "categorical": "string"}
    schema = ", ".join([*(f"`{d.name}` {kinds[d.kind]}" for d in dimensions), "prediction double"])
    return spark.createDataFrame(found, schema), spark.createDataFrame(trace, "generation int, best double, n_feasible long, diversity double")


def _around(whole: Dimension, now: Dimension, centre: float, shrink: float) -> Dimension:
    half = (now.hi - now.lo) * shrink / 2
    if whole.kind == "integer":
        half = max(round(half), 1)
    return Dimension(whole.name, max(whole.lo, centre - half), min(whole.hi, centre + half), whole.kind)


def expected_improvement(mu: Column, sigma: Column, best: float, xi: float = 0.0) -> Column:
    """For maximisation; where sigma is 0, what the mean itself improves."""
    gain = mu - best - xi
    z = gain / F.nullif(sigma, F.lit(0.0))
    return F.when(sigma > 0, gain * normal_cdf(z) + sigma * normal_pdf(z)).otherwise(F.greatest(gain, F.lit(0.0)))


def upper_confidence_bound(mu: Column, sigma: Column, kappa: float = 2.0) -> Column:
    return mu + kappa * sigma


def next_batch(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The ``n`` candidates of the best score, ties by key, with their rank: a top-k report of bounded size."""
    top = df.orderBy(F.desc(score), key).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(score), key)))


def absorb(observed: DataFrame, candidates: DataFrame, results: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Adds measured results to the observed table, and takes them out of the candidates."""
    return observed.unionByName(results), candidates.join(results.select(key), key, "left_anti")


def pareto_front(df: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Rows that no other row dominates in two objectives, each (column, 'min' or 'max'); equal points are all kept, rows
    with a missing objective are not. A skyline: the best second objective of each first one, and of all better ones by a running minimum
    in ranges; no row meets all others."""
    sign = lambda o: F.col(o[0]).cast("double") * (1 if o[1] == "min" else -1)
    rows = df.withColumns({"_a": sign(first), "_b": sign(second)}).where("_a is not null and _b is not null and not isnan(_a) and not isnan(_b)")
    best = rows.groupBy("_a").agg(F.min("_b").alias("_b"))
    ran = running(best, "_a", {"_before": (F.min, "_b")})
    front = ran.where(F.col("_before").isNull() | (F.col("_b") < F.col("_before"))).select(F.col("_a").alias("_fa"), F.col("_b").alias("_fb"))
    return rows.join(front, (F.col("_a") == F.col("_fa")) & (F.col("_b") == F.col("_fb")), "left_semi").drop("_a", "_b")


def dominated(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows of ``points`` some row of ``by`` dominates, all columns minimised."""
    out = np.zeros(len(points), bool)
    for lo in range(0, len(by), 2048):
        left = np.flatnonzero(~out)
        x, y = points[left][:, None], by[lo : lo + 2048][None]
        out[left] = ((y <= x).all(2) & (y < x).any(2)).any(1)
    return out


def undominated(points: np.ndarray) -> np.ndarray:
    """Which rows no other row dominates, all columns minimised; equal rows are all kept. In order of their sums, and of columns
    where sums are equal, a row can be dominated by earlier ones only, so blocks are held against the front so far and against themselves."""
    order = np.lexsort((*points.T[::-1], points.sum(1)))
    keep, front = np.zeros(len(points), bool), [np.zeros((0, points.shape[1]))]
    for lo in range(0, len(order), 256):
        at = order[lo : lo + 256]
        at = at[~dominated(points[at], np.concatenate(front))]
        at = at[~dominated(points[at], points[at])]
        keep[at] = True
        front = [np.concatenate([*front, points[at]])]
    return keep


def pareto_front_of_many(df: DataFrame, objectives: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows that no other row dominates in any number of objectives, each (column, 'min' or 'max'); equal points are all kept, rows with
    a missing objective are not.

    Points are thinned in every task first, to those undominated among its own. What is left is packed into blocks, and every block
    is held against every other one; a point stays if no block dominates it. So the work grows with the square of the points
    that are left, never with that of the rows, and no task holds more than two blocks."""
    names = [f"_o{i}" for i in range(len(objectives))]
    rows = df.withColumns({n: F.col(c).cast("double") * (1 if how == "min" else -1) for n, (c, how) in zip(names, objectives)})
    whole = reduce(lambda a, b: a & b, (F.col(n).isNotNull() & ~F.isnan(n) for n in names))
    rows = rows.where(whole)

    def thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(columns=names, dtype=float)
        for frame in frames:
            both = pd.concat([held, frame.drop_duplicates()], ignore_index=True) if len(held) else frame.drop_duplicates().reset_index(drop=True)
            held = both[undominated(both.to_numpy(float))]
        if len(held):
            yield held

    schema = ", ".join(f"{n} double" for n in names)
    left = materialised(rows.select(*names).mapInPandas(thin, schema).distinct(), "undominated")
    blocks = max(1, -(-left.count() // 1024))
    dealt = left.withColumn("_b", F.pmod(F.xxhash64(*names), F.lit(blocks)))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    own = dealt.withColumn("_against", every).withColumn("_own", F.lit(True))  # a block's points, once for each block they are held against
    others = dealt.withColumnRenamed("_b", "_against").withColumn("_b", every).withColumn("_own", F.lit(False))

    def check(frame: pd.DataFrame) -> pd.DataFrame:
        own, others = frame[frame["_own"]][names], frame[~frame["_own"]][names].to_numpy(float)
        return own[np.concatenate([dominated(part, others) for part in np.array_split(own.to_numpy(float), max(1, len(own) // 256))])]

    beaten = own.unionByName(others).groupBy("_b", "_against").applyInPandas(check, schema).distinct()
    front = left.join(beaten, names, "left_anti")
    return rows.join(front, names, "left_semi").drop(*names)


def hypervolume(front: DataFrame, first: str, second: str, reference: tuple[float, float]) -> DataFrame:
    """The area between a front of two minimised objectives and a reference point that is worse than all of it."""
    points = front.select(F.col(first).cast("double").alias("a"), F.col(second).cast("double").alias("b")).where((F.col("a") < reference[0]) & (F.col("b") < reference[1]))
    best = points.groupBy("a").agg(F.min("b").alias("b"))
    # What the next point to the left leaves: the lowest b before, or the reference.
    ran = running(best, "a", {"before": (F.min, "b")})
    height = F.greatest(F.coalesce("before", F.lit(float(reference[1]))) - F.col("b"), F.lit(0.0))
    return ran.agg(F.coalesce(F.sum((F.lit(float(reference[0])) - F.col("a")) * height), F.lit(0.0)).alias("hypervolume"))


def volume(points: np.ndarray, reference: np.ndarray) -> float:
    """The volume between minimised points, all below the reference, and it: by slices along the last column."""
    if not len(points):
        return 0.0
    if points.shape[1] == 1:
        return float(reference[0] - points.min())
    if points.shape[1] == 2:
        x = points[np.lexsort((points[:, 1], points[:, 0]))]
        lowest = np.minimum.accumulate(np.r_[reference[1], x[:, 1]])
        return float(((reference[0] - x[:, 0]) * (lowest[:-1] - lowest[1:])).sum())
    levels = np.unique(points[:, -1])
    return sum(volume(points[points[:, -1] <= z][:, :-1], reference[:-1]) * (end - z) for z, end in zip(levels, np.r_[levels[1:], reference[-1]]))


def hypervolume_of_many(df: DataFrame, objectives: Sequence[str], reference: Sequence[float], ranges: int = 32) -> DataFrame:
    """(hypervolume) between the rows' front of two or more minimised objectives and a reference point; rows that are not below it in all of them
    add nothing, and those with a missing objective are left out.

    Points are cut into ranges of the last objective. A range needs to know of lower ones only which of their points no other one of theirs dominates in
    the other objectives; with these a task goes up through its own range level by level, keeps that skyline, and adds up its volume times the
    step to the next level. What lies between two ranges is added at the end, from a row for each range."""
    names, ref = [f"o{i}" for i in range(len(objectives))], np.array(reference, float)
    points = df.select(*[clean(F.col(c)).alias(n) for n, c in zip(names, objectives)])
    below = reduce(lambda a, b: a & b, (F.col(n) < float(r) for n, r in zip(names, reference)))
    front = materialised(pareto_front_of_many(points.where(below).distinct(), [(n, "min") for n in names]), "front")
    last, schema = names[-1], ", ".join(f"{n} double" for n in names)
    cuts = cut_points(front, last, ranges) if front.limit(1).count() else []
    dealt = front.withColumn("_r", sum(((F.col(last) > c).cast("int") for c in cuts), F.lit(0)))

    def skyline(frame: pd.DataFrame) -> pd.DataFrame:
        return frame[undominated(frame[names[:-1]].to_numpy(float))]

    each = dealt.groupBy("_r").applyInPandas(skyline, f"{schema}, _r int")
    lower = each.withColumn("_to", F.explode(F.sequence(F.col("_r") + 1, F.lit(len(cuts) + 1)))).where(F.col("_to") <= len(cuts)).select(*names, F.col("_to").alias("_r"), F.lit(True).alias("_lower"))

    def climbed(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[~frame["_lower"]].sort_values(last, kind="stable")
        if not len(own):
            return pd.DataFrame({"first": [], "last": [], "volume": [], "area": []})
        held = frame[frame["_lower"]][names[:-1]].to_numpy(float)
        held, total, area, at = held[undominated(held)], 0.0, 0.0, None
        for z, level in own.groupby(last, sort=True):
            if at is not None:
                total += area * (z - at)
            held = np.concatenate([held, level[names[:-1]].to_numpy(float)])
            held, at = held[undominated(held)], z
            area = volume(held, ref[:-1])
        return pd.DataFrame({"first": [own[last].iloc[0]], "last": [at], "volume": [total], "area": [area]})

    rows = dealt.withColumn("_lower", F.lit(False)).unionByName(lower).groupBy("_r").applyInPandas(climbed, "first double, last double, volume double, area double").collect()  # a row a range
    rows = sorted(rows, key=lambda r: r["first"])
    total = sum(r["volume"] + r["area"] * (end - r["last"]) for r, end in zip(rows, [*(r["first"] for r in rows[1:]), float(ref[-1])]))
    return df.sparkSession.createDataFrame([(float(total),)], "hypervolume double")


def robust_scores(df: DataFrame, key: str, features: Mapping[str, float], objective: Column, draws: int = 8, seed: int = 0) -> DataFrame:
    """Mean and worst value of an expression over ``draws`` perturbed copies of each candidate; ``features`` gives the half width of each
    perturbation, which an md5 of key, draw and feature draws from 101 levels."""
    copies = df.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    for k, (c, width) in enumerate(features.items()):
        level = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed + k)), F.col(key).cast("string"), F.col("_draw").cast("string"))), 1, 8), 16, 10).cast("bigint") % 101
        copies = copies.withColumn(c, F.col(c) + (level / 50.0 - 1.0) * width)
    return copies.groupBy(key).agg(F.avg(objective).alias("mean_score"), F.max(objective).alias("worst_score"))


def running_best(df: DataFrame, order: str, value: str) -> DataFrame:
    """Adds ``best``: the largest value up to each row, in order of a unique number."""
    return running(df, order, {"_best": (F.max, value)}).withColumn("best", F.greatest("_best", value)).drop("_best")


def parallel_coordinates(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(key, column_name, scaled): every column between 0 and 1, in long form; a constant column gives 0."""
    row = df.agg(*[x for c in cols for x in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"))]).first()
    scaled = {c: (F.col(c) - row[f"a_{c}"]) / (row[f"b_{c}"] - row[f"a_{c}"]) if row[f"b_{c}"] != row[f"a_{c}"] else F.lit(0.0) for c in cols}
    cells = [F.struct(F.lit(c).alias("column_name"), x.cast("double").alias("scaled")) for c, x in scaled.items()]
    return df.select(key, F.explode(F.array(*cells)).alias("x")).select(key, "x.*")


