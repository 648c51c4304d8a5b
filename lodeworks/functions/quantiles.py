"""Exact quantiles of any number of rows, by refining histograms: no task and no driver ever holds a column."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.scalars import clean

BINS = 4096


@dataclass
class _Target:
    """The value of one rank, known to lie in lo..hi with ``before`` values below lo."""

    rank: int
    lo: float
    hi: float
    before: int = 0


def exact_quantiles(df: DataFrame, probs: Mapping[str, Sequence[float]], bins: int = BINS) -> dict[str, list[float | None]]:
    """For each column its quantiles, with linear interpolation between neighbouring ranks.

    Null and NaN are left out; a column without values has None throughout. Eager: every pass is one aggregate over all columns
    that sends at most ``bins`` rows per open interval to the driver, and shrinks each interval ``bins`` times.
    """
    names = list(probs)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(n).cast("double").alias("v")) for i, n in enumerate(names)])).alias("x")
    long = df.select(cells).select("x.c", "x.v").where("v is not null and not isnan(v)")
    row = df.agg(*[f(clean(F.col(n))).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    limits = {i: {k: row[f"{k}{i}"] for k in ("n", "lo", "hi")} for i in range(len(names)) if row[f"n{i}"]}
    targets: dict[tuple[int, int], _Target] = {}
    for i, name in enumerate(names):
        if i in limits:
            for p in probs[name]:
                at = p * (limits[i]["n"] - 1)
                for rank in {math.floor(at), math.ceil(at)}:
                    targets[i, rank] = _Target(rank, limits[i]["lo"], limits[i]["hi"])
    while True:
        spans = sorted({(c, t.lo, t.hi) for (c, _), t in targets.items() if t.lo < t.hi})
        if not spans:
            break
        inside = [(F.col("c") == c) & F.col("v").between(lo, hi) for c, lo, hi in spans]
        # Halved first, so that a range wider than the largest double does not overflow.
        share = [F.least(F.floor((F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2) * bins), F.lit(bins - 1)) if hi / 2 > lo / 2 else (F.col("v") > lo).cast("long") for _, lo, hi in spans]
        number = reduce(lambda acc, k: acc.when(inside[k], F.struct(F.lit(k).alias("span"), share[k].alias("bin"))), range(1, len(spans)), F.when(inside[0], F.struct(F.lit(0).alias("span"), share[0].alias("bin"))))
        found = long.select("v", number.alias("at")).where("at is not null").groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        rows: dict[int, list] = {}
        for r in sorted(found, key=lambda r: (r["at"]["span"], r["at"]["bin"])):
            rows.setdefault(r["at"]["span"], []).append(r)
        for (c, _), t in targets.items():
            if t.lo < t.hi:
                for r in rows[spans.index((c, t.lo, t.hi))]:
                    if t.rank < t.before + r["n"]:
                        t.lo, t.hi = r["lo"], r["hi"]
                        break
                    t.before += r["n"]
    out: dict[str, list[float | None]] = {}
    for i, name in enumerate(names):
        values = []
        for p in probs[name]:
            if i not in limits:
                values.append(None)
                continue
            at = p * (limits[i]["n"] - 1)
            low, high = targets[i, math.floor(at)].lo, targets[i, math.ceil(at)].lo
            values.append(low + (high - low) * (at - math.floor(at)))
        out[name] = values
    return out
