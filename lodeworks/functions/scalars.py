"""Column expressions that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """A double whose NaN is null: Spark tells them apart, this library does not."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


# Coefficients of the rational approximation 26.2.17 of Abramowitz and Stegun, error below 7.5e-8.
CDF_P, CDF_B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, within 7.5e-8."""
    t = F.lit(1.0) / (F.lit(1.0) + F.abs(z) * CDF_P)
    poly = F.lit(0.0)
    for b in reversed(CDF_B):
        poly = (poly + F.lit(b)) * t
    upper = normal_pdf(z) * poly
    return F.when(z >= 0, 1.0 - upper).otherwise(upper)


def normal_cdf_sql(z: str) -> str:
    t = f"(1.0::double / (1.0::double + abs({z}) * {CDF_P}::double))"
    poly = "0.0::double"
    for b in reversed(CDF_B):
        poly = f"(({poly} + ({b})::double) * {t})"
    upper = f"(exp(-({z}) * ({z}) / 2) / {math.sqrt(2 * math.pi)!r}::double * {poly})"
    return f"(CASE WHEN {z} >= 0 THEN 1.0::double - {upper} ELSE {upper} END)"


# Coefficients of Acklam's rational approximations of the inverse normal distribution function, relative error below 1.2e-9: near the
# middle, a numerator and a denominator in (p - 1/2)^2; in the tails below INVERSE_TAIL, in sqrt(-2 ln p).
INVERSE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
INVERSE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
INVERSE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
INVERSE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
INVERSE_TAIL = 0.02425


def inverse_normal_cdf(p: Column) -> Column:
    """The value below which a share ``p``, between 0 and 1, of a standard normal variate lies; within 1.2e-9 of its size."""

    def poly(coefficients: tuple[float, ...], x: Column) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + F.lit(c)
        return out

    q = p - 0.5
    far = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = poly(INVERSE_C, far) / poly(INVERSE_D, far)  # of the lower half, below 0
    middle = q * poly(INVERSE_A, q * q) / poly(INVERSE_B, q * q)
    return F.when(F.least(p, 1 - p) >= INVERSE_TAIL, middle).when(p < 0.5, tail).otherwise(-tail)


def inverse_normal_cdf_sql(p: str) -> str:
    def poly(coefficients: tuple[float, ...], x: str) -> str:
        out = f"({coefficients[0]!r})::double"
        for c in coefficients[1:]:
            out = f"({out} * {x} + ({c!r})::double)"
        return out

    q, far = f"({p} - 0.5::double)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    tail = f"({poly(INVERSE_C, far)} / {poly(INVERSE_D, far)})"
    middle = f"({q} * {poly(INVERSE_A, f'({q} * {q})')} / {poly(INVERSE_B, f'({q} * {q})')})"
    return f"(CASE WHEN least({p}, 1 - {p}) >= {INVERSE_TAIL} THEN {middle} WHEN {p} < 0.5 THEN {tail} ELSE -{tail} END)"


def yeo_johnson(x: Column, power: float) -> Column:
    """The Yeo-Johnson transform for a given power."""
    up = F.log1p(x) if power == 0 else (F.pow(x + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-x) if power == 2 else -(F.pow(1 - x, F.lit(2.0 - power)) - 1) / (2.0 - power)
    return F.when(x >= 0, up).otherwise(down)


def hash_percent(*cols: Column, seed: int = 0) -> Column:
    """0 .. 99 by an md5 of the columns as text: the same in every engine and partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100
