"""Joins whose keys may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def spread_join(many: DataFrame, few: DataFrame, keys: Sequence[str], by: Sequence[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Joins ``many`` to ``few`` on ``keys``, a hot key of ``many`` dealt to ``salts`` tasks by its columns ``by``. ``few`` has a row
    a key and is repeated ``salts`` times; what it holds should be narrow. Both sides are exchanged on their own for the
    join, so that adaptive execution can split what is still skewed. Neither is broadcast: Spark takes the repeated rows for as many as
    ``few`` has, and the driver would hold a table ``salts`` times as large as its threshold allows. Inner, left, left_semi and left_anti."""
    left = many.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by]), F.lit(salts)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
