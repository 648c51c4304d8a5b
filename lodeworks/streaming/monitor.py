"""Alerts over metric samples, the same over a finished table and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alerts(samples: DataFrame, value: str, limit: float = 90.0) -> DataFrame:
    """Samples above the limit."""
    return samples.where(F.col(value) > limit)


def usage(samples: DataFrame, time: str, kind: str, value: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Samples, mean and maximum by kind in windows of ``width``. For a stream give ``late``: windows are closed, and their state
    dropped, once the newest sample is so much newer; samples later than that are left out."""
    stamped = samples.withColumn("_at", F.col(time).cast("timestamp"))
    if late is not None:
        stamped = stamped.withWatermark("_at", late)
    out = stamped.groupBy(F.window("_at", width), kind).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value"))
    return out.select(F.col("window.start").alias("window_start"), kind, "n", "mean_value", "max_value")


def progress(log: DataFrame, task: str, step: str, time: str, n_steps: int) -> DataFrame:
    """(task, n_done, share, newest) from a log of finished steps, a row a step or several; ``n_steps`` is what a task has."""
    seen = log.groupBy(task).agg(F.count_distinct(step).alias("n_done"), F.max(time).alias("newest"))
    return seen.select(task, "n_done", (F.col("n_done") / F.lit(n_steps)).alias("share"), "newest")
