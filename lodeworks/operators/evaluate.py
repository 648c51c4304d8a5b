"""Splits and metrics. Every metric is an aggregate; curves run over distinct scores, in ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.running import running
from lodeworks.functions.scalars import hash_percent


def is_training(keys: Sequence[str], seed: int = 0, percent: int = 80) -> Column:
    """True for about ``percent`` of the keys, by an md5: the same rows in every run, engine and partitioning."""
    return hash_percent(*[F.col(k) for k in keys], seed=seed) < percent


def split(df: DataFrame, keys: Sequence[str], seed: int = 0, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    own = is_training(keys, seed, percent)
    return df.where(own), df.where(~own)


def fold(keys: Sequence[str], n: int, seed: int = 0) -> Column:
    """0 .. n-1, by the same md5; for at most 100 folds."""
    return (hash_percent(*[F.col(k) for k in keys], seed=seed) % n).cast("int")


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """n, mae, mse, rmse, r2 of rows that have both."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    full = df.where(y.isNotNull() & p.isNotNull())
    one = full.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(y - p)).alias("mae"), F.avg((y - p) * (y - p)).alias("mse"), F.var_pop(y).alias("_var"))
    return one.select("n", "mae", "mse", F.sqrt("mse").alias("rmse"), (1 - F.col("mse") / F.nullif(F.col("_var"), F.lit(0.0))).alias("r2"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n, share of the actual class)"""
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("actual")))


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """For each class precision, recall, F1 and support; a ratio without cases is 0. Works on the confusion table."""
    cells = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("class"), F.lit("a").alias("side")), F.struct(F.col("p").alias("class"), F.lit("p").alias("side")))).alias("x")
    long = cells.select("n", (F.col("a") == F.col("p")).alias("hit"), sides).select("n", "hit", "x.*").where(F.col("class").isNotNull())
    per = long.groupBy("class").agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(n) for n, c in (("hits", F.col("hit") & (F.col("side") == "a")), ("support", F.col("side") == "a"), ("called", F.col("side") == "p"))])
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    scored = per.select("class", "support", ratio("hits", "called").alias("precision"), ratio("hits", "support").alias("recall"))
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0)), F.lit(0.0)))


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    full = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return full.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum((1 - F.col(label)).cast("long")).alias("neg"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve: the chance that a row of label 1 scores above one of label 0, ties half. Null without rows of both."""
    per = _by_score(df, label, score)
    ran = running(per, "score", {"below": (F.sum, "neg")})
    one = ran.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.coalesce("below", F.lit(0)) + F.col("neg") / 2)).alias("wins"))
    return one.select("n_pos", "n_neg", (F.col("wins") / F.nullif(F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0))).alias("auc"))


def curves(df: DataFrame, label: str, score: str) -> DataFrame:
    """At each distinct score, taken as the threshold: true and false positives, their rates (ROC), precision and recall."""
    per = _by_score(df, label, score)
    total = per.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    ran = running(per, "score", {"tp": (F.sum, "pos"), "fp": (F.sum, "neg")}, descending=True).join(F.broadcast(total))
    tp, fp = F.coalesce("tp", F.lit(0)) + F.col("pos"), F.coalesce("fp", F.lit(0)) + F.col("neg")
    rate = lambda a, b: a / F.nullif(b, F.lit(0))
    return ran.select(F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"), rate(tp, F.col("n_pos")).alias("tpr"), rate(fp, F.col("n_neg")).alias("fpr"), rate(tp, tp + fp).alias("precision"))
