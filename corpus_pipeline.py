"""Cleans a corpus in stages; each stage calls one operator of lodeworks.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; its result is written and read again before the
next one. All but the last return the columns of ``docs``, whatever these are besides doc_id and text. Null and empty
texts are scored like others, and go with the language stage at the latest, as they have no language. Rows are kept or
dropped for themselves, not by their id: repeated rows and ids, and null ids, are fine. An empty table passes through.

The first four stages send whole rows to the workers, and for that set spark.sql.execution.arrow.maxRecordsPerBatch of the
session, which has to hold until their results have been written; ``run`` puts back what was there before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeworks.llm import bpe, decontaminate, langid, near_duplicates, quality
from lodeworks.llm.common import written


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Whole documents travel to the workers with all their columns; fewer at a time than Spark's 10,000 keep buffers small."""
    spark.conf.set(BATCH, "1000")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score 0.3 or more."""
    _small_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told."""
    _small_batches(spark)
    return langid.keep_identified(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of a similarity of 0.8 or more over five-word shingles."""
    _small_batches(spark)
    return near_duplicates.keep_one_of_each(docs, num=80, den=100)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item."""
    _small_batches(spark)
    return decontaminate.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and a hash of the text that they decode to."""
    return bpe.bpe_encode_decode(docs, bpe.tokenizer_spec(), ("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near duplicates", one_of_near_duplicates),
    ("decontamination", uncontaminated),
    ("tokens", token_ids),
]
#: Trained models decide what stays in the first two stages; the tests hold each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(BATCH)
    try:
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    finally:
        spark.conf.set(BATCH, before)
    return STAGES[-1][1](spark, docs, sf_dir)
