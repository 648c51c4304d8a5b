"""Projects: named snapshots of tables in a folder, with a manifest that is itself a table."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.storage import discard

MANIFEST = "name string, version int, taken timestamp, n_rows long, note string"


@dataclass
class Project:
    """All paths go through Spark's own readers and writers, so the folder can be in any store."""

    spark: SparkSession
    root: str

    def history(self) -> DataFrame:
        """A row for each snapshot; none for a new project."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except Exception as missing:  # the reader's own error, by class name: the folder has no manifest yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def snapshot(self, df: DataFrame, name: str, note: str = "") -> int:
        """Writes a full copy as the next version of ``name``, and returns its number."""
        last = self.history().where(F.col("name") == name).agg(F.max("version").alias("v")).first()["v"]
        version = (last or 0) + 1
        path = f"{self.root}/data/{name}/{version}"
        df.write.parquet(path)
        n = self.spark.read.parquet(path).count()
        row = [(name, version, datetime.now(UTC).replace(tzinfo=None), n, note)]
        self.spark.createDataFrame(row, MANIFEST).write.mode("append").parquet(f"{self.root}/manifest")
        return version

    def restore(self, name: str, version: int | None = None) -> DataFrame:
        """The table of a version, the last by default."""
        if version is None:
            version = self.history().where(F.col("name") == name).agg(F.max("version").alias("v")).first()["v"]
        return self.spark.read.parquet(f"{self.root}/data/{name}/{version}")

    def delete(self, name: str) -> None:
        """Takes all versions of ``name`` out of the manifest, and deletes their files."""
        rest = self.history().where(F.col("name") != name).collect()  # a row a snapshot
        self.spark.createDataFrame(rest, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest")
        discard(self.spark, f"{self.root}/data/{name}")

    def save_state(self, state: dict) -> None:
        """Writes choices (columns, parameters ...) as one line of JSON."""
        line = json.dumps(state, sort_keys=True)
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/state")

    def load_state(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/state").first()["value"])
