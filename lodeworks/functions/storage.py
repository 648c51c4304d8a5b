"""Tables that cut lineage: written to the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the folder given to ``setCheckpointDir``. Where neither is set, a local session
    gets a temporary folder of its own, as in tests; on a cluster that is an error, as executors wouldn't see each other's files."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None and sc._jsc.sc().getCheckpointDir().isDefined():
        given = sc._jsc.sc().getCheckpointDir().get()
    if given is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = _own.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="lodeworks-")
        _own[sc.applicationId] = given
    return given.rstrip("/")


def stored(df: DataFrame, name: str) -> str:
    """Writes ``df`` as Parquet under a new name in the shared folder, and returns its path."""
    path = f"{shared_folder(df.sparkSession)}/lodeworks-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own: not computed again, and safe from the loss of the executors that made it. Its size is known
    to the planner, which broadcasts it only below spark.sql.autoBroadcastJoinThreshold and shuffles it otherwise."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
