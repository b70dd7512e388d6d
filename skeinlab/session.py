"""Session defaults and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(app: str = "skeinlab", **conf: str) -> SparkSession:
    """A session with the defaults above; the master comes from the environment or spark-submit."""
    b = SparkSession.builder.appName(app)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only where none is set and all runs in one process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skeinlab-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so loops keep short plans."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_stored: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _stored:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner sweeps it
            return


def scratch(spark: SparkSession) -> str:
    """A new folder among the shared ones, for tables that go together: `store` takes it, `discard` deletes it."""
    path = f"{shared_folder(spark)}/skeinlab-{uuid.uuid4().hex}"
    _stored.append((spark, path))
    return path


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder whose tables nothing reads any more."""
    _delete(spark, folder)
    _stored.remove((spark, folder))


def store(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write to the shared folder and read back. Unlike a checkpoint this also drops what the optimizer has inferred about
    the columns, which grows from round to round in loops that join a frame with itself."""
    path = f"{folder or scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
