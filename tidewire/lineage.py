"""Cutting lineage in loops, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a local folder only where that is unset and the master is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
    return folder or f"{tempfile.gettempdir()}/tidewire-checkpoints"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for what a driver writes and reads back; it goes when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@atexit.register
def clean() -> None:
    """Removes what scratch() gave out, while the session still runs."""
    for spark, path in _written:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before
            return


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed at once in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
