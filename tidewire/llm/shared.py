"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; a local folder only where that is unset, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
        top = f"file://{tempfile.gettempdir()}/tidewire-shared"
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """What runs inside sends texts to Python in batches of so many rows, which bounds memory beside the heap; then the setting is as before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df, written once to the shared folder and read back: a lost executor costs no recomputation of what came before."""
    path = folder(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, keys: list[Column], name: str, add_up: tuple[str, ...] = ()) -> DataFrame:
    """df with `pos`, each row's place in the order of keys from 0, and for each column c of add_up `c_before`, its sum over the rows ahead.

    Rows are dealt by ranges of the keys and, among equal keys, of a number of their own; the range's number is written
    with them. Places within a range and the ranges' totals, a row for each partition, add up to places in the whole.
    """
    keys = [*keys, F.col("n_").asc()]
    dealt = df.withColumn("n_", F.monotonically_increasing_id()).repartitionByRange(*keys)
    kept = keep(dealt.withColumn("range_", F.spark_partition_id()), name)
    sums = [F.sum(c).alias(f"{c}_before") for c in add_up]
    totals = kept.groupBy("range_").agg(F.count(F.lit(1)).alias("pos"), *sums)
    ahead = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    names = ["pos", *(f"{c}_before" for c in add_up)]
    totals = totals.select(F.col("range_").alias("r_"), *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}__") for c in names])
    joined = kept.join(F.broadcast(totals), F.col("range_") == F.col("r_"))
    within = Window.partitionBy("range_").orderBy(*keys)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    places = {"pos": F.row_number().over(within) - 1 + F.col("pos__")} | {f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"{c}_before__") for c in add_up}
    return joined.withColumns(places).drop("n_", "range_", "r_", *(f"{c}__" for c in names))


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def clean() -> None:
    """Removes what this driver wrote, while its session still runs."""
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended before
            return
