"""Session helpers that every operator shares."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; one of our own only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="siltworks-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Written(NamedTuple):
    """Rows in a folder of their own, and what deletes it once they are no longer needed."""

    rows: DataFrame
    drop: Callable[[], None]


def written(df: DataFrame, **options: str) -> Written:
    """df, computed once and written to the shared folder as Parquet; unlike settle(), its files go when the caller says so. Options are those of the writer."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return Written(spark.read.schema(df.schema).parquet(folder), lambda: files.delete(path, True))


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the exchanged and settled rows of tables that nothing refers to any more; else they stay until the driver needs memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """tidy(), the last query's rows included: Spark's queues of events hold on to a query until another one, here one without an exchange, has ended."""
    spark.range(1).write.format("noop").mode("append").save()
    tidy(spark)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_rows(spark: SparkSession, rows: int = 256) -> None:
    """Small Arrow batches, so that very long texts do not meet in one batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
