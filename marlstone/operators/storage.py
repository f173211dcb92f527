"""Intermediate tables in the folder that driver and executors share, deleted when the job ends."""

from __future__ import annotations

import atexit
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Used only by sessions of this machine alone that name no folder, as in tests.
LOCAL = "/tmp/checkpoints/marlstone"
_opened: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder in the one that spark.checkpoint.dir names; it goes when Python ends.

    Without that setting executors of other machines could not read what one writes, so a cluster must have it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local-cluster")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = LOCAL
    path = f"{folder.rstrip('/')}/marlstone-{spark.sparkContext.applicationId}"
    if path not in _opened:
        _opened.add(path)
        atexit.register(_delete, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    return path


def _delete(jvm, conf, path: str) -> None:
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except (Py4JError, OSError):  # the JVM ended first
        pass


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application now; no DataFrame that was returned can be read afterwards."""
    path = shared_folder(spark)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df once and read it back, so that a lost executor loses nothing and no plan grows from round to round."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    writer = df.write.mode("error").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
