"""Tables of staged work in the folder that the cluster shares: written once, read from there on, so a lost executor costs little."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only local sessions fall back to a temporary folder where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'boardlens-stages')}"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own, which goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, files = _files(spark, path)
    files.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


class Stages:
    """The tables of one job below a folder. A stage that has been written whole is read and not made again, so a job can be taken up where it ended."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.kept = spark, folder is not None
        self.folder = (folder or f"{shared_folder(spark)}/job-{uuid.uuid4().hex}").rstrip("/")

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        done, files = _files(self.spark, f"{path}/_SUCCESS")
        if not files.exists(done):
            make().write.mode("overwrite").parquet(path)
            if not self.kept:
                files.deleteOnExit(done.getParent())
        return self.spark.read.parquet(path)
