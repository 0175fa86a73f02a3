"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_held: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, if all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evalboard-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def path_of(spark: SparkSession, path: str):  # a Hadoop file system and path
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the driver ends."""
    path = f"{shared_folder(spark)}/evalboard-{name}-{uuid.uuid4().hex}"
    _held[path] = spark
    return path


def fixed(df: DataFrame, name: str = "staged") -> DataFrame:
    """df as a Parquet table: computed once, with its values as they were then, and readable after an executor is lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for path, spark in _held.items():
        try:
            if spark.sparkContext._jsc is not None:
                files, target = path_of(spark, path)
                files.delete(target, True)
        except Exception:  # the JVM may have gone first
            return
