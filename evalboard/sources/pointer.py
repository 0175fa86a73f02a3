"""A small file that names a version, replaced by one rename."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from .staged import path_of


def pointed(spark: SparkSession, path: str) -> str | None:
    """What the pointer names, if it is there."""
    files, pointer = path_of(spark, path)
    if not files.exists(pointer):
        return None
    given = files.open(pointer)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(given, "UTF-8").strip()
    finally:
        given.close()


def point(spark: SparkSession, path: str, version: str) -> None:
    jvm = spark.sparkContext._jvm
    files, beside = path_of(spark, f"{path}.{uuid.uuid4().hex}")
    out = files.create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    _, pointer = path_of(spark, path)
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, pointer, options)
