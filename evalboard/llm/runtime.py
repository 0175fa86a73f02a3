"""Where intermediate tables live, and how Python workers run."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import inspect
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one takes its place only where everything runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evalboard-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends if not before."""
    path = f"{shared_dir(spark)}/evalboard-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._evalboard_path = path
    return out


def sweep(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of plans that are gone; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle(spark: SparkSession) -> None:
    """Sweeps, then has the executors collect garbage too, after which they give back heap that a heavy step has left: small executors share their memory with Python workers."""
    sweep(spark)
    n = max(2, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc') as done").write.format("noop").mode("overwrite").save()


def free(*tables: DataFrame) -> None:
    """Removes tables made by written() that nothing reads any more."""
    for t in tables:
        path = t._evalboard_path
        if _written.pop(path, None) is not None:
            drop(t.sparkSession, path)


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        try:
            if spark.sparkContext._jsc is not None:
                drop(spark, path)
        except Exception:  # the JVM may have gone first
            return


#: Arrays of a chunk come from one heap that is used again and again (mapping each anew costs as much time as the work); what is free beyond 64 MB goes back to the system.
WORKER_ENV = {"MALLOC_MMAP_THRESHOLD_": "33554432", "MALLOC_TRIM_THRESHOLD_": "67108864", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system", "NUMPY_MADVISE_HUGEPAGE": "0", "OMP_NUM_THREADS": "1"}


def _trim() -> None:
    """Gives free memory back to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A function for Python workers, whose memory goes back to the system when it ends, as workers stay."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def wrapped(*given):
            yield from run(*given)
            _trim()
    else:

        @functools.wraps(run)
        def wrapped(*given):
            out = run(*given)
            _trim()
            return out

    return wrapped


#: Bytes of an Arrow batch; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package from where the driver found it, whatever their working folder is; their batches are bounded by bytes, for the rest of the session."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
