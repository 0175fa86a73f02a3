"""Sets of text files as (path, text)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staged import path_of


def read_documents(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path (below the folder) and text of all files of the tree; bytes that are not UTF-8 become replacement characters."""
    rows = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob).load(folder)
    root = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    below = F.regexp_replace(F.col("path"), r"\A.*?" + _literal(root) + "/", "")
    return rows.select(below.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def _literal(s: str) -> str:
    return "\\Q" + s + "\\E"


def fresh(docs: DataFrame, dropped: tuple[str, ...] = (), swapped: dict[str, str] | None = None) -> DataFrame:
    """The set without some files; swapped: the text of the second path takes the place of the first's."""
    for target, source in (swapped or {}).items():
        moved = docs.filter(F.col("path") == source).select(F.lit(target).alias("path"), "text")
        docs = docs.filter(F.col("path") != target).unionByName(moved)
    return docs.filter(~F.col("path").isin(*dropped)) if dropped else docs


def with_file(docs: DataFrame, path: str, body: str) -> DataFrame:
    """One more file, or another text of it."""
    return docs.filter(F.col("path") != path).unionByName(docs.sparkSession.createDataFrame([(path, body)], "path string, text string"))


def write_documents(docs: DataFrame, target: str) -> None:
    """As a Parquet table of (path, text)."""
    docs.write.mode("overwrite").parquet(target)


def write_tree(docs: DataFrame, folder: str, copies: dict[str, str] | None = None) -> int:
    """Every document as a file at its path below a fresh folder, and copies (path below the folder: file) with the same bytes; how many documents there are.

    Tasks write the files into a folder beside it, which takes the place of the old one when all are there; a build that ends early leaves the old tree as it was.
    """
    spark = docs.sparkSession
    outside = docs.filter(F.startswith("path", F.lit("/")) | F.array_contains(F.split("path", "/"), "..")).limit(1).collect()
    if outside:
        raise ValueError(f"not below the folder: {outside[0]['path']}")
    files, root = path_of(spark, folder)
    _, staged = path_of(spark, f"{folder.rstrip('/')}.staged-{uuid.uuid4().hex}")
    files.mkdirs(staged)
    uri = files.makeQualified(staged).toString()
    uri = uri if "://" in uri else uri.replace(":", "://", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = f"{top}/{path}"
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                beside = f"{place}.{uuid.uuid4().hex}"  # an attempt that is lost leaves no half file at the path
                with store.open_output_stream(beside) as out:
                    out.write((text or "").encode("utf-8"))
                store.move(beside, place)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    try:
        n = docs.select("path", "text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        for path, source in (copies or {}).items():
            copy_file(spark, source, f"{staged.toString()}/{path}")
    except Exception:
        files.delete(staged, True)
        raise
    _, old = path_of(spark, f"{folder.rstrip('/')}.old-{uuid.uuid4().hex}")
    replaced = files.exists(root) and files.rename(root, old)
    if not files.rename(staged, root):
        raise OSError(f"cannot move the new tree to {folder}")
    if replaced:
        files.delete(old, True)
    return n


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    """The same bytes, by the file systems that Spark knows."""
    (store, a), (files, b) = path_of(spark, source), path_of(spark, target)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(store, a, files, b, False, True, spark.sparkContext._jsc.hadoopConfiguration())
