"""One ordered file written by many tasks.

Rows are dealt out by ranges of their order and every task writes its range as text; a file's bytes are its parts' bytes, one after the other, so part k belongs at the sum of the lengths before it. Parts are joined
by streams through a buffer; no task and no memory holds the file. The joined file is written beside its place and moved there.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staged import new_path, path_of

BUFFER_BYTES = 1 << 20


@dataclass(frozen=True)
class Part:
    path: str
    offset: int
    length: int


def csv_line(cells: Sequence[Column]) -> Column:
    """Cells as a line: quoted only where a comma, a quote or a line end stands in them, quotes doubled, null empty."""
    quoted = [F.when(c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit(""))) for c in cells]
    return F.concat_ws(",", *quoted)


def ordered_parts(rows: DataFrame, line: Column, order: Sequence[Column], parts: int | None = None) -> tuple[str, list[Part]]:
    """A folder of part files whose lines are in order, and the parts with their places in the whole. order: none keeps the rows' own."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed, keys = rows.withColumns({"_line": line, "_at": F.monotonically_increasing_id()}), [*order, F.col("_at").asc()]
    folder = new_path(spark, "parts")
    keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("_line").write.option("lineSep", "\n").text(folder)
    files, root = path_of(spark, folder)
    found = [(int(m[1]), f.getPath().toString(), f.getLen()) for f in files.listStatus(root) if (m := re.match(r"part-(\d+)", f.getPath().getName()))]
    out, offset = [], 0
    for _, path, length in sorted(found):
        out.append(Part(path, offset, length))
        offset += length
    return folder, out


def join_parts(spark: SparkSession, parts: list[Part], target: str, head: str = "") -> int:
    """head and the parts as one file at target, which is replaced as a whole; its length."""
    files, place = path_of(spark, target)
    _, beside = path_of(spark, f"{target}.joining")
    files.mkdirs(place.getParent())
    out = files.create(beside, True)
    try:
        out.write(bytearray(head.encode()))
        jvm = spark.sparkContext._jvm
        for part in parts:
            if not part.length:
                continue
            store, source = path_of(spark, part.path)
            given = store.open(source)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(given, out, BUFFER_BYTES, False)
            finally:
                given.close()
    finally:
        out.close()
    length = files.getFileStatus(beside).getLen()
    if length != len(head.encode()) + sum(p.length for p in parts):
        raise OSError(f"{target}: parts changed while they were joined")
    files.delete(place, False)
    if not files.rename(beside, place):
        raise OSError(f"cannot move {beside.toString()} to {place.toString()}")
    return length


def write_one_csv(rows: DataFrame, columns: Sequence[str], target: str, order: Sequence[Column] = (), parts: int | None = None) -> int:
    """rows as one CSV file with a header; its length in bytes."""
    folder, found = ordered_parts(rows, csv_line([F.col(c).cast("string") for c in columns]), order, parts)
    files, root = path_of(rows.sparkSession, folder)
    try:
        return join_parts(rows.sparkSession, found, target, ",".join(columns) + "\n")
    finally:
        files.delete(root, True)
