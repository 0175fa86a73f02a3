"""Row numbers of groups of any size.

A window gives a whole group to one task. Here rows are dealt out by ranges of (group, order), so a group of many rows spans many tasks; each task numbers its rows as they lie, rows are counted by (group, task),
and a prefix sum of the counts says where a task's part of a group begins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staged import fixed

#: monotonically_increasing_id() holds the partition above so many bits.
_PLACE_BITS = 33


def dealt(rows: DataFrame, by: Sequence[str], order: Sequence[Column], parts: int) -> DataFrame:
    """rows in ranges of (by, order), each sorted, and `_at`, which grows within a range and from range to range; ties are told apart by their place in the input."""
    keys = [*[F.col(c).asc() for c in by], *order, F.col("_input").asc()]
    sorted_rows = rows.withColumn("_input", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return fixed(sorted_rows.drop("_input").withColumn("_at", F.monotonically_increasing_id()), "dealt")


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """rows and `name`, what row_number() over (partition by `by` order by `order`) gives; rows that are equal in order keep that of the input.

    parts: ranges, by default as many as shuffles have partitions. Null is a group of its own. Rows that tie are dealt out too, so many of them are no burden to one task.
    """
    at = dealt(rows, by, order, parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.shiftright("_at", _PLACE_BITS).alias("_part")
    runs = at.groupBy(part, *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # fewer than tasks and groups together
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each task that has a part of the group
    starts = runs.select(F.col("_part").alias("_own_part"), *[F.col(c).alias(f"_own_{i}") for i, c in enumerate(by)], (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = F.shiftright(F.col("_at"), _PLACE_BITS) == F.col("_own_part")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_own_{i}"))
    out = at.join(starts, same)
    return out.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))
