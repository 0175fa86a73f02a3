"""Result tables in CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contract import COLUMNS, PERCENT
from ..functions.columns import number, stripped
from .csv_lines import cells, records
from .documents import copy_file
from .sink import write_one_csv
from .staged import path_of

CORRUPT = "_bad"
_CSV = {"quote": '"', "escape": '"', "encoding": "UTF-8"}


def headers(spark: SparkSession, path: str) -> DataFrame:
    """file and header, the first line, of each file."""
    lines = spark.read.options(lineSep="\n", recursiveFileLookup=True).text(path)
    first = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("header"))
    return first.filter("split = 0").groupBy("file").agg(F.min_by("header", "at").alias("header"))


def header_violation(spark: SparkSession, path: str) -> DataFrame:
    """No row, or a violation for each file whose header is not the contract's, in name and order; fails where the path does not exist."""
    found = spark.read.option("recursiveFileLookup", True).text(path)
    message = "the header must be " + ",".join(COLUMNS)
    if len(found.inputFiles()) > 1:
        wrong = headers(spark, path).filter(~array_equal(cells(F.col("header"), F.lit(False)), COLUMNS))
        return wrong.select(F.lit(1).cast("long").alias("line"), F.lit("R00").alias("rule"), F.concat(F.col("file"), F.lit(": "), F.lit(message)).alias("message"))
    first = spark.read.options(lineSep="\n").text(path).limit(1).select(cells(F.col("value"), F.lit(False)).alias("names")).collect()
    rows = [] if first and first[0]["names"] == list(COLUMNS) else [(1, "R00", message)]
    return spark.createDataFrame(rows, "line long, rule string, message string")


def array_equal(c: Column, names: tuple[str, ...]) -> Column:
    return c == F.array(*[F.lit(n) for n in names])


def read_board(spark: SparkSession, path: str, bad: bool = False, files: bool = False) -> DataFrame:
    """All columns as text, null where empty or missing, and `line`, the record's ordinal plus one, over all files in order of their paths.

    A file may be split anywhere; each has a header, which is skipped. bad adds the text of records with too few or too many cells; files adds each record's file and its ordinal there plus one (file_line).
    """
    rows = records(spark, path).filter("record > 0").withColumn("_cells", cells(F.col("text"), F.col("open")))
    named = [F.nullif(F.get("_cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(COLUMNS)]
    more = [F.when(F.size("_cells") != len(COLUMNS), F.col("text")).alias(CORRUPT)] if bad else []
    more += [F.col("file"), (F.col("record") + 1).alias("file_line")] if files else []
    return rows.select(*named, "line", *more)


def with_ordinals(rows: DataFrame, *order: str) -> DataFrame:
    """`line` for rows in many partitions: counts of partitions first, then places within them; order gives the order within a partition."""
    parted = rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    counts = parted.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*(order or ("_at",))))
    return parted.withColumn("_place", place).join(before, "_part").withColumn("line", (F.col("_before") + F.col("_place") + 1).cast("int")).drop("_part", "_at", "_place", "_before")


def typed(raw: DataFrame) -> DataFrame:
    """As a view needs it: records of nothing but empty cells go, text is stripped and never null, numbers are doubles."""
    filled = F.coalesce(*[F.nullif(stripped(F.col(c)), F.lit("")) for c in COLUMNS]).isNotNull()
    return raw.filter(filled).withColumns({c: number(F.col(c)) if c in PERCENT else stripped(F.col(c)) for c in COLUMNS})


def write_board(rows: DataFrame, path: str) -> None:
    """One CSV file (a part file in the folder) in the contract's columns and order: header, minimal quotes, doubled quotes, empty for null; written by many tasks, in order of `line` if there is one."""
    order = [F.col("line").asc()] if "line" in rows.columns else []
    target = f"{path.rstrip('/')}/part-00000.csv"
    files, folder = path_of(rows.sparkSession, path)
    others = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName() != "part-00000.csv"] if files.exists(folder) else []
    write_one_csv(rows, COLUMNS, target, order)
    for other in others:
        files.delete(other, True)


def copy_board(spark: SparkSession, source: str, target: str) -> None:
    """The same bytes, by the file systems that Spark knows."""
    copy_file(spark, source, target)
