"""Records of CSV files that are split anywhere.

Spark reads files as lines, whatever split they lie in. A line either begins outside or inside of quotes, and which of both is known only from all lines before it. So each line is scanned under both assumptions: it is a
step from (outside, inside) to the states after it, one of four: it ends outside, or inside, whatever came before; it keeps the state; it turns it round. Steps are chained within a split by running sums
(the last fixed end, and the turns since), splits are chained in the same way over one row for each, and then every line knows its state. Lines that begin outside begin records.

A record of one line is cut into cells where it lies; those of more lines are put together first. Ordinals are counts of records in lower files, lower splits and lower lines.

Cells follow the usual rules: a quote at a cell's start opens it, two quotes inside are one, text behind the closing quote is kept as it is, a quote elsewhere is a character. CR at a record's end goes, blank lines are no records;
a file that ends inside quotes ends its last record there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Possessive, so that a line of any length is scanned once and without recursion.
_INSIDE = r'(?:[^"]++|"")*+'
_CELL = rf'(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|)'
_OPEN = rf'(?:{_CELL},)*+"{_INSIDE}'
_SPLIT = ["file", "split"]


def ends_inside(line: Column, inside: bool) -> Column:
    """Whether a line that begins outside, or inside, of quotes ends inside."""
    if not inside:
        return line.rlike(rf"(?s)\A{_OPEN}\z")
    return line.rlike(rf'(?s)\A(?:{_INSIDE}|{_INSIDE}"[^,]*+,{_OPEN})\z')


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split (its first byte), at (grows within a split), text, and the step of each line: the states (1 is inside) after it, from_out and from_in."""
    lines = spark.read.options(lineSep="\n", recursiveFileLookup=True).text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    return rows.withColumns({"from_out": ends_inside(F.col("text"), False).cast("int"), "from_in": ends_inside(F.col("text"), True).cast("int")})


def chained(steps: DataFrame, by: list[str], order: str) -> DataFrame:
    """Steps with what before() and after() need: `_turns` in the steps before, and `_fixed`, the last fixed end before, less the turns up to it."""
    upto = Window.partitionBy(*by).orderBy(order)
    turn = F.when(F.col("from_out") > F.col("from_in"), 1).otherwise(0)
    fixed = F.when(F.col("from_out") == F.col("from_in"), (F.col("from_out") + F.col("_upto")) % 2)
    rows = steps.withColumn("_upto", F.sum(turn).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.withColumn("_turns", F.col("_upto") - turn).drop("_upto")


def before(start: Column) -> Column:
    """The state before a step, from the one before the first."""
    return ((F.coalesce(F.col("_fixed"), start) + F.col("_turns")) % 2).cast("int")


def after(start: Column) -> Column:
    return F.when(before(start) == 1, F.col("from_in")).otherwise(F.col("from_out"))


def _stated(spark: SparkSession, path: str) -> DataFrame:
    """file, split, at, text, inside and ends (the states before and after) of each line."""
    within = chained(physical_lines(spark, path), _SPLIT, "at")
    splits = within.groupBy(*_SPLIT).agg(F.max_by(after(F.lit(0)), "at").alias("from_out"), F.max_by(after(F.lit(1)), "at").alias("from_in"))  # a row for each split
    begun = chained(splits, ["file"], "split").select(*_SPLIT, before(F.lit(0)).alias("start"))
    return within.join(begun, _SPLIT).select(*_SPLIT, "at", "text", before(F.col("start")).alias("inside"), after(F.col("start")).alias("ends"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, record (its ordinal in its file, the header is 0), line (its ordinal among all files by path, headers of later files not counted, the first header is 1), text, and open (the file ends inside its quotes)."""
    lines = _stated(spark, path)
    lines = lines.filter((F.col("inside") == 1) | ~F.col("text").isin("", "\r"))
    nth = F.sum(1 - F.col("inside")).over(Window.partitionBy(*_SPLIT).orderBy("at"))
    lines = lines.withColumn("nth", nth)
    counts = lines.groupBy(*_SPLIT).agg(F.max("nth").alias("n"))  # a row for each split
    lower = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = counts.groupBy("file").agg((F.sum("n") - 1).alias("n"))
    above = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))  # a row for each file
    starts = counts.select(*_SPLIT, lower.alias("lower")).join(above, "file")
    placed = lines.join(starts, _SPLIT).withColumn("record", F.col("lower") + F.col("nth") - 1)
    placed = placed.withColumn("line", F.col("above") + F.col("record") + 1)
    one_line = (F.col("inside") == 0) & (F.col("ends") == 0)
    out = ["file", "record", "line", "text", "open"]
    one = placed.filter(one_line).withColumn("open", F.lit(False)).select(*out)
    # The lines of one record meet in one task, no others.
    place = F.struct("split", "at")
    more = placed.filter(~one_line).groupBy("file", "record", "line").agg(F.sort_array(F.collect_list(F.struct("split", "at", "text"))).alias("parts"), (F.max_by("ends", place) == 1).alias("open"))
    return one.unionByName(more.withColumn("text", F.array_join("parts.text", "\n")).select(*out))


def cells(text: Column, open_: Column) -> Column:
    """The cells of a record."""
    closed = F.concat(F.regexp_replace(text, r"\r\z", ""), F.when(open_, F.lit('",')).otherwise(F.lit(",")))
    raw = F.regexp_extract_all(closed, F.lit(rf"(?s)({_CELL}),"), F.lit(1))
    part = lambda c, k: F.regexp_extract(c, rf'(?s)\A"({_INSIDE})"(.*)\z', k)
    return F.transform(raw, lambda c: F.when(F.startswith(c, F.lit('"')), F.concat(F.replace(part(c, 1), F.lit('""'), F.lit('"')), part(c, 2))).otherwise(c))
