"""Answer files in JSON Lines: a header record, then one record for each item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "model string, version string, readout string, used_training boolean, date string, code_url string"
ANSWER = "item_id string, answer string"


def read_submission(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The header record, the answers, and the lines that are neither (malformed JSON, or no item)."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = lines.select("value", F.from_json("value", f"{HEADER}, {ANSWER}").alias("r"))
    header = parsed.filter("r.item_id is null and r.model is not null").select("r.model", "r.version", "r.readout", "r.used_training", "r.date", "r.code_url")
    answers = parsed.filter("r.item_id is not null").select("r.item_id", "r.answer")
    return header, answers, parsed.filter("r.item_id is null and r.model is null").select("value")


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Every line of every answer file below a path: file, kind (header, answer or other), the header's and the answer's fields, and value, the line. Blank lines are left out; an empty file has no line."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.length(F.trim("value")) > 0)
    parsed = lines.withColumn("r", F.from_json("value", f"{HEADER}, {ANSWER}"))
    kind = F.when(F.col("r.item_id").isNotNull(), "answer").when(F.col("r.model").isNotNull(), "header").otherwise("other")
    return parsed.select("file", kind.alias("kind"), "r.*", "value")
