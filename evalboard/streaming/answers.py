"""Answers and records as they arrive. The rules and marks are row-wise, so they are the batch operators' own expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import LETTERS
from ..operators.validate import broken_rules, rules


def stream_violations(records: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of R01 to R22 of a stream of raw records; duplicates need all records and are left to the batch check."""
    return broken_rules(records, rules(), keys)


def running_scores(answers: DataFrame, key: DataFrame, on: list[str], by: list[str], time: str, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Right answers and answers for each window of event time; an item's first answer within the delay counts, later ones are dropped.

    This is progress, not the score of operators.scoring: there a repeated answer is wrong and a missing one too, which only a complete submission can tell.
    """
    once = answers.withWatermark(time, delay).dropDuplicatesWithinWatermark(on)
    marked = once.join(key, on).withColumn("correct", F.coalesce((F.col("answer") == F.col("key")) & F.col("answer").isin(*LETTERS), F.lit(False)))
    return marked.groupBy(F.window(time, window), *by).agg(F.count("*").alias("answers"), F.count_if("correct").alias("right"))
