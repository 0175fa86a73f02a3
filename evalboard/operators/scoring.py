"""Item answers to metrics. A missing, invalid or repeated answer counts as wrong; answers to unknown items are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import COLUMNS, PERCENT, TASKS
from ..functions.columns import one_decimal

LETTERS = ("A", "B")


def marked(key: DataFrame, answers: DataFrame, on: list[str] | None = None) -> DataFrame:
    """key (…, key) with answer (null if there is no valid one) and correct; on: the columns that name an item."""
    on = on or ["item_id"]
    once = answers.groupBy(*on).agg(F.when((F.count("*") == 1) & F.max("answer").isin(*LETTERS), F.max("answer")).alias("answer"))
    return key.join(once, on, "left").withColumn("correct", F.coalesce(F.col("answer") == F.col("key"), F.lit(False)))


def answer_report(key: DataFrame, answers: DataFrame, on: list[str] | None = None) -> DataFrame:
    """One row of counts: items, answered, invalid, repeated items, unknown items."""
    on = on or ["item_id"]
    per = answers.groupBy(*on).agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("answer").isin(*LETTERS), F.lit(False))).alias("valid"))
    both = key.select(*on).distinct().withColumn("known", F.lit(True)).join(per, on, "full")
    count = lambda c: F.count_if(c)
    return both.agg(
        count(F.col("known")).alias("items"), count(F.col("known") & (F.col("n") == 1) & F.col("valid")).alias("answered"), count(F.col("known") & (F.col("n") == 1) & ~F.col("valid")).alias("invalid"),
        count(F.col("known") & (F.col("n") > 1)).alias("repeated"), count(F.col("known").isNull()).alias("unknown"),
    )


def share(hit: Column, of: Column) -> Column:
    """Percent of the rows of which hit holds; null where there are none."""
    n = F.count_if(of)
    return F.when(n > 0, F.lit(100.0) * F.count_if(of & hit) / n)


def task_accuracy(rows: DataFrame, by: list[str], tasks: list[str]) -> DataFrame:
    """A column for each task: percent of its clean items answered right."""
    clean = F.col("variant") == "clean"
    return rows.groupBy(*by).agg(*[share(F.col("correct"), clean & (F.col("task") == t)).alias(t) for t in tasks])


def overall(rows: DataFrame, by: list[str]) -> DataFrame:
    """Over items (micro) and over tasks (macro); they agree if tasks have as many items each."""
    per = rows.filter("variant = 'clean'").groupBy(*by, "task").agg(F.count("*").alias("n"), F.count_if("correct").alias("right"))
    return per.groupBy(*by).agg((100.0 * F.sum("right") / F.sum("n")).alias("micro"), F.avg(100.0 * F.col("right") / F.col("n")).alias("macro"))


def error_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """miss_rate (FLIP items answered wrongly), false_flip_rate (STAY items) and acc_fs."""
    wrong = ~F.col("correct")
    rates = rows.groupBy(*by).agg(share(wrong, F.col("variant") == "FLIP").alias("miss_rate"), share(wrong, F.col("variant") == "STAY").alias("false_flip_rate"))
    return rates.withColumn("acc_fs", 100 - (F.col("miss_rate") + F.col("false_flip_rate")) / 2)


def a_rate(rows: DataFrame, by: list[str]) -> DataFrame:
    """Percent of all clean items that were answered A."""
    return rows.groupBy(*by).agg(share(F.col("answer").eqNullSafe("A"), F.col("variant") == "clean").alias("a_rate"))


def scorecard(rows: DataFrame, by: list[str], tasks: list[str]) -> DataFrame:
    """All score columns of the contract in one aggregation."""
    clean, wrong = F.col("variant") == "clean", ~F.col("correct")
    cards = rows.groupBy(*by).agg(
        *[share(F.col("correct"), clean & (F.col("task") == t)).alias(t) for t in tasks], share(F.col("correct"), clean).alias("overall"),
        share(wrong, F.col("variant") == "FLIP").alias("miss_rate"), share(wrong, F.col("variant") == "STAY").alias("false_flip_rate"), share(F.col("answer").eqNullSafe("A"), clean).alias("a_rate"),
    )
    return cards.withColumn("acc_fs", 100 - (F.col("miss_rate") + F.col("false_flip_rate")) / 2)


def constant_answers(key: DataFrame, letter: str, on: list[str] | None = None) -> DataFrame:
    """The submission of one who always answers the letter."""
    return key.select(*(on or ["item_id"])).distinct().withColumn("answer", F.lit(letter))


def paired(rows: DataFrame, base: str = "base_id") -> DataFrame:
    """One row for each base item: whether its clean, FLIP and STAY variants were answered right."""
    return rows.groupBy(base).agg(*[F.bool_or(F.when(F.col("variant") == v, F.col("correct"))).alias(v.lower()) for v in ("clean", "FLIP", "STAY")])


def trained_deltas(board: DataFrame, scores: tuple[str, ...] = ("overall", "acc_fs")) -> DataFrame:
    """Each trained row less its model's zero-shot row. Both notes stand beside the difference, as rows may differ in more than training."""
    zero = board.filter("type = 'model' and lower(method) = 'zero-shot'").select("model", F.col("notes").alias("zero_notes"), *[F.col(s).alias(f"zero_{s}") for s in scores])
    rows = board.filter("type = 'model' and lower(coalesce(method, '')) <> 'zero-shot'")
    return rows.join(zero, "model").select("model", "method", *[(F.col(s) - F.col(f"zero_{s}")).alias(f"delta_{s}") for s in scores], "notes", "zero_notes")


def board_row(header: DataFrame, answers: DataFrame, key: DataFrame, about: dict[str, str] | None = None) -> DataFrame:
    """A submission as one raw record of a result table, scores to one decimal, self-reported until somebody repeats it; several headers are an error.

    header: one row of a submission's header; about: what it does not say (organization, access, domain, params_b, method, notes and so on), by column.
    """
    rows = marked(key, answers)
    scores = scorecard(rows, [], list(TASKS)).select(*[one_decimal(F.round(F.col(c), 1), "").alias(c) for c in PERCENT])
    alone = header.withColumn("_several", F.count("*").over(Window.partitionBy(F.lit(1)))).withColumn("model", F.when(F.col("_several") > 1, F.raise_error(F.lit("a submission has one header"))).otherwise(F.col("model")))
    given = alone.select(
        F.lit("model").alias("type"), "model", "readout", "date", F.coalesce("code_url", F.lit("")).alias("source_url"), F.col("version").alias("benchmark_version"),
        F.when(F.col("used_training"), F.lit("trained")).otherwise(F.lit("zero-shot")).alias("method"), F.lit("no").alias("verified"),
    )
    both = given.crossJoin(scores)  # one row each
    made = {c: F.lit(v) for c, v in (about or {}).items()}
    return both.select(*[made.get(c, F.col(c) if c in both.columns else F.lit("")).cast("string").alias(c) for c in COLUMNS])
