"""Any number of answer files scored at once.

Answers of all files are one table. An item's answers in a file are counted, joined with the key and counted for each file, in one aggregation; missing answers are what the key's own totals leave, so no file is joined with the whole key.
An item has an answer in every file, so a join on the item alone would give each item's answers to one task: items are salted, that is, the key is repeated SALT times and an answer goes to one of the repeats by its file.
What is wrong with a file is a row, and never stops the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import COLUMNS, PERCENT, TASKS
from ..functions.columns import one_decimal
from .scoring import LETTERS

SALT = 16
_HEADER = ("model", "version", "readout", "used_training", "date", "code_url")


def file_facts(lines: DataFrame) -> DataFrame:
    """file, headers, answers and others (their numbers), and header, the file's only one (null if it has none or several)."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    header = F.max(F.when(F.col("kind") == "header", F.struct(*_HEADER)))
    facts = lines.groupBy("file").agg(count("header").alias("headers"), count("answer").alias("answers"), count("other").alias("others"), header.alias("header"))
    return facts.withColumn("header", F.when(F.col("headers") == 1, F.col("header")))


def _measures(right: Column, one: Column) -> dict[str, tuple[Column, Column]]:
    """What each score counts and what it counts of, as conditions; wrong ones are found by what is left."""
    clean, said_a = F.col("variant") == "clean", F.col("answer") == "A"
    found = {t: (clean & (F.col("task") == t) & right, clean & (F.col("task") == t)) for t in TASKS}
    found |= {"overall": (clean & right, clean), "miss_rate": ((F.col("variant") == "FLIP") & right, F.col("variant") == "FLIP"), "false_flip_rate": ((F.col("variant") == "STAY") & right, F.col("variant") == "STAY")}
    return found | {"a_rate": (clean & said_a, clean & one)}


def scores(lines: DataFrame, key: DataFrame) -> DataFrame:
    """file and the contract's scores of every file that has answers. key: item_id, task, variant, key. A missing, invalid or repeated answer is wrong, answers to unknown items are ignored."""
    answers = lines.filter("kind = 'answer'").groupBy("file", "item_id").agg(F.count("*").alias("n"), F.max("answer").alias("answer"))
    answers = answers.withColumn("answer", F.when((F.col("n") == 1) & F.col("answer").isin(*LETTERS), F.col("answer"))).withColumn("salt", F.pmod(F.xxhash64("file"), F.lit(SALT)).cast("int"))
    items = key.select(F.col("item_id").cast("string").alias("item_id"), "task", "variant", "key")
    salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    joined = answers.join(salted, ["item_id", "salt"])
    hits = _measures(F.coalesce(F.col("answer") == F.col("key"), F.lit(False)), F.lit(True))
    counted = joined.groupBy("file").agg(*[F.count_if(hit).alias(f"hit_{name}") for name, (hit, _) in hits.items()])
    of = _measures(F.lit(True), F.lit(True))
    totals = items.withColumn("answer", F.lit("A")).agg(*[F.count_if(total).alias(f"of_{name}") for name, (_, total) in of.items()])  # one row
    every = lines.filter("kind = 'answer'").select("file").distinct().join(counted, "file", "left").crossJoin(F.broadcast(totals))
    n = {name: F.coalesce(F.col(f"hit_{name}"), F.lit(0)) for name in hits}
    share = lambda name, c: F.when(F.col(f"of_{name}") > 0, F.lit(100.0) * c / F.col(f"of_{name}")).alias(name)
    wrong = ("miss_rate", "false_flip_rate")
    out = every.select("file", *[share(name, F.col(f"of_{name}") - n[name] if name in wrong else n[name]) for name in hits])
    return out.withColumn("acc_fs", 100 - (F.col("miss_rate") + F.col("false_flip_rate")) / 2)


def problems(facts: DataFrame) -> DataFrame:
    """file and problem of each fault of a file."""
    told = F.array_compact(F.array(
        F.when(F.col("headers") == 0, F.lit("no header")), F.when(F.col("headers") > 1, F.concat(F.col("headers").cast("string"), F.lit(" headers"))),
        F.when(F.col("answers") == 0, F.lit("no answers")), F.when(F.col("others") > 0, F.concat(F.col("others").cast("string"), F.lit(" lines are neither header nor answer"))),
    ))
    return facts.select("file", F.explode(told).alias("problem"))


def board_rows(lines: DataFrame, key: DataFrame) -> DataFrame:
    """file and a raw record of the result table for each file with one header, scores to one decimal, self-reported."""
    facts = file_facts(lines).filter("headers = 1").select("file", "header.*")
    both = facts.join(scores(lines, key), "file", "left")
    made = {
        "type": F.lit("model"), "method": F.when(F.col("used_training"), "trained").otherwise("zero-shot"), "verified": F.lit("no"), "source_url": F.coalesce("code_url", F.lit("")), "benchmark_version": F.col("version"),
        **{c: one_decimal(F.round(F.col(c), 1), "") for c in PERCENT},
    }
    return both.select("file", *[made.get(c, F.col(c) if c in ("model", "readout", "date") else F.lit("")).cast("string").alias(c) for c in COLUMNS])
