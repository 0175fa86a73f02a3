"""An answer key, answers and a result table made from the test tables by fixed rules. What comes of them says nothing about any model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import TASKS
from ..operators.scoring import marked, scorecard

#: Task of each language.
LANGUAGES = dict(zip(("en", "de", "fr", "es"), TASKS, strict=True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _task(lang: str = "lang") -> F.Column:
    task = None
    for name, value in LANGUAGES.items():
        task = F.when(F.col(lang) == name, value) if task is None else task.when(F.col(lang) == name, value)
    return task


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, source, task, variant, key and base_id of every labelled document."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    variant = F.when(F.col("toxic") == 1, "FLIP").when(F.col("doc_id") % 2 == 0, "STAY").otherwise("clean")
    key = F.when(F.col("quality") == 1, "A").otherwise("B")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("item_id"), "source", _task().alias("task"), variant.alias("variant"), key.alias("key"), F.floor(F.col("doc_id") / 10).alias("base_id"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id and answer; one document in seven has none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").filter("n_chars % 7 <> 0")
    return docs.select(F.col("doc_id").alias("item_id"), F.when(F.col("n_chars") > 1500, "A").otherwise("B").alias("answer"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(items(spark, sf_dir), answers(spark, sf_dir))


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table with a row for each source."""
    cards = scorecard(scored(spark, sf_dir), ["source"], list(TASKS))
    i = F.substring("source", 4, 9).cast("int")
    return cards.select(
        (i + 2).alias("line"), F.when(i >= 18, "baseline").otherwise("model").alias("type"), F.concat(F.lit("Model "), F.floor(i / 2).cast("string")).alias("model"), F.concat(F.lit("Org <"), (i % 5).cast("string"), F.lit(">")).alias("organization"),
        F.when(i % 3 == 0, F.concat(F.lit("https://example.org/?a=1&m="), i.cast("string"))).otherwise("").alias("model_url"), F.when(i % 3 == 0, "closed").otherwise("open").alias("access"), F.when(i % 4 == 0, "music").otherwise("general").alias("domain"),
        F.when(i % 6 == 0, "").otherwise(i.cast("string")).alias("params_b"), F.when(i % 2 == 0, "zero-shot").otherwise("GRPO (LoRA)").alias("method"), *TASKS, "overall", "acc_fs", "miss_rate", "false_flip_rate", "a_rate",
        F.when(i % 5 == 0, "no").otherwise("yes").alias("verified"), F.lit("").alias("source_url"), F.concat(F.lit("note "), i.cast("string")).alias("notes"), F.lit("2026-01-01").alias("date"),
    )


#: Columns of a raw result table with a record for each customer, as SQL that Spark and DuckDB read alike; `k` is a record's kind, and each kind but the last ones breaks a rule of its own number.
RAW = {
    "type": "case k when 1 then 'Model' when 2 then 'baseline' else 'model' end",
    "model": "case k when 3 then '  ' when 0 then '' when 23 then 'Same' when 24 then 'same' else concat('M', c_custkey) end",
    "organization": "'Org'",
    "model_url": "''",
    "access": "case k when 15 then 'Open' when 2 then '' else 'open' end",
    "domain": "case k when 16 then 'speech' when 2 then '' else 'general' end",
    "params_b": "case k when 19 then '7B' when 25 then '7.' when 26 then '.5' when 27 then '' when 28 then '0.5' else '7' end",
    "method": "case k when 18 then ' ' when 2 then '' else 'zero-shot' end",
    "melody": "case k when 4 then 'x' when 29 then '101' when 30 then '' else '60.0' end",
    "rhythm": "case k when 5 then '-1' else '55.2' end",
    "timbre": "case k when 6 then 'nan' else '66.8' end",
    "harmony": "case k when 7 then 'inf' else '52.0' end",
    "overall": "case k when 8 then '50d' when 13 then '58.7' when 31 then '58.45' else '58.5' end",
    "acc_fs": "case k when 9 then '5_0' when 14 then '57.8' else '57.6' end",
    "miss_rate": "case k when 10 then '1e3' when 32 then '4.01e1' else '40.1' end",
    "false_flip_rate": "case k when 11 then '' else '44.7' end",
    "a_rate": "case k when 12 then '-1' when 33 then '' else '52.0' end",
    "readout": "case k when 17 then 'letters' when 2 then '' else 'logprob' end",
    "verified": "case k when 20 then 'no' when 34 then 'no' when 35 then 'maybe' else 'yes' end",
    "submitted_by": "'me'",
    "date": "case k when 21 then '2026-9-3' when 36 then '2026-02-30' when 37 then '20260930' when 0 then '' else '2026-10-01' end",
    "source_url": "case k when 34 then 'https://s' else '' end",
    "benchmark_version": "case k when 22 then '2.0' else '1.0' end",
    "notes": "''",
}


def raw_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records with faults of every kind, and line."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey % 40 as k")
    return rows.selectExpr("cast(c_custkey + 1 as int) as line", *[f"{e} as {c}" for c, e in RAW.items()])


RAW_SQL = f"raw as (select cast(c_custkey + 1 as int) as line, {', '.join(f'{e} as {c}' for c, e in RAW.items())} from (select c_custkey, c_custkey % 40 as k from customer))"


_TASK_SQL = "case " + " ".join(f"when lang = '{k}' then '{v}'" for k, v in LANGUAGES.items()) + " end"


def _share(hit: str, of: str) -> str:
    return f"case when count(*) filter (where {of}) > 0 then 100.0::double * count(*) filter (where {of} and {hit}) / count(*) filter (where {of}) end"


SCORED_SQL = f"""items as (select l.doc_id as item_id, d.source, {_TASK_SQL} as task, case when toxic = 1 then 'FLIP' when l.doc_id % 2 = 0 then 'STAY' else 'clean' end as variant,
    case when quality = 1 then 'A' else 'B' end as key, l.doc_id // 10 as base_id from labels l join documents d on d.doc_id = l.doc_id),
answers as (select doc_id as item_id, case when n_chars > 1500 then 'A' else 'B' end as answer from documents where n_chars % 7 <> 0),
scored as (select i.*, a.answer, coalesce(a.answer = i.key, false) as correct from items i left join answers a using (item_id))"""

CARDS_SQL = f"""{SCORED_SQL},
cards_0 as (select source, {', '.join(_share('correct', f"variant = 'clean' and task = '{t}'") + f' as {t}' for t in TASKS)}, {_share('correct', "variant = 'clean'")} as overall,
    {_share('not correct', "variant = 'FLIP'")} as miss_rate, {_share('not correct', "variant = 'STAY'")} as false_flip_rate, {_share("coalesce(answer = 'A', false)", "variant = 'clean'")} as a_rate from scored group by source),
cards as (select *, 100 - (miss_rate + false_flip_rate) / 2 as acc_fs from cards_0)"""

BOARD_SQL = f"""{CARDS_SQL},
numbered as (select *, cast(substr(source, 4) as int) as i from cards),
board as (select i + 2 as line, case when i >= 18 then 'baseline' else 'model' end as type, 'Model ' || (i // 2) as model, 'Org <' || (i % 5) || '>' as organization,
    case when i % 3 = 0 then 'https://example.org/?a=1&m=' || i else '' end as model_url, case when i % 3 = 0 then 'closed' else 'open' end as access, case when i % 4 = 0 then 'music' else 'general' end as domain,
    case when i % 6 = 0 then '' else cast(i as varchar) end as params_b, case when i % 2 = 0 then 'zero-shot' else 'GRPO (LoRA)' end as method, {', '.join(TASKS)}, overall, acc_fs, miss_rate, false_flip_rate, a_rate,
    case when i % 5 = 0 then 'no' else 'yes' end as verified, '' as source_url, 'note ' || i as notes, '2026-01-01' as date from numbered)"""
