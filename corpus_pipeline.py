"""A corpus pipeline: language, lines, near-duplicates, mixing, packing. Each stage reads what its predecessor wrote.

Defined cases, for all stages: an empty table gives an empty one; other columns pass through, whatever their names, but those of the mix's tree, `tokens` and `epoch` (none of the documents table);
rows with null text have no letter and go at the first stage; rows with a null id are documents of their own, are never near-duplicates and are packed under a null id; equal rows stay together at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalboard.llm.langid import held_out, identify, train
from evalboard.llm.linededup import dedup_lines
from evalboard.llm.minhash import MinHashPlan, near_duplicates
from evalboard.llm.mixing import mix
from evalboard.llm.packing import pack_documents
from evalboard.llm.queries import LINES, tokenizer, tree_plan
from evalboard.llm.runtime import free, written

#: A document goes if less than this share of its letters is in its main language.
LEAST_LANGUAGE_SHARE = 0.5
#: Share of the tokens that the mix may hold.
BUDGET_PERCENT = 90


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters and those without a main language go."""
    model = train(docs.filter(~held_out()))
    found = identify(docs, model, with_spans=False)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SHARE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier one go; a document left without text goes too."""
    return dedup_lines(docs, LINES).filter(F.length(F.trim("text")) > 0)


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id."""
    gone = written(near_duplicates(docs, MinHashPlan(words=5, percent=80)).filter("not kept").select("doc_id"), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the budgets take, once for each epoch."""
    return mix(docs, tree_plan(BUDGET_PERCENT)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"), end_id=0)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicate_documents), ("mix", source_mix), ("packing", packing)]

#: Viterbi, edit distance, set similarity and a tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that come of the documents table."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        free(*read)  # nothing reads the table before this one any more
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
