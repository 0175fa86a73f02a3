"""Submissions of known score."""

from __future__ import annotations

import pytest

from evalboard.operators import scoring as S

TASKS = ["melody", "rhythm"]


@pytest.fixture(scope="module")
def key(spark):
    rows = []
    for b in range(8):
        k = "AB"[b % 2]
        other = "BA"[b % 2]
        task = TASKS[b // 4]
        rows += [(f"{b}c", b, task, "clean", k), (f"{b}f", b, task, "FLIP", other), (f"{b}s", b, task, "STAY", k)]
    return spark.createDataFrame(rows, "item_id string, base_id int, task string, variant string, key string").cache()


def card(key, answers):
    from pyspark.sql import functions as F

    return S.scorecard(S.marked(key, answers).withColumn("m", F.lit(1)), ["m"], TASKS).first()


def test_perfect_and_inverted(key):
    from pyspark.sql import functions as F

    r = card(key, key.select("item_id", F.col("key").alias("answer")))
    assert (r["overall"], r["acc_fs"], r["melody"], r["a_rate"]) == (100, 100, 100, 50)
    r = card(key, key.select("item_id", F.translate("key", "AB", "BA").alias("answer")))
    assert (r["overall"], r["acc_fs"], r["miss_rate"], r["false_flip_rate"]) == (0, 0, 100, 100)


@pytest.mark.parametrize("letter", S.LETTERS)
def test_constant_answers_score_half(key, letter):
    r = card(key, S.constant_answers(key, letter))
    assert r["acc_fs"] == 50 and r["overall"] == 50 and r["a_rate"] == (100 if letter == "A" else 0)


def test_missing_invalid_repeated_and_unknown(spark, key):
    answers = spark.createDataFrame([("0c", "A"), ("1c", "C"), ("2c", "a"), ("4c", "A"), ("4c", "A"), ("x", "A"), ("6c", None)], "item_id string, answer string")
    rows = {r["item_id"]: r for r in S.marked(key, answers).collect()}
    assert rows["0c"]["correct"] and not any(rows[i]["correct"] for i in ("1c", "2c", "3c", "4c", "6c")) and "x" not in rows
    r = S.answer_report(key, answers).first()
    assert tuple(r) == (24, 1, 3, 1, 1)


def test_micro_macro_rates_and_pairs(key):
    from pyspark.sql import functions as F

    rows = S.marked(key, key.filter("task = 'melody'").select("item_id", F.col("key").alias("answer"))).withColumn("m", F.lit(1))
    r = S.overall(rows, ["m"]).first()
    assert r["micro"] == r["macro"] == 50
    assert tuple(S.error_rates(rows, ["m"]).first())[1:] == (50, 50, 50)
    assert S.task_accuracy(rows, ["m"], TASKS).first()["rhythm"] == 0 and S.a_rate(rows, ["m"]).first()["a_rate"] == 25
    pairs = {p["base_id"]: (p["clean"], p["flip"], p["stay"]) for p in S.paired(rows).collect()}
    assert pairs[0] == (True, True, True) and pairs[7] == (False, False, False)


def test_no_items(key):
    assert S.scorecard(S.marked(key.limit(0), S.constant_answers(key, "A")), ["task"], TASKS).count() == 0


def test_deltas(spark):
    rows = spark.createDataFrame([("model", "m", "zero-shot", 50.0, 51.0, "z"), ("model", "m", "GRPO", 60.0, 50.0, "t"), ("model", "n", "GRPO", 1.0, 1.0, "")], "type string, model string, method string, overall double, acc_fs double, notes string")
    assert [tuple(r) for r in S.trained_deltas(rows).collect()] == [("m", "GRPO", 10.0, -1.0, "t", "z")]


def test_stream(spark, tmp_path):
    from evalboard.streaming.answers import running_scores

    key = spark.createDataFrame([("1", "t", "A"), ("2", "t", "B")], "item_id string, task string, key string")
    spark.sql("select '1' item_id, 'A' answer, timestamp'2026-01-01 01:00:00' ts union all select '1', 'A', timestamp'2026-01-01 01:01:00' union all select '2', 'A', timestamp'2026-01-01 02:00:00'").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("item_id string, answer string, ts timestamp").parquet(str(tmp_path / "in"))
    q = running_scores(stream, key, ["item_id"], ["task"], "ts").writeStream.outputMode("update").format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["answers"], r["right"]) for r in spark.sql("select * from scores").collect()] == [(2, 1)]
