"""Distributed row numbers against windows."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalboard.functions.columns import missing_last
from evalboard.operators.ranking import dealt, numbered


def rows(spark, n, parts=7):
    g = "case when id % 3 = 0 then 'hot' when id % 41 = 0 then null else concat('g', id % 5) end as g"
    return spark.range(n, numPartitions=parts).selectExpr("id", g, "cast(case when id % 13 = 0 then null when id % 17 = 0 then double('nan') else hash(id) % 50 end as double) as score")


def shares(rows):
    """Rows of each range."""
    return [r["n"] for r in rows.groupBy(F.shiftright("_at", 33)).agg(F.count("*").alias("n")).collect()]


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("by", [["g"], [], ["g", "odd"]])
def test_as_row_number(spark, by, ascending):
    given = rows(spark, 5000).withColumn("odd", F.col("id") % 2 == 1)
    order = [*missing_last(F.col("score"), ascending), F.col("id").asc()]
    want = {r["id"]: r["rank"] for r in given.select("id", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("rank")).collect()}
    got = numbered(given, by, order, parts=11)
    assert got.columns == [*given.columns, "rank"]
    assert {r["id"]: r["rank"] for r in got.collect()} == want


def test_ties_keep_input_order_and_are_dealt_out(spark):
    given = spark.range(20_000, numPartitions=5).selectExpr("id", "'one' as g", "1.0D as score")
    got = numbered(given, ["g"], [F.col("score").desc()], parts=8)
    assert [r["rank"] for r in got.orderBy("id").collect()] == list(range(1, 20_001))
    sizes = shares(dealt(given, ["g"], [F.col("score").desc()], 8))
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8


def test_hot_group_of_a_million(spark):
    given = rows(spark, 1_000_000, 4)
    order = [F.col("score").desc_nulls_last(), F.col("id").asc()]
    assert max(shares(dealt(given, ["g"], order, 16))) < 2 * 1_000_000 / 16
    got = numbered(given, ["g"], order, parts=16)
    hot = got.filter("g = 'hot'")
    assert tuple(hot.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()) == (1, 333_334, 333_334)
    steps = hot.withColumn("before", F.lag("score").over(Window.orderBy("rank"))).filter("before < score or before is null and score is not null and rank > 1")
    assert steps.isEmpty()


def test_empty_and_one(spark):
    assert numbered(rows(spark, 0), ["g"], [F.col("id")]).count() == 0
    assert [r["rank"] for r in numbered(rows(spark, 1), ["g"], [F.col("id")]).collect()] == [1]
