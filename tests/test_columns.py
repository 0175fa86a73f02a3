"""Column functions on their edge values."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from evalboard.functions import columns as X


def value(spark, column, given):
    return spark.createDataFrame([(given,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(("given", "want"), [("50", 50.0), (" 5. ", 5.0), (".5", 0.5), ("-1e2", -100.0), ("+3", 3.0), ("", None), (None, None), ("nan", None), ("inf", None), ("5_0", None), ("50d", None), ("5 0", None), (".", None), ("1e999", float("inf"))])
def test_number(spark, given, want):
    assert value(spark, X.number, given) == want


@pytest.mark.parametrize(("given", "want"), [("0", 0.0), ("100", 100.0), ("100.1", None), ("-0.1", None), ("x", None), ("1e999", None)])
def test_percent(spark, given, want):
    assert value(spark, X.percent, given) == want


@pytest.mark.parametrize(("given", "want"), [("2026-09-30", datetime.date(2026, 9, 30)), ("2026-02-30", None), ("2026-9-3", None), ("20260930", None), ("2026", None), (None, None), ("2026-09-30 ", None)])
def test_date(spark, given, want):
    assert value(spark, X.iso_date, given) == want


@pytest.mark.parametrize(("given", "want"), [("  a\tb \n", "a\tb"), (None, ""), ("\t", "")])
def test_stripped(spark, given, want):
    assert value(spark, X.stripped, given) == want and value(spark, X.blank, given) == (want == "")


def test_text_functions(spark):
    assert value(spark, X.html, "<a href='x'>\"&\"</a>") == "&lt;a href=&#39;x&#39;&gt;&quot;&amp;&quot;&lt;/a&gt;"
    assert [value(spark, lambda c: X.has_term(c, ["AbC", "%"]), v) for v in ("xabcx", "50%", "ab", None)] == [True, True, False, False]
    assert [value(spark, X.trained, v) for v in ("Zero-Shot", "zero-shot ", "", None)] == [False, True, True, True]
    assert [value(spark, lambda c: X.one_decimal(c.cast("double")), v) for v in ("1", "2.5", None, "NaN")] == ["1.0", "2.5", "—", "—"]
    assert X.quoted_replacement("a$1\\") == "a\\$1\\\\"


def test_double_arithmetic_at_the_tolerance(spark):
    assert spark.range(1).select(X.differs(F.lit(50.1), F.lit(50.0), 0.1), X.differs(F.lit(50.05), F.lit(50.0), 0.1), X.combined(F.lit(40.0), F.lit(45.0)), X.mean(F.lit(1.0), F.lit(2.0))).first() == (True, False, 57.5, 1.5)
