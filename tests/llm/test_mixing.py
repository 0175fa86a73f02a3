"""Budgets against a plain tree, and rows against SQL."""

from __future__ import annotations

from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from evalboard.llm import queries
from evalboard.llm.mixing import MixPlan, leaf_budgets, mix
from evalboard.llm.queries import mix_sql, tree_plan

from .conftest import SCHEMA, documents

LEVELS = (("domain", "substr(source, 1, 1)"), ("language", "lang"))


def water(budget, children):
    """children: name, weight, cap. Full ones leave, and the rest share anew, until none is full."""
    out, left = {}, {n: (w, c) for n, w, c in children if w > 0}
    while left:
        level = budget / sum(w for w, _ in left.values())
        full = [n for n, (w, c) in left.items() if c <= level * w]
        if not full:
            return out | {n: int(level * w + 1e-9) for n, (w, _) in left.items()}
        for n in full:
            out[n] = left.pop(n)[1]
            budget -= out[n]
    return out


@pytest.mark.parametrize("percent", [10, 60, 150, 300])
def test_budgets(spark, percent):
    leaves = [("a", "en", 1000), ("a", "fr", 10), ("a", "de", 300), ("b", "en", 50), ("b", "fr", 0), ("c", "en", 400)]
    weights = {"domain": {"a": 1, "b": 5, "c": 2}, "language": {"en": 3}}
    plan = MixPlan(LEVELS, weights, budget_percent=percent, epochs=2)
    got = {(r["domain"], r["language"]): r["budget"] for r in leaf_budgets(spark.createDataFrame(leaves, "domain string, language string, tokens long"), plan).collect()}
    total = sum(t for _, _, t in leaves) * percent // 100
    domains = water(total, [(d, weights["domain"][d], 2 * sum(t for x, _, t in leaves if x == d)) for d in "abc"])
    want = {}
    for d, budget in domains.items():
        for lang, b in water(budget, [(x, weights["language"].get(x, 1), 2 * t) for e, x, t in leaves if e == d]).items():
            want[d, lang] = b
    assert all(abs(got[k] - want[k]) <= 1 for k in want) and got.keys() == want.keys()


@pytest.mark.parametrize("percent", [30, 90, 160])
def test_rows_against_sql(spark, percent, tmp_path):
    docs = documents(spark, [None, "", *[f"w{i} " * (i * 37 % 50) for i in range(400)]])
    docs = docs.selectExpr("doc_id", "text", "array('en', 'de', 'fr', null)[doc_id % 4] as lang", "case when doc_id % 9 = 0 then null else concat('src', doc_id % 8) end as source", "n_chars")
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = con.sql(mix_sql(percent) + " select doc_id, domain, language, origin, tokens, epoch from taken").fetchall()
    got = mix(docs, tree_plan(percent)).select("doc_id", "domain", "language", "origin", "tokens", "epoch").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got) and got


def test_weight_nothing_and_same_seed_same_rows(spark):
    docs = documents(spark, ["one two three"] * 90)
    plan = MixPlan((("origin", "source"),), {"origin": {"src0": 0}}, budget_percent=50)
    a, b = (sorted((r["doc_id"], r["epoch"]) for r in mix(d, plan).collect()) for d in (docs, docs.repartition(5)))
    assert a == b and {r["origin"] for r in mix(docs, plan).collect()} == {"src1", "src2"}


def test_supply_below_weight_nothing_is_no_supply(spark, tmp_path):
    """web holds 1000 tokens of a language that weighs nothing, so books get what web cannot use."""
    docs = spark.createDataFrame([(i, "w " * 10, lang, source, 0) for i, (lang, source) in enumerate([("en", "web")] * 100 + [("fr", "web")] * 10 + [("de", "books")] * 100)], SCHEMA)
    levels = (("domain", "source"), ("language", "lang"))
    plan = MixPlan(levels, {"language": {"en": 0}}, budget_percent=50, epochs=1)
    got = {tuple(r)[:2]: r["t"] for r in mix(docs, plan).groupBy("domain", "language").agg(F.sum("tokens").alias("t")).collect()}
    assert got == {("web", "fr"): 100, ("books", "de"): 950}


def test_zero_weights_against_sql(spark, tmp_path, monkeypatch):
    plan = replace(tree_plan(70), weights={"domain": {"web": 4, "books": 3, "code": 0}, "language": {"en": 5, "de": 0, "fr": 2}, "origin": {"src1": 0}})
    monkeypatch.setattr(queries, "tree_plan", lambda percent: plan)
    docs = documents(spark, [f"w{i} " * (i * 37 % 50) for i in range(300)]).selectExpr("doc_id", "text", "array('en', 'de', 'fr', null)[doc_id % 4] as lang", "concat('src', doc_id % 9) as source", "n_chars")
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = con.sql(mix_sql(70) + " select doc_id, domain, language, origin, tokens, epoch from taken").fetchall()
    got = mix(docs, plan).select("doc_id", "domain", "language", "origin", "tokens", "epoch").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got) and got and {r["language"] for r in got} == {"en", "fr", "?"}


def test_clashing_columns(spark):
    names = ["cut", "whole", "_epoch", "epoch", "tokens", "key", "n0", "c0", "rest", "_domain", "domain"]
    docs = documents(spark, ["one two three"] * 30)
    plan = MixPlan(LEVELS)
    want = mix(docs, plan).orderBy("doc_id", "epoch").collect()
    got = mix(docs.select("*", *[F.lit(n).alias(n) for n in names]), plan).orderBy("doc_id", "epoch").collect()
    assert [r[: len(docs.columns)] for r in want] == [r[: len(docs.columns)] for r in got]
    assert [(r["domain"], r["tokens"], r["epoch"], r["cut"], r["n0"]) for r in got] == [(r["domain"], r["tokens"], r["epoch"], "cut", "n0") for r in want] and got


def test_odd_rows(odd, empty):
    plan = MixPlan((("domain", "source"), ("language", "lang")), budget_percent=50)
    assert mix(empty, plan).count() == 0
    rows = mix(odd.withColumnRenamed("n_chars", "tokens"), plan)
    assert rows.columns == ["doc_id", "text", "lang", "source", "domain", "language", "tokens", "epoch"] and rows.count() > 0
