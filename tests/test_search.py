"""Indexed search against a scan."""

from __future__ import annotations

import random

from evalboard.operators.search import build_index, covering, search
from evalboard.operators.view import ViewParams, shown

QUERIES = ["", "a", "B", "ab", "abc", "aBcd", "org zero", "zero-shot", " ", "  ", "é", "É漢", "😀x", "nothing", "%", "_", "aaaa", "aaaaaaaa", "x y z", "g a", "\n"]


def rows(n=400):
    rng = random.Random(1)
    letters = ["a", "b", "c", "d", "A", "É", "é", "漢", "😀", "x", " ", "y", "z", "%", "\n"]
    word = lambda: None if rng.random() < 0.1 else "".join(rng.choices(letters, k=rng.randrange(8)))
    return [(i, "model", word(), rng.choice(["Org", "", word()]), rng.choice(["zero-shot", "Zero", word()])) for i in range(n)]


def test_like_a_scan(spark, tmp_path):
    given = [*rows(), (1000, "model", "aaaaaaaaaa", "o", "m"), (1001, "model", None, None, None), (1002, "model", "x" * 20_000, "long abcd", "m")]
    table = spark.createDataFrame(given, "line int, type string, model string, organization string, method string").cache()
    path = str(tmp_path / "index")
    build_index(table, "line", ["model", "organization", "method"], path)
    found = {}
    for r in search(spark, path, QUERIES).collect():
        found.setdefault(r["query"], set()).add(r["key"])
    for q in QUERIES:
        want = {r["line"] for r in table.filter(shown(ViewParams(query=q))).collect()}
        assert found.get(q, set()) == want, q
    assert search(spark, path, []).count() == 0


def test_plan_reads_postings_of_few_buckets(spark, tmp_path, capsys):
    table = spark.createDataFrame(rows(50), "line int, type string, model string, organization string, method string")
    path = str(tmp_path / "index")
    build_index(table, "line", ["model", "organization", "method"], path)
    search(spark, path, ["zero-shot"]).explain("formatted")
    plan = capsys.readouterr().out
    places = [x for x in plan.split("\n") if x.startswith("Location")]
    assert places and all(path in x for x in places) and "PartitionFilters: [bucket" in plan and "In(gram" in plan


def test_covering():
    assert covering("ab") == [(0, "ab")] and covering("abc") == [(0, "abc")] and covering("abcd") == [(0, "abc"), (1, "bcd")]
    for n in range(3, 20):
        q = "".join(chr(97 + i) for i in range(n))
        assert {o + k for o, g in covering(q) for k in range(3)} == set(range(n)) and all(q[o : o + 3] == g for o, g in covering(q))


def test_rows_are_read_once_and_long_queries_are_found(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    long = "".join(chr(97 + i * i % 23) for i in range(1000))
    table = spark.createDataFrame([*[(i, f"w{i}") for i in range(50)], (50, long), (51, long[:990] + "A" + long[990:])], "line int, model string")
    path = str(tmp_path / "index")
    build_index(table.mapInArrow(counted, table.schema), "line", ["model"], path)
    assert seen.value == 52
    assert [(r["query"], r["key"]) for r in search(spark, path, [long, long + "z"]).collect()] == [(long, 50)]
