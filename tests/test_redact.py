"""Redaction, rewriting, leak scan and gate."""

from __future__ import annotations

import pytest

from evalboard.operators import redact as R

TERMS = ["Acme", "acme-lab"]


def test_columns(spark):
    schema = "organization string, model_url string, source_url string, submitted_by string, verified string, notes string, model string"
    rows = spark.createDataFrame([("ACME labs", "https://acme-lab.org", "https://x", "bob", "no", "by acme", "Acme-1"), ("Other", "u", None, "bob", "yes", None, "m"), ("Other", "u", "s", "acme", "no", "n", "m")], schema)
    assert [tuple(r) for r in R.redact_board(rows, TERMS).collect()] == [
        ("Anonymous (this paper)", "", "https://x", "bob", "no", "", "Acme-1"),
        ("Other", "u", None, "maintainers", "yes", None, "m"),
        ("Other", "u", "s", "maintainers", "no", "n", "m"),
    ]


PAGE = """<html><head></head><a class="brand" href="x">
 <b>B</b> <span>Acme
board</span></a><a class="btn" href="submit.html">Submit a result</a>
   <a href="submit.html" class="n">Submit</a><section class="block" id="cite">one</section><section class="block" id="cite">two
</section><head><main id="main" class="wrap">old</main>"""


def test_rewrite(spark):
    docs = spark.createDataFrame([("index.html", PAGE), ("a/submit.html", PAGE), ("x.js", PAGE)], "path string, text string")
    steps = R.page_rewrites(r"An$1 \ brand", "<i>cite$</i>", "later")
    got = {r["path"]: r["text"] for r in R.rewrite(docs, steps).collect()}
    page = got["index.html"]
    assert r"<span>An$1 \ brand</span>" in page and "Acme" not in page and page.count("<i>cite$</i>") == 2
    assert "Submit" not in page and page.count('name="robots"') == 1 and page.index("robots") < page.index("brand") and "old" in page
    assert "later" in got["a/submit.html"] and "old" not in got["a/submit.html"] and got["x.js"] == PAGE


def test_leaks_and_gate(spark):
    docs = spark.createDataFrame([("a.html", "ACME acme-lab\nnone\n x acme"), ("b.csv", "TODO clean"), ("c.js", "TODO"), ("d.html", None), ("e.html", "(a+b)")], "path string, text string")
    found = [tuple(r) for r in R.leaks(docs, TERMS).orderBy("path", "line", "term").collect()]
    assert found == [("a.html", 1, "Acme", 2), ("a.html", 1, "acme-lab", 1), ("a.html", 3, "Acme", 1)]
    assert R.leaks(docs, ["a+B"]).count() == 1
    assert [r["path"] for r in R.todo_files(docs).collect()] == ["b.csv"]
    with pytest.raises(R.LeakError, match="a.html:1: 'Acme'"):
        R.gate(R.leaks(docs, TERMS))
    R.gate(R.leaks(docs, ["nobody"]))


def test_gate_lists_every_leak(spark):
    docs = spark.createDataFrame([("a.html", "acme\n" * 150)], "path string, text string")
    with pytest.raises(R.LeakError) as raised:
        R.gate(R.leaks(docs, TERMS))
    assert str(raised.value).split("\n") == [f"a.html:{i}: 'Acme'" for i in range(1, 151)]


def test_build(spark):
    docs = spark.createDataFrame([("index.html", "<head>"), ("assets/config.js", "public"), ("assets/config.anon.js", "anon")], "path string, text string")
    got = {r["path"]: r["text"] for r in R.anonymous_build(docs, R.page_rewrites("b", "c", "m")).collect()}
    assert set(got) == {"index.html", "assets/config.js", "robots.txt"} and got["assets/config.js"] == "anon" and got["robots.txt"] == R.ROBOTS and "noindex" in got["index.html"]
