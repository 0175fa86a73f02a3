"""Ordered files by many tasks; versions that are seen whole or not at all."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from evalboard.sources.documents import write_tree
from evalboard.sources.site import Site
from evalboard.sources.sink import ordered_parts, write_one_csv


def test_parts_make_the_file_of_one_task(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice(["", None, "plain", "a,b", 'say "hi"', "two\nlines", " spaced ", "é漢", "cr\rlf"]), str(rng.random())) for i in range(500)]
    table = spark.createDataFrame(rows, "n int, text string, more string").repartition(7)
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerows([("n", "text", "more"), *[(n, t or "", m) for n, t, m in rows]])
    size = write_one_csv(table, ["n", "text", "more"], str(tmp_path / "deep/one.csv"), [F.col("n").asc()], parts=6)
    assert (tmp_path / "deep/one.csv").read_bytes() == out.getvalue().encode() and size == len(out.getvalue().encode())
    write_one_csv(table.limit(0), ["n", "text", "more"], str(tmp_path / "deep/one.csv"))
    assert (tmp_path / "deep/one.csv").read_text() == "n,text,more\n"
    _, parts = ordered_parts(table, F.col("more"), [F.col("n").desc()], parts=6)
    assert len(parts) == 6 and max(p.length for p in parts) < 3 * sum(p.length for p in parts) / 6
    assert [p.offset for p in parts] == [sum(q.length for q in parts[:i]) for i in range(6)]


def pages(spark, changes=None, n=40):
    rows = {f"p/{i}.html": f"<p>page {i}\nof acme" if i == 3 else f"<p>page {i % 30}" for i in range(n)} | (changes or {})
    return spark.createDataFrame([(k, v) for k, v in rows.items() if v != "gone"], "path string, text string")


def seen(site, version=None):
    return {r["path"]: r["text"] for r in site.documents(version).collect()}


def test_versions(spark, tmp_path):
    site = Site(spark, str(tmp_path / "site"))
    assert site.current() is None and seen(site) == {}
    first = site.publish(pages(spark))
    assert (first.pages, first.written, first.scanned) == (40, 31, 0) and site.current() == first.version  # ten pages are copies, but for one
    want = {r["path"]: r["text"] for r in pages(spark).collect()}
    assert seen(site) == want
    second = site.publish(pages(spark, {"p/1.html": "new", "p/2.html": "gone", "empty.html": None}))
    assert (second.pages, second.written) == (40, 2)
    assert seen(site) == {k: v for k, v in want.items() if k != "p/2.html"} | {"p/1.html": "new", "empty.html": ""}
    assert seen(site, first.version) == want
    site.switch(first.version)
    assert seen(site) == want
    with pytest.raises(ValueError, match="no such version"):
        site.switch("none")
    with pytest.raises(ValueError, match="stands twice"):
        site.build(pages(spark).unionByName(pages(spark, n=1)))


def test_a_build_that_dies_leaves_the_old_version(spark, tmp_path):
    site = Site(spark, str(tmp_path / "site"))
    first = site.publish(pages(spark))
    broken = pages(spark, {"p/7.html": "changed"}).withColumn("text", F.when(F.col("path") == "p/9.html", F.raise_error(F.lit("killed"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="killed"):
        site.publish(broken)
    assert site.current() == first.version and seen(site)["p/7.html"] == "<p>page 7"
    built = site.build(pages(spark, {"p/7.html": "changed"}))  # and nobody switched
    assert site.current() == first.version and seen(site)["p/7.html"] == "<p>page 7"
    site.switch(built.version)
    assert seen(site)["p/7.html"] == "changed"


def test_one_changed_page_is_scanned_alone(spark, tmp_path):
    site = Site(spark, str(tmp_path / "site"))
    refused = site.publish(pages(spark), ["ACME", "none"])
    assert site.current() is None and refused.scanned == 31
    assert [tuple(r) for r in refused.leaks.collect()] == [("p/3.html", 2, "ACME", 1)]
    clean = site.publish(pages(spark, {"p/3.html": "clean"}), ["none", "ACME"])
    assert site.current() == clean.version and clean.leaks.isEmpty() and clean.scanned == 1
    many = site.publish(pages(spark, {"p/3.html": "clean", "p/5.html": "one more", "new.html": "clean"}), ["ACME", "none"])
    assert (many.written, many.scanned, many.pages) == (1, 1, 41)
    again = site.publish(pages(spark, {"p/3.html": "back to acme"}), ["ACME", "none"])
    assert site.current() == many.version and again.scanned == 1 and again.leaks.count() == 1
    other = site.build(pages(spark, {"p/3.html": "clean"}), ["page"])
    assert other.scanned == 31 and other.leaks.count() == 39


def test_tree_is_replaced_whole(spark, tmp_path):
    target = tmp_path / "out"
    (tmp_path / "t.csv").write_bytes(b"a\r\n\xff")
    assert write_tree(pages(spark), str(target), {"t.csv": str(tmp_path / "t.csv")}) == 40
    assert (target / "p/3.html").read_text() == "<p>page 3\nof acme" and (target / "t.csv").read_bytes() == b"a\r\n\xff"
    broken = pages(spark).withColumn("text", F.when(F.col("path") == "p/9.html", F.raise_error(F.lit("killed"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="killed"):
        write_tree(broken, str(target))
    assert (target / "p/3.html").read_text() == "<p>page 3\nof acme"
    with pytest.raises(ValueError, match="not below"):
        write_tree(pages(spark, {"a/../../x": "y"}), str(target))
    assert write_tree(pages(spark, {"only": "é"}, n=0), str(target)) == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out", "t.csv"] and [p.name for p in target.rglob("*")] == ["only"] and (target / "only").read_text() == "é"
