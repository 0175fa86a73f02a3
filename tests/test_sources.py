"""Readers and writers."""

from __future__ import annotations

import pytest
from helpers import record, write_csv

from evalboard.contract import COLUMNS
from evalboard.sources import board as B
from evalboard.sources.documents import fresh, read_documents, with_file, write_documents
from evalboard.sources.submission import read_submission


def test_round_trip(spark, tmp_path):
    rows = [record(notes='he said "hi", twice\nand left'), record(model="é", notes="")]
    source = write_csv(tmp_path / "a.csv", rows)
    B.write_board(B.read_board(spark, source), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_bytes() == (tmp_path / "a.csv").read_bytes()
    B.copy_board(spark, source, str(tmp_path / "copy.csv"))
    assert (tmp_path / "copy.csv").read_bytes() == (tmp_path / "a.csv").read_bytes()


def test_missing_path_fails(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        B.read_board(spark, str(tmp_path / "none.csv")).collect()


def test_ordinals_over_partitions(spark):
    rows = spark.range(100, numPartitions=7)
    assert [r["line"] for r in B.with_ordinals(rows).orderBy("id").collect()] == list(range(2, 102))


def test_documents(spark, tmp_path):
    (tmp_path / "s/a").mkdir(parents=True)
    (tmp_path / "s/i.html").write_text("<p>é")
    (tmp_path / "s/a/bad.html").write_bytes(b"a\xffb")
    (tmp_path / "s/a/x.js").write_text("1")
    (tmp_path / "s/a/y.js").write_text("2")
    docs = read_documents(spark, str(tmp_path / "s"))
    got = {r["path"]: r["text"] for r in docs.collect()}
    assert got == {"i.html": "<p>é", "a/bad.html": "a�b", "a/x.js": "1", "a/y.js": "2"}
    assert {r["path"] for r in read_documents(spark, str(tmp_path / "s"), "*.html").collect()} == {"i.html", "a/bad.html"}
    made = with_file(fresh(docs, ("a/y.js",), {"a/x.js": "a/y.js"}), "robots.txt", "x")
    write_documents(made, str(tmp_path / "out"))
    got = {r["path"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["a/x.js"] == "2" and "a/y.js" not in got and got["robots.txt"] == "x"


def test_submission(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text('{"model":"m","version":"1.0","readout":"logprob","used_training":false,"date":"2026-01-01"}\n\n{"item_id":"1","answer":"A"}\n{"item_id":"2"}\nnot json\n')
    header, answers, bad = read_submission(spark, str(path))
    assert header.first()["model"] == "m" and header.first()["code_url"] is None
    assert {(r["item_id"], r["answer"]) for r in answers.collect()} == {("1", "A"), ("2", None)}
    assert [r["value"] for r in bad.collect()] == ["not json"]
    assert len(COLUMNS) == 24
