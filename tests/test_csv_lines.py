"""Split-safe records against the standard library's reader of the whole file."""

from __future__ import annotations

import csv
import sys
import io
import random

import pytest
from helpers import record, write_csv
from pyspark.sql import functions as F

from evalboard.contract import COLUMNS
from evalboard.operators.validate import misshapen, validate
from evalboard.sources.board import read_board
from evalboard.sources.csv_lines import cells, ends_inside, records


@pytest.fixture()
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def random_file(seed, n=120):
    rng = random.Random(seed)
    alphabet = ["a", "é", "漢", " ", ",", '"', "\n", "\r\n", "\n\n", '","', "x" * 90]
    out = ["h1,h2\n"]
    for _ in range(n):
        row = []
        for _ in range(rng.choice([1, 2, 2, 2, 3, 5])):
            body = "".join(rng.choices(alphabet, k=rng.randrange(6)))
            kind = rng.randrange(4)
            if kind == 0:
                row.append('"' + body.replace('"', '""') + '"' + rng.choice(["", "", "tail", 'a"b']))
            else:
                row.append(body.replace(",", "").replace("\n", "").replace("\r", "").lstrip('"') if kind == 1 else rng.choice(["", "plain", 'in"side', "7"]))
        out.append(",".join(row) + rng.choice(["\n", "\n", "\r\n", "\n\n"]))
    return "".join(out)


def plain(text):
    csv.field_size_limit(sys.maxsize)
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


@pytest.mark.parametrize("seed", range(4))
def test_like_the_standard_reader(spark, tmp_path, small_splits, seed):
    text = random_file(seed) + ("last,row" if seed % 2 else '"left open, to\nthe end')
    (tmp_path / "f.csv").write_bytes(text.encode())
    got = records(spark, str(tmp_path / "f.csv")).select("record", "line", cells(F.col("text"), F.col("open")).alias("c"), "open").orderBy("record").collect()
    want = plain(text)
    assert [r["c"] for r in got] == want
    assert [r["record"] for r in got] == list(range(len(want))) and [r["line"] for r in got] == list(range(1, len(want) + 1))
    assert [r["open"] for r in got] == [False] * (len(want) - 1) + [seed % 2 == 0]
    assert spark.read.text(str(tmp_path / "f.csv")).rdd.getNumPartitions() > 20


def test_steps_of_lines(spark):
    lines = ["", "a", '"a', 'a"', '"a"', 'a,"b', '"a""', '"a"",b', '","', '",', 'x","y', '"a"b,"', 'a"b,"c']
    for inside in (False, True):
        got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "t string").select(ends_inside(F.col("t"), inside)).collect()]
        assert got == [ends(x, inside) for x in lines]


def ends(line, inside):
    """One character after the other."""
    begin, i = not inside, 0
    while i < len(line):
        c = line[i]
        if inside:
            if c == '"' and line[i + 1 : i + 2] == '"':
                i += 1
            elif c == '"':
                inside = False
        elif c == '"' and begin:
            inside = True
        begin = not inside and c == ","
        i += 1
    return inside


def test_many_files(spark, tmp_path, small_splits):
    for i in (2, 0, 1):
        write_csv(tmp_path / f"f{i}.csv", [record(model=f"m{i}-{j}", notes='a\n"b", c' if j % 2 else "") for j in range(3 + i)])
    got = read_board(spark, str(tmp_path), files=True).orderBy("line").collect()
    assert [r["line"] for r in got] == list(range(2, 14))
    assert [(r["model"], r["file_line"], r["file"][-6:]) for r in got] == [(f"m{i}-{j}", j + 2, f"f{i}.csv") for i in range(3) for j in range(3 + i)]
    assert {r["notes"] for r in got} == {None, 'a\n"b", c'}
    assert validate(spark, str(tmp_path)).count() == 0
    (tmp_path / "f9.csv").write_text("type,model\nx,y\n")
    bad = validate(spark, str(tmp_path)).collect()
    assert [r["rule"] for r in bad] == ["R00"] and "f9.csv" in bad[0]["message"]


def test_short_and_long_records(spark, tmp_path):
    path = write_csv(tmp_path / "b.csv", [record(model="a"), record(model="b")])
    with open(path, "a") as f:
        f.write("model,c,d\n" + ",".join(record(model="e")[c] for c in COLUMNS) + ",more\n")
    rows = read_board(spark, path, bad=True)
    assert [r["_bad"] for r in rows.orderBy("line").collect()][:2] == [None, None]
    told = {r["line"]: r["message"] for r in misshapen(rows).collect()}
    assert set(told) == {4, 5} and "model,c,d" in told[4] and told[5].endswith(",more")
    assert {r["line"] for r in validate(spark, path).collect()} == {4}


def test_long_line_and_empty_file(spark, tmp_path):
    long = '"' + 'x""y,\n' * 50_000 + '",' + "z" * 300_000
    (tmp_path / "l.csv").write_text("a,b\n" + long + "\n1,2\n")
    got = records(spark, str(tmp_path / "l.csv")).select("line", cells(F.col("text"), F.col("open")).alias("c")).orderBy("line").collect()
    assert [r["c"] for r in got] == plain("a,b\n" + long + "\n1,2\n")
    (tmp_path / "e.csv").write_text("")
    assert records(spark, str(tmp_path / "e.csv")).count() == 0
