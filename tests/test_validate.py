"""Every rule by a record that breaks it alone."""

from __future__ import annotations

import random

import pytest
from helpers import record, write_csv
from pyspark.sql import types as T

from evalboard.contract import COLUMNS, RAW
from evalboard.operators.validate import annotations, exit_code, validate, violations

NUMBERED = T.StructType([*RAW.fields, T.StructField("line", T.IntegerType())])

CASES = {
    "type": ({"type": "Model"}, ["R01"]),
    "verified": ({"verified": "maybe"}, ["R02"]),
    "blank model": ({"model": " \t "}, ["R03"]),
    "range": ({"overall": "101"}, ["R08"]),
    "words": ({"melody": "x"}, ["R04"]),
    "nan": ({"melody": "nan"}, ["R04"]),
    "inf": ({"melody": "inf"}, ["R04"]),
    "underscore": ({"melody": "5_0"}, ["R04"]),
    "suffix": ({"melody": "50d"}, ["R04"]),
    "empty": ({"rhythm": ""}, ["R05"]),
    "timbre": ({"timbre": "-1"}, ["R06"]),
    "harmony": ({"harmony": "1e3"}, ["R07"]),
    "acc_fs": ({"acc_fs": "?"}, ["R09"]),
    "miss_rate": ({"miss_rate": ""}, ["R10"]),
    "false_flip_rate": ({"false_flip_rate": "100.5"}, ["R11"]),
    "a_rate empty": ({"a_rate": ""}, []),
    "a_rate low": ({"a_rate": "-1"}, ["R12"]),
    "mean": ({"overall": "58.7"}, ["R13"]),
    "identity": ({"acc_fs": "57.8"}, ["R14"]),
    "double edge": (dict.fromkeys(("melody", "rhythm", "timbre", "harmony"), "50.0") | {"overall": "50.1"}, ["R13"]),
    "access": ({"access": "Open"}, ["R15"]),
    "domain": ({"domain": "speech"}, ["R16"]),
    "readout": ({"readout": "text"}, ["R17"]),
    "method": ({"method": " "}, ["R18"]),
    "7B": ({"params_b": "7B"}, ["R19"]),
    "point": ({"params_b": "7."}, ["R19"]),
    "no digit": ({"params_b": ".5"}, ["R19"]),
    "newline": ({"params_b": "7\n"}, ["R19"]),
    "params empty": ({"params_b": ""}, []),
    "self-reported": ({"verified": "no"}, ["R20"]),
    "self-reported with source": ({"verified": "no", "source_url": "https://x"}, []),
    "short date": ({"date": "2026-9-3"}, ["R21"]),
    "basic date": ({"date": "20260930"}, ["R21"]),
    "no such date": ({"date": "2026-02-30"}, ["R21"]),
    "version": ({"benchmark_version": "2.0"}, ["R22"]),
    "baseline": ({"type": "baseline", "access": "—", "method": "—", "readout": "—", "domain": "—"}, []),
    "two": ({"model": "", "date": "x"}, ["R03", "R21"]),
    "spaces round a number": ({"melody": " 60.0 "}, []),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [tuple(record(**({"model": f"M{i}"} | c))[k] or None for k in COLUMNS) + (i,) for i, (c, _) in enumerate(CASES.values())]
    df = spark.createDataFrame(rows, NUMBERED)
    out: dict[int, list[str]] = {}
    for r in violations(df).orderBy("line", "ord").collect():
        out.setdefault(r["line"], []).append(r["rule"])
    return out


@pytest.mark.parametrize("case", list(CASES))
def test_rule(found, case):
    assert found.get(list(CASES).index(case), []) == CASES[case][1]


def test_file(spark, tmp_path):
    rows = [record(), record(notes='a "b", c\nd'), record(model="m1"), record(), record(date="x", model="M2"), record()]
    found = validate(spark, write_csv(tmp_path / "b.csv", rows))
    assert [(r["line"], r["rule"]) for r in found.collect()] == [(3, "R23"), (5, "R23"), (6, "R21"), (7, "R23")]
    assert exit_code(found) == 1
    assert annotations(found.filter("line = 6"), "b.csv").first()[0].startswith("::error file=b.csv,line=6::date")


def test_header_is_the_only_violation(spark, tmp_path):
    header = (COLUMNS[1], COLUMNS[0], *COLUMNS[2:])
    found = validate(spark, write_csv(tmp_path / "b.csv", [record(type="x")], header)).collect()
    assert [(r["line"], r["rule"]) for r in found] == [(1, "R00")]


def test_valid_file_and_no_records(spark, tmp_path):
    assert exit_code(validate(spark, write_csv(tmp_path / "b.csv", [record()]))) == 0
    assert exit_code(validate(spark, write_csv(tmp_path / "c.csv", []))) == 0


def test_short_and_long_records_do_not_fail(spark, tmp_path):
    from evalboard.sources.board import read_board

    path = tmp_path / "b.csv"
    write_csv(path, [record()])
    with path.open("a") as f:
        f.write("model,Short\n" + ",".join(record(model="Long")[c] for c in COLUMNS) + ",more\n")
    rows = read_board(spark, str(path), bad=True).orderBy("line").collect()
    assert [(r["line"], r["_bad"] is None) for r in rows] == [(2, True), (3, False), (4, False)]
    assert {r["line"] for r in validate(spark, str(path)).collect()} == {3}


def test_order_of_rows_does_not_matter(spark):
    rows = [tuple(record(**c)[k] for k in COLUMNS) + (i,) for i, (c, _) in enumerate(CASES.values())]
    one = violations(spark.createDataFrame(rows, NUMBERED)).collect()
    random.Random(1).shuffle(rows)
    assert sorted(map(str, one)) == sorted(map(str, violations(spark.createDataFrame(rows, NUMBERED)).collect()))


def test_stream(spark, tmp_path):
    from evalboard.streaming.answers import stream_violations

    rows = [tuple(record(date="x")[k] for k in COLUMNS), tuple(record()[k] for k in COLUMNS)]
    spark.createDataFrame(rows, [c for c in COLUMNS]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = stream_violations(stream, ["model"]).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["rule"] for r in spark.sql("select * from found").collect()] == ["R21"]
