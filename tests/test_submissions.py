"""Many answer files at once against each alone."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from evalboard.contract import PERCENT, TASKS
from evalboard.operators import submissions as S
from evalboard.operators.scoring import marked, scorecard
from evalboard.sources.submission import read_submission, read_submissions


@pytest.fixture(scope="module")
def key(spark):
    rng = random.Random(1)
    rows = [(str(i), rng.choice(TASKS), rng.choice(["clean", "clean", "FLIP", "STAY"]), rng.choice("AB")) for i in range(120)]
    return spark.createDataFrame(rows, "item_id string, task string, variant string, key string").cache()


def submission(rng, i, items=120):
    lines = [json.dumps({"model": f"m{i}", "version": "1.0", "readout": "logprob", "used_training": i % 2 == 0, "date": "2026-01-01"})]
    for k in range(items):
        if rng.random() < 0.85:
            lines.append(json.dumps({"item_id": str(k), "answer": rng.choice(["A", "B", "B", "C", None])}))
        if rng.random() < 0.05:
            lines.append(json.dumps({"item_id": str(k), "answer": "A"}))
    lines += [json.dumps({"item_id": "unknown", "answer": "A"}), "", "  "]
    rng.shuffle(lines)
    return lines


def test_like_each_alone(spark, tmp_path, key):
    rng = random.Random(2)
    (tmp_path / "deep").mkdir()
    for i in range(6):
        (tmp_path / ("deep" if i % 2 else "") / f"s{i}.jsonl").write_text("\n".join(submission(rng, i)))
    got = {r["file"].rsplit("/", 1)[1]: r for r in S.scores(read_submissions(spark, str(tmp_path)), key).collect()}
    assert len(got) == 6
    for i in range(0, 6, 2):
        _, answers, _ = read_submission(spark, str(tmp_path / f"s{i}.jsonl"))
        want = scorecard(marked(key, answers), [], list(TASKS)).first()
        assert all(got[f"s{i}.jsonl"][c] == pytest.approx(want[c]) for c in PERCENT)


def test_broken_files_are_rows(spark, tmp_path, key):
    rng = random.Random(3)
    good = submission(rng, 1)
    files = {"good": good, "two": [*good, good[[i for i, x in enumerate(good) if "model" in x][0]].replace("m1", "m2")], "none": [x for x in good if "model" not in x], "empty": [""], "junk": ["not json", "{}", "[1]"], "header": [x for x in good if "model" in x]}
    for name, lines in files.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    lines = read_submissions(spark, str(tmp_path))
    facts = S.file_facts(lines)
    told = {}
    for r in S.problems(facts).collect():
        told.setdefault(r["file"].rsplit("/", 1)[1][:-6], set()).add(r["problem"])
    assert told == {"two": {"2 headers"}, "none": {"no header"}, "junk": {"no header", "no answers", "3 lines are neither header nor answer"}, "header": {"no answers"}}
    rows = {r["file"].rsplit("/", 1)[1][:-6]: r for r in S.board_rows(lines, key).collect()}
    assert set(rows) == {"good", "header"} and rows["good"]["model"] == "m1" and rows["good"]["method"] == "zero-shot" and rows["header"]["overall"] == ""


def test_ten_thousand_files(spark, tmp_path, key):
    """Files as rows, read as they would be; one item is in all of them."""
    lines = spark.range(10_000).selectExpr("concat('f', id) as file", "id", "explode(sequence(0, 3)) as k")
    lines = lines.selectExpr(
        "file", "case when k = 0 then 'header' else 'answer' end as kind", "case when k = 0 then concat('m', id) end as model", "'1.0' as version", "'logprob' as readout", "false as used_training", "'2026-01-01' as date", "'' as code_url",
        "case when k > 0 then cast(k as string) end as item_id", "case when k > 0 then if(id % 2 = 0, 'A', 'B') end as answer",
    )
    rows = S.board_rows(lines, key)
    assert rows.count() == 10_000 and rows.select(F.count_distinct("model")).first()[0] == 10_000
    assert rows.groupBy(*PERCENT).count().count() == 2


def test_a_second_header_is_an_error(spark, tmp_path, key):
    from evalboard.operators.scoring import board_row

    lines = [x for x in submission(random.Random(4), 1) if x.strip()]
    (tmp_path / "s.jsonl").write_text("\n".join([*lines, *(x for x in lines if "model" in x)]))
    header, answers, _ = read_submission(spark, str(tmp_path / "s.jsonl"))
    with pytest.raises(Exception, match="one header"):
        board_row(header, answers, key).collect()
    assert board_row(header.limit(1), answers, key.limit(0)).first()["overall"] == ""
