"""The entry module, with and without the optional subpackage, and the oracle on the smallest tables."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from evalboard.plans import queries as board

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(board.oracle_sql()))
def test_against_duckdb(spark, name, tmp_path):
    import duckdb

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    want = con.sql(board.oracle_sql()[name])
    board.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    columns = ", ".join(f'"{c}"' for c in sorted(want.columns))
    got = con.sql(f"select {columns} from '{tmp_path}/out/*.parquet'")
    assert [str(t) for t in want.select(columns).types] == [str(t) for t in got.types]
    assert sorted(map(repr, want.select(columns).fetchall())) == sorted(map(repr, got.fetchall()))


def test_nothing_else_imports_the_subpackage():
    code = "import sys; sys.modules['evalboard.llm'] = None; import evalboard.operators.validate, evalboard.operators.view, evalboard.operators.scoring, evalboard.operators.redact, evalboard.operators.notes, evalboard.operators.render, evalboard.plans.queries, evalboard.streaming.answers"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_without_the_subpackage(tmp_path):
    import shutil

    for name in ("evalboard", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / name)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, check=True, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(board.queries())), str(len(board.oracle_sql()))]
