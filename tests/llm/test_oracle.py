"""The queries that SQL can express, against DuckDB on the smallest tables: values and types."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from evalboard.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_duckdb(spark, name, tmp_path):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    want = con.sql(queries.oracle_sql()[name])
    queries.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    columns = ", ".join(f'"{c}"' for c in sorted(want.columns))
    got = con.sql(f"select {columns} from '{tmp_path}/out/*.parquet'")
    assert [str(t) for t in want.select(columns).types] == [str(t) for t in got.types]
    assert sorted(map(repr, want.select(columns).fetchall())) == sorted(map(repr, got.fetchall()))
