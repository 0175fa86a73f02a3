"""Filters, order, groups and ranks of the table."""

from __future__ import annotations

import pytest
from helpers import record, write_csv
from pyspark.sql import functions as F

from evalboard.operators import render
from evalboard.operators.view import ViewParams, board_view, chance_level, degenerate, header_stats, ranked, top_ranked
from evalboard.sources.board import read_board, typed

ROWS = [
    record(model="Random Chance", type="baseline", method="—", access="—", overall="51.0", acc_fs="90.0", notes="guessing"),
    record(model="b", organization="Ali", acc_fs="50.0", a_rate=""),
    record(model="A", acc_fs="60.0", access="closed"),
    record(model="a", acc_fs="60.0", method="Zero-Shot", verified="no", a_rate="1"),
    record(model="B", acc_fs="10.0", method=""),
    record(model="m & m", acc_fs="70.0", domain="music", method="GRPO", organization="", model_url="https://x?a=1&b=2", notes="n"),
    record(model="odd", type="Other"),
    record(model="B", organization="omni", method="ali baba", acc_fs="20.0", date="2026-12-01"),
]


@pytest.fixture(scope="module")
def board(spark, tmp_path_factory):
    return typed(read_board(spark, write_csv(tmp_path_factory.mktemp("b") / "b.csv", ROWS))).cache()


def lines(df):
    return [r["line"] for r in df.collect()]


def ranks(df):
    return {r["line"]: r["rank"] for r in df.collect()}


def test_default(board):
    assert lines(board_view(board)) == [4, 5, 3, 9, 6, 7, 2]  # an unknown type is in no group
    assert ranks(ranked(board)) == {4: 1, 5: 2, 3: 3, 9: 1, 6: 2, 7: 1, 2: None}


def test_ties_follow_the_display_order_and_rank_follows_filters(board):
    assert ranks(ranked(board, ViewParams(sort="a_rate", ascending=True)))[5] == 1
    assert ranks(ranked(board, ViewParams(access="open")))[5] == 1
    assert 2 in ranks(ranked(board, ViewParams(access="open")))
    assert 5 not in ranks(ranked(board, ViewParams(verified_only=True)))


def test_missing_last_in_both_directions(board):
    for ascending in (True, False):
        assert lines(board_view(board, ViewParams(sort="a_rate", ascending=ascending)).filter("group_ord = 0"))[-1] == 3


def test_search(board):
    assert lines(board_view(board, ViewParams(query="MNI ALI"))) == [9]  # spans two fields
    assert lines(board_view(board, ViewParams(query="%"))) == []
    assert lines(board_view(board, ViewParams(query="chance"))) == [2]


def test_names_by_collation(board):
    assert lines(board_view(board, ViewParams(sort="model", ascending=True)).filter("group_ord = 0")) == [5, 4, 3]


def test_clicks():
    p = ViewParams().clicked("acc_fs")
    assert (p.sort, p.ascending) == ("acc_fs", True)
    assert ViewParams().clicked("miss_rate").ascending and ViewParams().clicked("model").ascending and not ViewParams().clicked("overall").ascending
    with pytest.raises(ValueError):
        p.clicked("date")


def test_header(board, spark):
    r = header_stats(board).first()
    assert (r["models"], r["updated"]) == (5, "2026-12-01")
    assert header_stats(board.limit(0)).first()["updated"] == "—"
    assert chance_level(board).first()[0] == 51.0 and chance_level(board.limit(0)).first()[0] == 50.0


def test_degenerate(board):
    assert lines(degenerate(board)) == []
    assert lines(degenerate(board.withColumn("a_rate", F.when(F.col("line") == 3, 100.0).otherwise(F.col("a_rate"))))) == [3]


def test_cells(board):
    r = {x["line"]: x for x in render.cells(ranked(board)).collect()}
    assert r[7]["name"] == '<a href="https://x?a=1&amp;b=2">m &amp; m</a>' and r[7]["meta"] == "7B" and r[7]["note"] == "n"
    assert r[2]["meta"] == "Reference line" and r[2]["tags"] == [] and r[2]["tooltip"] == "guessing" and r[2]["rank"] == ""
    assert r[5]["tags"] == ["open", "self-reported"] and r[3]["a_rate"] == "—" and r[3]["acc_fs"] == "50.0"
    made = {x["line"]: x["html"] for x in render.table_rows(render.cells(ranked(board), F.lit(51.0))).collect()}
    assert made[2].startswith('<tr class="baseline"><td class="rank"></td><td class="model" title="guessing"><b>') and 'class="tags"' not in made[2] and "guessing</small>" not in made[2]
    assert '<small class="note">n</small>' in made[7] and '<span class="tag self"' in made[5] and all(x.count('<div class="bar">') == 6 and x.count("--chance:51.0%") == 6 and x.count('class="num plain"') == 3 for x in made.values())
    assert "--c:var(--melody);" in made[7] and made[7].count("--c:var(--ink);") == 2 and made[7].count("width:") == 6
    assert "Clear" not in render.empty_row()


def test_whole_table(board):
    from pyspark.sql import Window

    rows = ranked(board)
    shown = render.cells(rows).join(rows.select("line", F.row_number().over(Window.orderBy("group_ord", "rank")).alias("place")), "line")
    made = [r["html"] for r in render.table_html(shown).orderBy("group_ord", "place").collect()]
    assert len(made) == 7 + 4 and "Zero-shot models" in made[0] and ">1</td>" in made[1] and "References" in made[-2]
    assert render.bar_colour("melody") == "var(--melody)" and render.bar_colour("overall") == "var(--ink)"


def test_footer():
    c = render.SiteConfig(title="T", lab="L", repository="https://r", contact="a@b")
    assert c.footer() == 'T v1.0 · L · Table: <a href="https://r/blob/main/leaderboard.csv">leaderboard.csv</a> · <a href="mailto:a@b">a@b</a>'
    assert render.SiteConfig(lab="L", lab_url="https://l", footer_parts=("By {lab_link}", "{mail_link}")).footer() == 'By <a href="https://l">L</a>' and c.link("lab_url") is None


def test_only_the_first_of_each_group_pass_the_shuffle(board):
    plan = top_ranked(board, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_empty_cells_rows_are_dropped_from_views_only(spark, tmp_path):
    path = tmp_path / "b.csv"
    write_csv(path, [record()])
    with path.open("a") as f:
        f.write("," * 23 + "\n")
    raw = read_board(spark, str(path))
    assert raw.count() == 2 and typed(raw).count() == 1


def test_clicks_as_one_after_the_other(spark):
    import random

    from evalboard.contract import SORT_KEYS
    from evalboard.operators.view import clicked_states

    rng = random.Random(1)
    clicks, want = [], {}
    for user in range(60):
        state = ViewParams()
        for n in range(rng.randrange(1, 9)):
            key = rng.choice(["acc_fs", "model", rng.choice(SORT_KEYS)])
            state = state.clicked(key)
            clicks.append((user, n, key))
        want[user] = (state.sort, state.ascending)
    got = clicked_states(spark.createDataFrame(clicks, "user int, n int, key string"), "user", ["n"])
    assert {r["user"]: (r["sort"], r["ascending"]) for r in got.collect()} == want
