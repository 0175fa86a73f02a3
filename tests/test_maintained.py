"""The maintained view against a fresh run after random changes."""

from __future__ import annotations

import random

import pytest

from evalboard.operators.maintained import MaintainedView
from evalboard.operators.view import header_stats, ranked

SCHEMA = "line int, type string, model string, domain string, method string, acc_fs double, date string"


def row(rng, line):
    return (line, rng.choice(["model", "model", "model", "baseline", "other"]), rng.choice([f"m{rng.randrange(9)}", ""]), rng.choice(["general", "music"]), rng.choice(["zero-shot", "GRPO", None]), rng.choice([None, float("nan"), rng.randrange(20) / 2]), rng.choice(["", None, f"2026-01-{rng.randrange(10, 28)}"]))


def as_set(rows):
    return sorted(repr((r["line"], r["group_ord"], r["group_title"], r["rank"], r["model"], r["acc_fs"])) for r in rows)


def test_random_changes(spark, tmp_path):
    rng = random.Random(1)
    held = {i: row(rng, i) for i in range(60)}
    frame = lambda rows: spark.createDataFrame(list(rows), SCHEMA) if rows else None
    view = MaintainedView(spark, str(tmp_path / "view"))
    assert view.rows() is None and tuple(view.header().first()) == (0, "—")
    view.apply(come=frame(held.values()))
    for turn in range(4):
        gone = {i: held.pop(i) for i in rng.sample(sorted(held), 6)}
        edits = {i: row(rng, i) for i in list(gone)[:3]}
        come = edits | {100 * (turn + 1) + k: row(rng, 100 * (turn + 1) + k) for k in range(4)}
        if turn == 3:  # one group alone
            held |= gone
            gone = {i: r for i, r in held.items() if r[1] == "baseline"}
            come = {}
            for i in gone:
                held.pop(i)
        held |= come
        before = {r["part"]: r["held"] for r in view.manifest().filter("kind = 'rows'").collect()}
        done = view.apply(frame(gone.values()), frame(come.values()))
        after = {r["part"]: r["held"] for r in view.manifest().filter("kind = 'rows'").collect()}
        board = frame(held.values())
        assert as_set(view.rows().collect()) == as_set(ranked(board).collect())
        assert tuple(view.header().first()) == tuple(header_stats(board).first())
        untouched = set(before) - set(done.groups)
        assert all(after[g] == before[g] for g in untouched) and not any(f"part={g}/" in f for g in untouched for f in done.read)
        assert all(after[g] == done.version for g in done.groups if g in after)
    assert done.groups == (4,) and 4 not in after
    with pytest.raises(ValueError, match="needs rows"):
        view.apply()
