"""The command line."""

from __future__ import annotations

import json

from helpers import record, write_csv

from evalboard.__main__ import main
from evalboard.sources.board import read_board


def test_check(spark, tmp_path, capsys):
    assert main(["check", write_csv(tmp_path / "a.csv", [record()])]) == 0
    assert main(["check", write_csv(tmp_path / "b.csv", [record(date="x")])]) == 1
    assert "line=2::date" in capsys.readouterr().out


def test_anonymize(spark, tmp_path, capsys):
    site = tmp_path / "site/assets"
    site.mkdir(parents=True)
    (tmp_path / "site/index.html").write_text("<head></head> TODO")
    (site / "config.js").write_text("Acme")
    (site / "config.anon.js").write_text("nobody")
    table = write_csv(tmp_path / "b.csv", [record(organization="Acme labs", submitted_by="x")])
    out = tmp_path / "out"
    assert main(["anonymize", str(tmp_path / "site"), table, str(out), "--term", "acme"]) == 0
    assert "TODO left in index.html" in capsys.readouterr().out
    assert "Anonymous (this paper)" in (out / "leaderboard.csv").read_text() and (out / "assets/config.js").read_text() == "nobody" and not (out / "assets/config.anon.js").exists()
    assert (out / "robots.txt").read_text().startswith("User-agent") and "noindex" in (out / "index.html").read_text()
    table = write_csv(tmp_path / "c.csv", [record(model="Acme-1")])
    assert main(["anonymize", str(tmp_path / "site"), table, str(out), "--term", "acme"]) == 1
    assert "leaderboard.csv:2: 'acme'" in capsys.readouterr().out


def test_build(spark, tmp_path):
    site, out = tmp_path / "site/assets", tmp_path / "out"
    site.mkdir(parents=True)
    (tmp_path / "site/index.html").write_text("<head></head> é\n")
    (site / "config.anon.js").write_text("nobody")
    out.mkdir()
    (out / "old.html").write_text("from another build")
    table = write_csv(tmp_path / "b.csv", [record()])
    assert main(["build", str(tmp_path / "site"), table, str(out)]) == 0
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file() and not p.name.endswith(".crc")) == ["index.html", "leaderboard.csv"]
    assert (out / "leaderboard.csv").read_bytes() == (tmp_path / "b.csv").read_bytes() and (out / "index.html").read_text() == "<head></head> é\n"


def test_score(spark, tmp_path, capsys):
    """Half of the items right, one missing, one repeated: one record that the contract accepts."""
    items = [(f"{task}{i}{variant}", task, variant, "AB"[i % 2]) for task in ("melody", "rhythm", "timbre", "harmony") for i in range(4) for variant in ("clean", "FLIP", "STAY")]
    (tmp_path / "key.csv").write_text("item_id,task,variant,key\n" + "\n".join(",".join(x) for x in items) + "\n")
    answers = [{"item_id": x[0], "answer": "A"} for x in items[1:]] + [{"item_id": items[3][0], "answer": "A"}, {"item_id": "unknown", "answer": "B"}]
    header = {"model": "M9", "version": "1.0", "readout": "logprob", "used_training": False, "date": "2026-10-01", "code_url": "https://c"}
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps(x) for x in [header, *answers]))
    out = str(tmp_path / "row")
    assert main(["score", str(tmp_path / "s.jsonl"), str(tmp_path / "key.csv"), out, "--set", "access=open", "--set", "domain=general"]) == 0
    said = capsys.readouterr().out
    assert "items: 48" in said and "repeated: 1" in said and "unknown: 1" in said
    row = read_board(spark, out).first()
    # Of melody's clean items, the first (key A) is missing and the second (key B) is repeated.
    assert (row["model"], row["method"], row["verified"], row["melody"], row["rhythm"], row["a_rate"]) == ("M9", "zero-shot", "no", "25.0", "50.0", "87.5")
    assert main(["score", str(tmp_path / "s.jsonl"), str(tmp_path / "key.csv"), out]) == 1
    assert "access is open or closed" in capsys.readouterr().out
