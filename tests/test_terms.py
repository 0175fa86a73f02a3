"""Many terms in one pass against one search for each."""

from __future__ import annotations

import random
import re

import pytest

from evalboard.operators import redact as R
from evalboard.operators import terms as T


def plain(docs, terms):
    out = {}
    for name, text in docs:
        for term in {t for t in terms if t}:
            for m in re.finditer(re.escape(term), text or "", re.IGNORECASE):
                at = (name, text.count("\n", 0, m.start()) + 1, term)
                out[at] = out.get(at, 0) + 1
    return sorted((*k, n) for k, n in out.items())


def found(spark, docs, terms):
    rows = T.find_terms(spark.createDataFrame(docs, "path string, text string"), terms).collect()
    return sorted((r["path"], r["line"], r["term"], r["n"]) for r in rows)


def test_folding_is_that_of_a_search_in_any_case():
    table = T.fold_table()
    for i, put in table.items():
        assert re.fullmatch(re.escape(put), chr(i), re.IGNORECASE), hex(i)
    classes = {}
    for i in range(0x1E944):
        classes.setdefault(table.get(i, chr(i)), []).append(chr(i))
    for put, members in classes.items():
        assert len(put) == 1 and all(re.fullmatch(re.escape(a), b, re.IGNORECASE) for a in members for b in members)
    for a, b in (("ſ", "S"), ("K", "K"), ("ς", "Σ"), ("µ", "Μ"), ("ẞ", "ß"), ("é", "É")):
        assert table.get(ord(a), a) == table.get(ord(b), b)
    assert table.get(ord("e"), "e") != table.get(ord("é"), "é")


HARD = ["SUTD", "aa", "aaa", "b\na", "ab", "AB", "a.b", "ΣΑΣ", "strasse", "straße", "k", "", None, "\n"]


def test_like_one_search_each(spark):
    rng = random.Random(5)
    alphabet = ["a", "A", "b", "\n", ".", "ſ", "S", "s", "u", "T", "d", "K", "k", "σ", "ς", "α", "Α", "straße", "STRASSE", "STRAẞE", "İ", "ı", "I", "😀", "aaaa"]
    docs = [(f"d{i}", "".join(rng.choices(alphabet, k=rng.randrange(80)))) for i in range(150)] + [("none", None), ("empty", ""), ("known", "ſUTD of Kelvin\nx sutd"), ("crlf", "b\r\na b\na")]
    terms = [*HARD, *{"".join(rng.choices(alphabet, k=rng.randrange(1, 4))) for _ in range(60)}]
    assert found(spark, docs, terms) == plain(docs, terms)


def test_terms_of_a_table_in_shards(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD_CHARS", 40)
    docs = [("a", "One two THREE\nfour one"), ("b", "twofour")]
    terms = ["one", "two", "three", "four", "five", "twofour", "o", "One"]
    table = spark.createDataFrame([(t,) for t in [*terms, *terms, None, ""]], "word string")
    assert found(spark, docs, table) == plain(docs, terms)
    assert found(spark, docs, table.limit(0)) == [] and found(spark, docs, []) == []


def test_ten_thousand_terms(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(12_000)]
    docs = [(f"d{i}", "\n".join(" ".join(rng.choices(words, k=20)) for _ in range(5))) for i in range(40)]
    terms = sorted(set(words))[:10_000]
    wanted = set(terms)
    plain_words = {}
    for name, text in docs:
        for at, line in enumerate(text.split("\n"), 1):
            for i in range(len(line) - 5):
                if line[i : i + 6] in wanted:
                    plain_words[name, at, line[i : i + 6]] = plain_words.get((name, at, line[i : i + 6]), 0) + 1
    assert found(spark, docs, terms) == sorted((*k, n) for k, n in plain_words.items())


def test_gate_writes_all_and_shows_the_first(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "SHOWN_LEAKS", 3)
    docs = spark.createDataFrame([(f"{i}.html", "ſUTD\nx") for i in range(9)], "path string, text string")
    with pytest.raises(R.LeakError) as raised:
        R.gate(R.leaks(docs, ["SUTD"]), str(tmp_path / "leaks"))
    assert str(raised.value).split("\n")[:3] == [f"{i}.html:1: 'SUTD'" for i in range(3)] and "9 leaks in all" in str(raised.value)
    assert spark.read.parquet(str(tmp_path / "leaks")).count() == 9
    R.gate(R.leaks(docs, ["nobody"]), str(tmp_path / "leaks"))
    assert spark.read.parquet(str(tmp_path / "leaks")).count() == 0
