"""Collocations against plain counts of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalboard.llm import collocations as C
from evalboard.llm.kernels import chunks

SCHEMA = "doc_id long, text string, lang string, phrase string, n int"


def pieces(text):
    low = (text or "").encode().lower()
    return [re.findall(rb"[^\x20\x09]+", p) for p in re.split(rb"[.,;:!?\x0A-\x0D]", low)]


def plain(docs, plan):
    f, n = Counter(), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, plan.longest + 1) for i in range(len(w) - k + 1))
    kept = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= plan.least}
    outer = {}
    for (lang, p), a in kept.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p):
                    outer[lang, p[i:j]] = max(outer.get((lang, p[i:j]), 0), a)
    rows = {}
    for (lang, p), a in kept.items():
        if 100 * outer.get((lang, p), -1) >= plan.contained * a:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))  # noqa: E741
        rows.setdefault(lang, []).append((-score, -a, b" ".join(p), a, l, r, n[lang], score))
    out = []
    for lang, found in rows.items():
        out += [(lang, i + 1, x[2].decode(), *x[3:]) for i, x in enumerate(sorted(found)[: plan.first])]
    return sorted(out)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "of", "The", "new", "york", "É", "é", "漢字", "a-b", "x\x0by", "(q)", "\x00z", "😀", "isn't"] + [f"w{i}" for i in range(20)]
    phrases = ["new york stock exchange", "of the", "a-b É 漢字", "w1 w2 w3 w4 w5 w6 w7"]
    docs = []
    for i in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(60))]
        docs.append((i % 7, "".join(p + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " ? "]) for p in parts), rng.choice(["en", "en", "de", None, "und", ""])))
    return docs + [(0, None, "en"), (None, "", None), (1, " . , ", "xx"), (2, "the the the the the the", "rep")]


def table(spark, docs, parts=3):
    return spark.createDataFrame([(*d, "p", 1) for d in docs], SCHEMA).repartition(parts)


@pytest.mark.parametrize("plan", [C.Collocations(least=5, first=40), C.Collocations(longest=3, least=2, contained=60, first=1000), C.Collocations(least=300)])
def test_like_plain(spark, plan):
    docs = corpus(plan.least)
    got = sorted(tuple(r) for r in C.collocations(table(spark, docs), plan).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain(docs, plan)


def test_shards_small_sketch_and_flushes(spark, monkeypatch):
    docs, plan = corpus(1), C.Collocations(least=4, shard_chars=400)
    monkeypatch.setattr(C, "BYTES_PER_CELL", 1 << 30)
    got = sorted(tuple(r) for r in C.collocations(table(spark, docs), replace(plan, sketched=(1, 2))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain(docs, plan)


def test_sketch_never_misses():
    rng = np.random.default_rng(1)
    cells = np.sort(rng.choice(1 << 18, 5000, replace=False)).astype(np.uint32)
    counts = rng.integers(1, 300, 5000)
    rows = [r for b in C.blocks(cells, counts, 100) for r in b.to_pylist()]
    back = {(r["block"] << 16) + int(c): int(n) for r in rows for c, n in zip(np.frombuffer(r["cells"], np.uint16), np.frombuffer(r["counts"], np.uint8), strict=True)}
    assert back == {int(c): min(int(n), 100) for c, n in zip(cells, counts, strict=True)}


def test_guards():
    c = next(iter(chunks(pa.array(["A  b\tc. D", None, "e,f", "é"])))).lowered()
    first, last, _, piece = C.words_of(c)
    assert C.guarded(c, first, last, piece) == " a b c \n d \n e \n f \n é "


def test_one_hot_language_and_copies(spark):
    docs = [(i, "to be or not to be that is it " * 3, "en") for i in range(400)] + [(i, f"u{i} v{i}", "en") for i in range(200)] + [(9, "long tail " * 50_000, "en")]
    plan = C.Collocations()
    assert sorted(tuple(r) for r in C.collocations(table(spark, docs, 8), plan).collect()) == plain(docs, plan)


def test_arithmetic_past_64_bits(spark):
    big = 4_000_000_000_000
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", 3), ("en", "a b", 3), ("en", "c", 7), ("en", "c a", 5), ("en", "c a b", 3)], "lang string, phrase string, n long")
    totals = spark.createDataFrame([("en", 9 * 10**15)], "lang string, total long")
    got = {r["phrase"]: r["score"] for r in C.scored(counts, totals, C.Collocations(least=1)).collect()}
    n = 9 * 10**15
    assert got == {"c a": 1000 * 5 * n // (7 * big), "c a b": min(1000 * 3 * n // (7 * 3), 1000 * 3 * n // (5 * 3))}


def test_empty_and_odd(spark, odd, empty):
    assert C.collocations(empty).count() == 0
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    plan = C.Collocations(least=2)
    assert sorted(tuple(r) for r in C.collocations(odd, plan).collect()) == plain(docs, plan)
    assert C.collocations(odd.withColumn("text", F.lit(None).cast("string"))).count() == 0


@pytest.mark.parametrize("remembered", [20, 1 << 19])
def test_passes_do_not_grow_with_candidates(spark, monkeypatch, remembered):
    docs, plan, passes = corpus(2), C.Collocations(least=4, shard_chars=400), []
    given = table(spark, docs)
    whole = type(given).mapInArrow
    monkeypatch.setattr(C, "REMEMBERED", remembered, raising=False)
    monkeypatch.setattr(type(given), "mapInArrow", lambda self, *a, **k: passes.append(1) or whole(self, *a, **k))
    got = sorted(tuple(r) for r in C.collocations(given, plan).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain(docs, plan)
    assert len(passes) == 4  # two over the texts, two over cells
