"""Spans against a plain Viterbi, and labels of invented languages."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalboard.llm import langid as G

from .conftest import SCHEMA, documents

SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "fr": "eau ou ai tre ment eux que èr é oi".split(), "ru": "ов ст на ен то пр ко".split(), "el": "ος ην αι το κα μα".split()}


def prose(lang, r, n):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) for _ in range(n))


def plain_viterbi(scores, penalty):
    n, k = scores.shape
    v, back = scores[0].astype(float), []
    for t in range(1, n):
        top = int(v.argmax())
        back.append([top if v[top] - penalty > v[j] else j for j in range(k)])
        v = np.maximum(v, v[top] - penalty) + scores[t]
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1], float(v.max())


def worth(scores, path, penalty):
    return float(sum(scores[t, s] for t, s in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:], strict=False)))


@pytest.mark.parametrize("seed", range(6))
def test_paths_are_best(seed):
    r = np.random.default_rng(seed)
    sizes = [1, 2, 3, 7, 8, 9, 40, 300]
    row = np.repeat(np.arange(len(sizes)), sizes)
    scores = -r.integers(0, 12, (len(row), 3)).astype(np.float32)
    got = G.spans(row, scores, 5.0, segment=8)
    for i in range(len(sizes)):
        s = scores[row == i]
        _, best = plain_viterbi(s, 5.0)
        assert worth(s, got[row == i].tolist(), 5.0) == pytest.approx(best)


@pytest.mark.parametrize("languages", [128, 129, 300])
def test_paths_are_best_among_many_languages(languages):
    r = np.random.default_rng(languages)
    row = np.repeat(np.arange(4), [1, 5, 17, 40])
    scores = -r.integers(0, 12, (len(row), languages)).astype(np.float32)
    scores[np.arange(len(row)), languages - 1 - np.arange(len(row)) // 6 % 3] = 6
    got = G.spans(row, scores, 5.0, segment=8)
    assert got.min() >= 0
    for i in range(4):
        s = scores[row == i]
        assert worth(s, got[row == i].tolist(), 5.0) == pytest.approx(plain_viterbi(s, 5.0)[1])


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(1)
    rows = [(i, prose(lang, r, 120), lang, "s", 0) for i, lang in enumerate(list(SYLLABLES) * 40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    return G.train(docs.filter(~G.held_out()))


def test_held_out_rows_and_mixed_texts(spark, model):
    r = random.Random(2)
    assert model.languages == ("el", "en", "fr", "ru")
    texts = [prose(lang, r, 30) for lang in model.languages for _ in range(10)]
    mixed = prose("en", r, 300) + " " + prose("fr", r, 150) + " " + prose("ru", r, 40)
    got = G.identify(documents(spark, [*texts, mixed, None, "", "123 --- !!", "漢字", "— «»"]), model).orderBy("doc_id").collect()
    assert [x["lang_pred"] for x in got[:40]] == [lang for lang in model.languages for _ in range(10)]
    spans = got[40]["lang_spans"]
    assert [s["lang"] for s in spans] == ["en", "fr", "ru"] and got[40]["lang_pred"] == "en" and 0.4 < got[40]["score"] < 0.9
    body = mixed.encode()
    assert abs(spans[1]["first_byte"] - body.index(b" " + mixed[len(" ".join(mixed.split()[:300])) + 1 :].encode()[:12])) < 60
    assert [(x["lang_pred"], x["score"]) for x in got[41:44]] == [("und", 0.0)] * 3 and got[44]["lang_pred"] in model.languages and got[45]["lang_pred"] == "und"


def test_held_out_by_crc(spark):
    docs = documents(spark, [""] * 50)
    assert {x["doc_id"] for x in docs.filter(G.held_out()).collect()} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_sample_is_bounded_and_repeatable(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, prose("en" if i % 2 else "fr", r, 20), "en" if i % 2 else "fr", "s", 0) for i in range(400)], SCHEMA)
    a, b = (G.train(docs.repartition(n), G.LanguageTraining(sample_documents=20)) for n in (1, 7))
    assert np.array_equal(a.trigrams, b.trigrams) and np.array_equal(a.words, b.words)


def test_odd_rows(odd, empty, model):
    extra = odd.withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    assert G.identify(extra, model).count() == odd.count() and G.identify(empty, model).count() == 0
    none = G.train(empty)
    assert none.languages == () and {x["lang_pred"] for x in G.identify(odd, none).collect()} == {"und"}
