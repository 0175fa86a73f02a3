"""The quality rules against a plain version over strings."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from evalboard.llm.quality import QualityRules, repetition_quality

from .conftest import ODD, PROSE, documents


def plain(text, rules):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = sum(map(len, words))

    def inside(n):
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        many = {i + j for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for j in range(n)}
        met, later = set(), set()
        for i in range(len(words) - n + 1):
            gram = tuple(words[i : i + n])
            later |= {i + j for j in range(n)} if gram in met else set()
            met.add(gram)
        return many, later

    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own:
            dup += line in seen
            dup_chars += sum(map(len, own)) if line in seen else 0
            seen.add(line)
    repeat = len(inside(8)[0])
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    shares = [sum(len(words[i]) for i in inside(n)[1]) / max(chars, 1) for n in sorted(rules.ngram_share)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    kept = not failed and dup_chars / max(chars, 1) <= rules.line_share and all(s <= rules.ngram_share[n] for s, n in zip(shares, sorted(rules.ngram_share), strict=True)) and symbols <= rules.symbols_per_word * len(words)
    return len(words), chars, symbols, dup, repeat, failed, kept, [round(s, 9) for s in shares]


@pytest.mark.parametrize("seed", range(3))
def test_against_plain(spark, seed):
    r = random.Random(seed)
    pool = [w for p in PROSE for w in p.split()] + ["é漢", "**", "a|b"]
    texts = [*ODD]
    for _ in range(60):
        lines = [" ".join(r.choice(pool[: r.randint(3, len(pool))]) for _ in range(r.randint(0, 25))) for _ in range(r.randint(1, 6))]
        texts.append("\n".join(r.choice(lines) for _ in range(r.randint(1, 9))))
    rules = QualityRules()
    got = {x["doc_id"]: x for x in repetition_quality(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"], x["kept"], [round(s, 9) for s in x["dup_ngram_shares"]]) == plain(t, rules)
        assert (x["reason"] is None) == x["kept"]


def test_clean_prose_stays_and_junk_goes(spark):
    texts = [" ".join(PROSE), " ".join(PROSE[:2]) * 4, "\n".join([PROSE[0]] * 3 + list(PROSE)), "win $$ now " + " ".join(PROSE)]
    assert [x["kept"] for x in repetition_quality(documents(spark, texts)).orderBy("doc_id").collect()] == [True, False, False, True]


def test_odd_rows(odd, empty):
    assert repetition_quality(odd).count() == odd.count() and repetition_quality(empty).count() == 0
    two = [x["n_words"] for x in repetition_quality(odd.withColumnRenamed("n_chars", "n_words")).filter("doc_id = 8").collect()]
    assert len(two) == 3 and len(set(two)) == 1
