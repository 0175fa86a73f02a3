"""Positional index against a plain search of all windows at all places."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from evalboard.llm.postings import contamination

ITEMS = "item_id long, text string"


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def plain(docs, items, width=10, slack=0):
    cut = {}
    for item_id, text in items:
        w = words(text)
        for s in range(max(len(w) - width + 1, 1) if w else 0):
            cut.setdefault(tuple(w[s : s + width]), set()).add("" if item_id is None else str(item_id))
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for window, owners in cut.items():
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s : s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    ids |= owners
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, pos int")
    b = spark.createDataFrame(items, ITEMS)
    rows = contamination(d, b, **more).documents.drop("n_near").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_like_plain(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "é", "漢", "The", "THE"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 5, 9, 10, 11, 30])))) for i in range(30)] + [(3, "w1 w2"), (None, "w3, w4! w5"), (None, None), (7, "")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(40)))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w) + 1)
            parts.append(rng.choice([" ", "... ", "\n"]).join(w[a:]))
        rng.shuffle(parts)
        docs.append((i, " ".join(parts).upper() if i % 3 == 0 else " - ".join(parts)))
    docs += [(0, docs[0][1]), (0, docs[0][1]), (0, "w1 w2"), (None, "w1 w2 w3"), (None, docs[5][1]), (99, None), (98, ""), (97, "...")]
    for width in (1, 3, 10):
        assert found(spark, docs, items, width=width) == plain(docs, items, width)


def test_overlaps_and_borders(spark):
    items = [(1, "a a a a a a a a a a a a"), (2, "b c"), (3, " ".join(f"t{i}" for i in range(10)))]
    docs = [(1, "a " * 25), (2, "c b c b c"), (3, " ".join(f"t{i}" for i in range(10))), (4, " ".join(f"t{i}" for i in range(9))), (5, "x " + " ".join(f"T{i}" for i in range(10)) + " y"), (6, "a " * 9)]
    assert found(spark, docs, items) == plain(docs, items)


def test_long_text_and_hot_passage(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(i, f"head{i} {passage} tail{i}") for i in range(200)] + [(1000, "a b c " * 60_000 + passage)]
    items = [(1, passage), (2, "a b c a b c a b c a b c")]
    assert found(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "word"), (2, "two words")], ITEMS)
    assert contamination(empty, items).documents.count() == 0
    none = contamination(odd, items.limit(0)).documents
    assert none.count() == odd.count() and none.filter("contaminated or n_hit > 0 or n_items > 0").isEmpty()
    some = {r["doc_id"]: r for r in contamination(odd, items).documents.collect()}
    assert some[3]["n_hit"] == 1 and some[4]["n_hit"] == 2 and some[11]["n_words"] == 30_000 and not some[11]["contaminated"]


def near(docs, window, slack):
    """Places of a window's first word from which each word is at most so many places off, as told by the rarest word."""
    lists = {}
    for i, t in docs:
        for p, w in enumerate(words(t)):
            lists.setdefault(w, {}).setdefault(i, set()).add(p)
    sizes = [sum(map(len, lists.get(w, {}).values())) for w in window]
    if 0 in sizes:
        return set()
    anchor = min(range(len(window)), key=lambda k: (sizes[k], k))
    out = set()
    for i, places in lists[window[anchor]].items():
        for s in (p - anchor for p in places):
            if all(any(s + k + d in lists[w].get(i, ()) for d in range(-slack, slack + 1)) for k, w in enumerate(window) if k != anchor):
                out.add((i, s))
    return out


@pytest.mark.parametrize("slack", [0, 1, 2])
def test_proximity(spark, slack):
    rng = random.Random(slack)
    item = "one two three four five six"
    docs = [(1, item), (2, "one two very three four five six"), (3, "one two four three five six"), (4, "one two three four five"), (5, "six five four three two one"), (6, "zero two three four five six one")]
    docs += [(10 + i, " ".join(rng.choices(item.split(), k=30))) for i in range(30)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    result = contamination(d, spark.createDataFrame([(1, item)], ITEMS), width=6, slack=slack)
    got = {(r["doc"], r["start"]) for r in result.matches.collect()}
    assert got == near(docs, words(item), slack)
    assert {(r["doc"], r["start"]) for r in result.matches.filter("exact").collect()} == near(docs, words(item), 0)
    exact = {r["doc_id"] for r in result.documents.filter("contaminated").collect()}
    assert exact == {i for i, _ in near(docs, words(item), 0)}
    flagged = {r["doc_id"] for r in result.documents.filter("n_near > 0").collect()}
    assert exact <= flagged and 1 in flagged and (2 in flagged) == (slack > 0) and (3 in flagged or slack < 2) and 4 not in flagged
