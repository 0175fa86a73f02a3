"""Edit distance, segments and duplicate lines against plain versions."""

from __future__ import annotations

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from evalboard.llm import crosslinks
from evalboard.llm import linededup as L
from evalboard.llm.kernels import chunks
from evalboard.llm.queries import LINES, op2_segment_line_dedup

from .conftest import ODD, PROSE, SCHEMA, documents
from .test_minhash import groups


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, a, n):
    b = bytearray(a)
    for _ in range(n):
        at, kind = r.randint(0, len(b)), r.random()
        if kind < 0.33:
            b.insert(at, r.choice(b"abc"))
        elif b:
            at = min(at, len(b) - 1)
            b[at : at + 1] = b"" if kind < 0.66 else bytes([r.choice(b"abc")])
    return bytes(b)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=40), st.integers(0, 6))
def test_any_pair(a, b, edits):
    assert L.within([a], [b], edits)[0] == (distance(a, b) <= edits)


@pytest.mark.parametrize("edits", [1, 2, 3, 5])
def test_many_pairs(edits):
    r = random.Random(edits)
    left = [bytes(r.choices(b"ab", k=r.randint(0, 40))) for _ in range(1500)]
    right = [edited(r, a, r.randint(0, edits + 2)) for a in left]
    assert L.within(left, right, edits).tolist() == [distance(a, b) <= edits for a, b in zip(left, right, strict=True)]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_probes_meet_a_segment_of_every_line_within_reach(edits):
    r = random.Random(edits)
    for _ in range(1500):
        a = bytes(r.choices(b"abcd", k=r.randint(2 * (edits + 1), 40)))
        a, b = sorted((a, edited(r, a, edits)), key=len)
        if len(a) < 2 * (edits + 1):
            continue
        starts, sizes = L.segments(np.array([len(a)]), edits)
        held = {(i, a[s : s + n]) for i, (s, n) in enumerate(zip(starts[:, 0], sizes[:, 0], strict=True))}
        assert starts[-1, 0] + sizes[-1, 0] == len(a)
        same = len(a) == len(b) and any((i, b[s : s + n]) in held for i, (s, n) in enumerate(zip(starts[:, 0], sizes[:, 0], strict=True)))
        assert same or any((i, b[at[0] : at[0] + n[0]]) in held for i, other, at, n in L.probes(np.array([len(b)]), edits) if at[0] >= 0 and other[0] == len(a))


WORDS = L.LinePlan(words_per_edit=10)


def near(a, b, plan):
    """Whether two lines are alike, by definition."""
    x, y = re.findall(rb"[^\x20\x09-\x0D]+", a), re.findall(rb"[^\x20\x09-\x0D]+", b)
    n = min(len(x), len(y))
    if plan.words_per_edit and n >= plan.min_words:
        return distance(x, y) <= max(1, min(n // plan.words_per_edit, 30))
    return abs(len(a) - len(b)) <= plan.edits and distance(a, b) <= plan.edits


def reworded(r, a, n):
    """n words of a line replaced, dropped, added or split."""
    w = a.split(" ")
    for _ in range(n):
        at, kind = r.randrange(len(w)), r.random()
        w[at : at + 1] = [r.choice(["new", "thing"])] if kind < 0.5 else [] if kind < 0.7 else [w[at], "more"] if kind < 0.9 else [w[at][:1] or "q", w[at][1:] or "z"]
        w = w or ["x"]
    return " ".join(w)


def lines_of(r, n):
    pool = [f"w{i}" for i in range(60)]
    return [" ".join(r.choices(pool, k=r.choice([6, 8, 9, 10, 11, 12, 19, 20, 21, 29, 30, 45, 60]))) for _ in range(n)]


@pytest.mark.parametrize("plan", [L.LinePlan(), WORDS])
def test_bitmaps_allow_for_every_edit(spark, plan):
    r = random.Random(9)
    left = [x.encode() for x in lines_of(r, 300) if len(x) >= 24]
    right = [edited(r, a, 2) if r.random() < 0.5 else reworded(r, a.decode(), max(1, len(a.split()) // 10)).encode() for a in left]
    n = len(left)
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(left + right)], "node long, body binary")
    bits = L.bitmaps(rows, plan).drop("body")
    pairs = bits.alias("x").join(bits.alias("y"), F.col("y.node") == F.col("x.node") + n).select(F.col("x.node").alias("a"), L.reachable("x", "y", plan).alias("can")).collect()
    want = [near(left[p["a"]], right[p["a"]], plan) for p in pairs]
    assert all(p["can"] for p, w in zip(pairs, want, strict=True) if w) and sum(want) > 100
    apart = bits.alias("x").join(bits.alias("y"), F.col("y.node") == (F.col("x.node") + 7) % n)
    assert apart.filter(L.reachable("x", "y", plan)).count() < 30


def test_pairs_are_judged_by_definition():
    r = random.Random(3)
    left = lines_of(r, 400)
    right = [reworded(r, a, r.randint(0, 4)) if r.random() < 0.7 else edited(r, a.encode(), r.randint(0, 4)).decode() for a in left]
    for plan in (L.LinePlan(), WORDS):
        got = L.alike(pa.array([x.encode() for x in left]), pa.array([x.encode() for x in right]), plan)
        want = [near(a.encode(), b.encode(), plan) for a, b in zip(left, right, strict=True)]
        assert got.tolist() == want and 50 < sum(want) < 350


def plain(texts, plan):
    lines = [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))]
    long = [(i, k, x.encode()) for i, k, x in lines if len(x.encode()) >= plan.min_bytes or plan.equal_short and x.strip(" \t\n\x0b\x0c\r")]
    bodies = sorted({x for _, _, x in long})
    by_edit = [x for x in bodies if len(x) >= plan.min_bytes]
    found = groups([(a, b) for a, b in itertools.combinations(by_edit, 2) if near(a, b, plan)], bodies)
    firsts: dict[bytes, tuple[int, int]] = {}
    for i, k, x in sorted(long, key=lambda v: v[:2]):
        firsts.setdefault(found[x], (i, k))
    return {(i, k): firsts[found[x]] for i, k, x in long if firsts[found[x]] != (i, k)}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    r = random.Random(seed)
    pool = [p[: r.randint(20, len(p))].encode() for p in PROSE for _ in range(3)] + [b"Licensed under a licence of its own kind"]
    texts = [*ODD]
    for _ in range(40):
        texts.append("\n".join(edited(r, r.choice(pool), r.randint(0, 4)).decode() for _ in range(r.randint(1, 5))))
    plan = L.LinePlan()
    docs = documents(spark, texts).repartition(3)
    got = {(x["doc_id"], x["line"]): (x["first_doc"], x["first_line"]) for x in L.duplicate_lines(docs, plan).collect()}
    want = plain(texts, plan)
    assert got == want
    cleaned = {x["doc_id"]: x["text"] for x in L.dedup_lines(docs, plan).collect()}
    for i, t in enumerate(texts):
        assert cleaned[i] == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want))


def test_passages_go_but_their_first_place_stays(spark):
    passage = " ".join(PROSE[0].split() * 4)
    got = [x["text"] for x in L.dedup_lines(documents(spark, ["a\n" + passage, passage + "\nb", "c\n" + passage.replace("grey", "gray")])).orderBy("doc_id").collect()]
    assert got[0] == "a\n" + passage and got[1] == "b"


def test_rows_that_share_an_id(spark):
    line = PROSE[0]
    rows = [(1, line, "en", "s", 0), (None, "first of all\n" + line, "en", "s", 0), (None, "first of all\n" + PROSE[1], "en", "s", 0), (5, PROSE[2] + "\n" + PROSE[1], "en", "s", 0)]
    got = sorted(x["text"] for x in L.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted(["", "first of all\n" + line, "first of all\n" + PROSE[1], PROSE[2]])


def test_short_lines_go_where_equal(spark):
    texts = ["All rights reserved.\n\n \t\nb\n" + PROSE[0], "b\nAll rights reserved\n\n \t\nAll rights reserved.", None, "", "b"]
    docs = documents(spark, texts)
    got = [x["text"] for x in L.dedup_lines(docs, L.LinePlan(equal_short=True)).orderBy("doc_id").collect()]
    assert got == [texts[0], "All rights reserved\n\n \t", None, "", ""]


@pytest.mark.parametrize("query", ["op2", "pipeline"])
def test_queries_drop_short_repeats(spark, tmp_path, query):
    documents(spark, ["one\ntwo", "two\nthree"]).write.parquet(f"{tmp_path}/documents.parquet")
    if query == "op2":
        assert [x["dropped_bytes"] for x in op2_segment_line_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()] == [0, 4]
    else:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert [x["text"] for x in corpus_pipeline.lines(spark, docs, str(tmp_path)).orderBy("doc_id").collect()] == ["one\ntwo", "three"]


@pytest.mark.parametrize("seed", range(3))
def test_anchors_are_common_to_all_lines_within_reach(seed):
    """Edits are spread evenly, which leaves the shortest unchanged runs."""
    r = random.Random(seed)
    for _ in range(400):
        a = r.choices([f"w{i}" for i in range(30)], k=r.choice([10, 11, 19, 20, 21, 29, 30, 39, 40, 59, 60, 100, 109, 110, 200, 299, 300, 301, 650]))
        edits, b = min(max(1, len(a) // 10), 30), list(a)
        kind = r.random()
        for e in reversed(range(edits)):
            at = min(len(b) - 1, (e + 1) * len(a) // (edits + 1) + r.randint(-1, 1))
            b[at : at + 1] = ["x", "y"] if kind < 0.3 else ["z"] if kind < 0.7 else r.choice([["z"], [b[at], "z"]])
        c = next(chunks(pa.array([" ".join(a), " ".join(b)])))
        keys, line = L.anchors(*L.line_words(c, c.starts, c.ends), WORDS)
        assert set(keys[line == 0]) & set(keys[line == 1])


@pytest.mark.parametrize("seed", [1, 2])
def test_words_against_all_pairs(spark, seed):
    r = random.Random(seed)
    texts, pool = [*ODD], lines_of(r, 12)
    for _ in range(60):
        line = r.choice(pool)
        texts.append("\n".join([reworded(r, line, r.randint(0, 1 + len(line.split()) // 12)) if r.random() < 0.7 else edited(r, line.encode(), r.randint(0, 3)).decode(), r.choice(["short one", "b", " ", line])]))
    plan = L.LinePlan(words_per_edit=10, equal_short=True)
    got = {(x["doc_id"], x["line"]): (x["first_doc"], x["first_line"]) for x in L.duplicate_lines(documents(spark, texts).repartition(3), plan).collect()}
    assert got == plain(texts, plan) and len(got) > 60


def test_large_groups_of_unlike_lines(spark, monkeypatch):
    """Lines that share a run but little else, and alike ones among them, found by their rare words alone."""
    monkeypatch.setattr(crosslinks, "DIRECT", 5)
    r = random.Random(6)
    run = "all of these lines begin with the very same run of common words and then"
    texts = [run + " " + " ".join(f"v{r.randrange(10**6)}" for _ in range(r.randint(6, 12))) for _ in range(150)]
    texts += [reworded(r, x, 1) for x in texts[:30]]
    r.shuffle(texts)
    got = {(x["doc_id"], x["line"]): (x["first_doc"], x["first_line"]) for x in L.duplicate_lines(documents(spark, texts), WORDS).collect()}
    assert got == plain(texts, WORDS) and len(got) >= 25


def test_runs_must_hold_an_anchor():
    with pytest.raises(ValueError):
        L.LinePlan(words_per_edit=5, min_words=6)


def test_query_columns(spark, tmp_path):
    texts = [*ODD, "\n".join(PROSE), "new\n" + PROSE[1].replace("expected", "awaited"), "new\n\n" + PROSE[2] + " "]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    drop = plain(texts, LINES)
    for x in op2_segment_line_dedup(spark, str(tmp_path)).collect():
        t = texts[x["doc_id"]] or ""
        kept = "\n".join(v for k, v in enumerate(t.split("\n")) if (x["doc_id"], k) not in drop).encode()
        assert (x["n_lines"], x["kept_bytes"], x["kept_crc32"], x["dropped_bytes"]) == (t.count("\n") + 1, len(kept), zlib.crc32(kept), len(t.encode()) - len(kept))


def test_texts_of_very_many_lines(spark):
    texts = ["\n".join([PROSE[0], PROSE[1]] * 200_000), "\n".join(f"{PROSE[2]} {i % 7}" for i in range(100_000))]
    got = [x["text"] for x in L.dedup_lines(documents(spark, texts), LINES).orderBy("doc_id").collect()]
    assert got == ["\n".join(PROSE[:2]), PROSE[2] + " 0"]


def test_clashing_columns(spark):
    names = ["_doc", "_drop", "drop", "text_hash", "line", "node", "c0"]
    docs = documents(spark, ["\n".join(PROSE), PROSE[0] + "\nother"]).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    out = L.dedup_lines(docs).orderBy("doc_id").collect()
    assert out[0].asDict() == docs.orderBy("doc_id").first().asDict() and out[1]["text"] == "other" and out[1]["node"] == 5


def test_query_finds_a_changed_word(spark, tmp_path):
    line = " ".join(PROSE)
    documents(spark, [line, line.replace("northern", "southern"), line.replace("captains", "sailors of it"), " ".join(line.split()[::-1])]).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [x["kept_bytes"] for x in op2_segment_line_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert kept == [len(line), 0, 0, len(line)]


def test_odd_rows(odd, empty):
    out = L.dedup_lines(odd)
    assert out.count() == odd.count() and out.columns == odd.columns and L.dedup_lines(empty).count() == 0
    with pytest.raises(ValueError):
        L.LinePlan(edits=5, min_bytes=5)


def test_lines_by_parts_and_texts_shuffled_once(spark, odd, monkeypatch):
    whole = {r["node"]: bytes(r["body"]) for r in L.line_texts(odd, LINES).collect()}
    parts = [{r["node"]: bytes(r["body"]) for r in L.line_texts(odd, LINES, "text", k, 3).collect()} for k in range(3)]
    assert sum(map(len, parts)) == len(whole) and {k: v for p in parts for k, v in p.items()} == whole
    from evalboard.llm import queries

    given = []
    monkeypatch.setattr(queries, "documents", lambda *_: odd)
    monkeypatch.setattr(queries, "dedup_lines", lambda docs, plan: given.append(docs) or docs)
    rows = queries.op2_segment_line_dedup(spark, "").collect()
    assert [c for c, kind in given[0].dtypes if kind == "string"] == ["text"]
    assert len(rows) == odd.count() and all(r["dropped_bytes"] == 0 for r in rows)


@pytest.mark.parametrize("held", [1 << 22, 50])
@pytest.mark.parametrize("seed", range(4))
def test_members_of_keys_meet_piece_by_piece(seed, held, monkeypatch):
    """Each member but one segment is paired with that segment, also where members go before all are there; probes alone meet nothing."""
    monkeypatch.setattr(L, "HELD", held)
    r = random.Random(seed)
    members = {k: {(n, int(k % 3 == 0 or r.random() < 0.6)) for n in r.sample(range(40), r.choice([1, 2, 3, 12]))} for k in range(60)}
    given = [(k, n | role << 62) for k, of in members.items() for n, role in of for _ in range(r.randint(1, 3))]
    r.shuffle(given)
    meeting, out = L.Meeting(), []
    for at in range(0, len(given), 25):
        key, member = (np.array(x, np.uint64) for x in zip(*given[at : at + 25], strict=True))
        gone = meeting.add(key, member)
        out += gone.to_pylist() if gone is not None else []
    out += meeting.pairs(last=True).to_pylist()
    for k, of in members.items():
        rows, found = [x for x in out if x["key"] == k], [n for n, role in of if not role]
        if len(of) < 2 or not found:
            assert not rows
            continue
        first = {x["first"] for x in rows}
        assert len(first) == 1 and first <= set(found)
        assert {(x["node"], x["role"]) for x in rows} == {m for m in of if m != (next(iter(first)), 0)}
        assert all(x["more"] for x in rows) or len(of) == 2 or len(found) == 1


def test_keys_travel_packed_and_pairs_are_settled(spark, monkeypatch):
    """Rows that are shuffled do not follow the keys; a key of two members is settled by its one pair."""
    r = random.Random(4)
    texts = ["\n".join(" ".join(f"w{r.randrange(10**6)}" for _ in range(r.randint(5, 25))) for _ in range(40)) for _ in range(30)]
    rows = L.packed_keys(documents(spark, texts).coalesce(1), LINES, 8).collect()
    keys = sum(len(x["packed"]) // 16 for x in rows)
    assert len(rows) == 8 and keys > 5000
    given, real = [], L.link_across
    monkeypatch.setattr(L, "link_across", lambda members, *a: given.append(members.count()) or real(members, *a))
    texts += [t.replace("w1", "v1", 1) for t in texts]
    assert L.duplicate_lines(documents(spark, texts), LINES).count() > 500 and given == [0]


def test_unlike_members_of_a_key_go_where_it_is(spark, monkeypatch):
    """Members of a large key without one that may be alike are no rows; those with one are links at once."""
    r = random.Random(8)
    run = "all of these lines begin with the very same run of common words and then"
    texts = [run + " " + " ".join(f"v{r.randrange(10**6)}" for _ in range(r.randint(9, 30))) for _ in range(200)]
    texts += [reworded(r, x, 1) for x in texts[:20]]
    hits = L.key_pairs(L.packed_keys(documents(spark, texts), WORDS, 4), WORDS).collect()
    assert 20 <= len({frozenset((x["node"], x["first"])) for x in hits}) < 60 and not any(x["more"] for x in hits)
    assert L.duplicate_lines(documents(spark, texts), WORDS).count() >= 18


@pytest.mark.parametrize("seed", range(3))
def test_sketches_allow_for_every_edit(seed):
    """Of alike lines that share a key, one of their keys at least takes them for near."""
    r = random.Random(seed)
    for words in (3, 9, 10, 11, 19, 40, 130, 400):
        for _ in range(20):
            line = " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(6, 9))) for _ in range(words))
            other = reworded(r, line, max(1, words // 10)) if words > 12 or r.random() < 0.5 else edited(r, line.encode(), 2).decode("utf-8", "replace")
            pair = pa.array([line, other])
            if not L.alike(pair[:1].cast(pa.binary()), pair[1:].cast(pa.binary()), LINES)[0] or line == other:
                continue
            key, member, sketch, size = L.line_keys(next(chunks(pair)), LINES)
            order = np.lexsort((member, key))
            key, member, sketch, size = (x[order] for x in (key, member, sketch, size))
            met = np.flatnonzero(key[1:] == key[:-1])
            assert L.Near(sketch, size, LINES).pairs(met, met + 1).any()
