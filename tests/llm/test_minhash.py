"""Components of near-duplicates against all pairs."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalboard.llm import crosslinks as X
from evalboard.llm import minhash as M
from evalboard.llm.components import components
from evalboard.llm.kernels import chunks

from .conftest import ODD, documents


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(pairs, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def plain(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = groups(links, range(len(texts)))
    return {i: (len(sets[i]), found[i], found[i] == i) for i in found}


def corpus(seed, n=25):
    """Originals, chains of edits (linked only through others), and a large group of copies."""
    r = random.Random(seed)
    pool = [f"w{i}" for i in range(400)]
    texts = [*ODD]
    for _ in range(n):
        w = r.choices(pool, k=r.randint(3, 200))
        texts.append(" ".join(w))
        for _ in range(r.randint(0, 6)):
            w = list(w)
            for _ in range(r.randint(0, 1 + len(w) // 40)):
                w[r.randrange(len(w))] = r.choice(pool)
            texts.append(" ".join(w).upper() if r.random() < 0.3 else "\n ".join(w))
    base = r.choices(pool, k=120)
    for _ in range(60):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(pool)
        texts.append(" ".join(w))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_against_all_pairs(spark, seed, k, percent):
    texts = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in M.near_duplicates(documents(spark, texts).repartition(3), M.MinHashPlan(words=k, percent=percent)).collect()}
    assert got == plain(texts, k, percent)


def test_sketches_estimate_similarity(spark):
    plan = M.MinHashPlan()
    r = random.Random(4)
    base = [f"w{i}" for i in range(600)]
    other = base[:450] + [f"v{i}" for i in range(150)]
    rows = M.signatures(documents(spark, [" ".join(base), " ".join(other)]), plan)
    a, b = rows.filter("doc_id = 0").select(F.col("sketch").alias("a")), rows.filter("doc_id = 1").select(F.col("sketch").alias("b"))
    n = a.join(b).select(M.matching_fields(F.col("a"), F.col("b"), plan)).first()[0]
    s = len(shingles(" ".join(base), 5) & shingles(" ".join(other), 5)) / len(shingles(" ".join(base), 5) | shingles(" ".join(other), 5))
    assert abs((n / plan.hashes - 0.25) / 0.75 - s) < 0.17 and 0 < plan.least_matches < plan.hashes and r.random() < 1


def test_sets_are_exact():
    texts = ["a b c a b c", "x", "", "A b C"]
    c = next(chunks(pa.array(texts)))
    values, sizes = M.shingles(c, 3)
    assert sizes.tolist() == [3, 1, 0, 1] and len(np.unique(values)) == 4


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200), (300, 5)]
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = {i for e in edges if e[0] != e[1] for i in e}
    assert got == {k: v for k, v in groups([e for e in edges if e[0] != e[1]], ids).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, empty):
    rows = M.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and M.near_duplicates(empty).count() == 0
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]
    assert all(r["kept"] for r in rows if r["n_shingles"] == 0)


@pytest.mark.parametrize("size", [20, 148, 900, 5000])
def test_bitmaps_never_exceed_the_true_difference(size):
    r = np.random.default_rng(size)
    a = np.unique(r.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[: size * 9 // 10], r.integers(0, 1 << 63, size // 5, np.uint64)]))
    bits = M.bitmaps(np.concatenate([a, b]), np.array([len(a), len(b)]))
    assert 0 < int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= len(np.setxor1d(a, b))


def test_members_without_a_partner_go_before_any_meet(spark):
    """Sets of 100 that share 80 meet in no key; every linked pair still meets, within reach of one another."""
    r = random.Random(9)
    hashed = lambda *x: hash(x) & (1 << 62) - 1
    sets = [[hashed(0, k) for k in range(80)] + [hashed(1, i, k) for k in range(20)] for i in range(60)]
    base = [hashed(2, k) for k in range(100)]
    near = [sorted({*r.sample(base, r.randint(84, 100)), *(hashed(3, i, k) for k in range(r.randint(0, 8)))}) for i in range(40)]
    percent = 85
    table = [(i, s, len(s) - (len(s) * percent + 99) // 100 + 1, len(s)) for i, s in enumerate([*sets, *near])]
    given = spark.createDataFrame(table, "node long, elements array<long>, prefix long, weight long")
    plan = M.MinHashPlan(percent=percent)
    keyed = X.rare_keys(given).join(given.select("node", "weight"), "node").withColumn("reach", M.reach_of(F.col("weight"), F.col("place"), plan)).cache()
    met = {}
    for x in X.within_reach(keyed).collect():
        met.setdefault(x["key"], []).append(x)
    pairs = {(a["node"], b["node"]) for rows in met.values() for a in rows for b in rows if a["node"] < b["node"] and a["weight"] <= b["reach"] and b["weight"] <= a["reach"]}
    assert not any(a < 60 for a, _ in pairs)
    linked = {(60 + i, 60 + j) for i, j in itertools.combinations(range(40), 2) if 100 * len({*near[i]} & {*near[j]}) >= percent * len({*near[i]} | {*near[j]})}
    assert linked and linked <= pairs


def test_samples_do_not_grow_with_the_keys_that_are_shared(spark):
    rows = [(key, node, 0, 1 if node <= 40 else node) for key in range(30) for node in range(1, 46)]
    members = spark.createDataFrame(rows, "key long, node long, role byte, component long")
    opened = X._open(members).cache()
    pairs = X.sampled_pairs(opened, members.groupBy("node").agg(F.count("*").alias("degree")), 0).collect()
    assert len({p["a"] for p in pairs}) == 5 and len(pairs) <= 5 * X.SAMPLES


def test_rare_keys_carry_what_is_known_of_a_set(spark):
    """A set's component and size go along with its elements; no join by node makes a row for each of them."""
    given = spark.createDataFrame([(i, [i * 10 + k for k in range(6)], 3, 100 + i, 6 + i) for i in range(20)], "node long, elements array<long>, prefix long, component long, weight long")
    rows = X.rare_keys(given, ("component", "weight")).collect()
    assert len(rows) == 60 and all((x["component"], x["weight"]) == (100 + x["node"], 6 + x["node"]) for x in rows)


def test_joins_of_wide_groups_do_not_follow_the_elements(spark, monkeypatch):
    """Sets of one bucket that are not linked: joins by node make a row for each set, not for each rare element."""
    monkeypatch.setattr(X, "DIRECT", 4)
    plans, real = [], X.written
    monkeypatch.setattr(X, "written", lambda df, name, *a: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, name, *a))
    r = random.Random(12)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join([*base, *(f"u{i}x{k}" for k in range(r.randint(10, 14)))]) for i in range(60)]
    M.near_duplicates(documents(spark, texts), M.MinHashPlan(words=3, percent=85, bands=44, bits=2)).collect()
    keyed = [p for name, p in plans if name == "minhash-keyed"]
    assert keyed and not any("Join" in p for p in keyed)
    assert [name for name, _ in plans].count("minhash-across") == 2  # one step for each kind of key: the driver keeps something of every step
