"""Clustering by kd-trees against plain integer k-means."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalboard.llm import centroids as K

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def plain(rows, plan):
    kept = []
    for vec_id, v, *_ in rows:
        if v is not None and len(v) == plan.dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(plan.scale * float(x)) for x in v], v))
    digest = lambda r: (r[0] is None, hashlib.sha256(f"{plan.seed_text}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2])
    centroids = [r[1] for r in sorted(kept, key=digest)[: plan.k]]
    if not centroids:
        return []

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(centroids)) for _, x, _ in kept]

    for _ in range(plan.rounds):
        own = {}
        for (_, x, _), (_, c) in zip(kept, assigned(), strict=True):
            own.setdefault(c, []).append(x)
        centroids = [[sum(col) // len(own[c]) for col in zip(*own[c], strict=True)] if c in own else x for c, x in enumerate(centroids)]
    last, inertia, cut = assigned(), Counter(), lambda x: min(x, K.LARGEST)
    for d, c in last:
        inertia[c] += cut(d)
    whole = cut(sum(inertia.values()))
    return sorted(((r[0], c, cut(d), cut(inertia[c]), whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for r, (d, c) in zip(kept, last, strict=True)), key=repr)


def cases(seed, n, dims, spread=1.0):
    rng = random.Random(seed)
    as_float = lambda x: float(np.float32(x))
    middles = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        m = rng.choice(middles)
        rows.append((i, [as_float(rng.gauss(x, spread / 10)) for x in m]))
    same = [as_float(x) for x in middles[0]]
    rows += [(1000 + i, same) for i in range(n)]  # a third or more are one vector
    rows += [(3, same), (3, [as_float(x) for x in middles[1]]), (None, same), (None, None), (-1, []), (-2, same[:-1]), (-3, [None, *same[1:]]), (-4, [float("nan"), *same[1:]]), (-5, [float("-inf"), *same[1:]])]
    rng.shuffle(rows)
    return [(*r, "x") for r in rows]


def found(spark, rows, plan, parts=3):
    out, _ = K.clustered(spark.createDataFrame(rows, SCHEMA).repartition(parts), plan)
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize(("dims", "k", "n"), [(64, 8, 150), (2, 8, 400), (3, 1, 60), (1, 5, 80)])
def test_like_plain(spark, dims, k, n):
    plan = K.KMeans(dims=dims, k=k, rounds=4)
    rows = cases(dims, n, dims)
    assert found(spark, rows, plan) == plain(rows, plan)


def test_numbers_beyond_doubles(spark):
    plan = K.KMeans(dims=2, k=3, rounds=3)
    rows = cases(5, 60, 2, spread=1e9) + [(5000, [float(np.float32(3e38)), float(np.float32(-3e38))], "x"), (5001, [1e-30, -1e-30], "x")]
    assert found(spark, rows, plan) == plain(rows, plan)


def test_ties_and_few_vectors(spark):
    plan = K.KMeans(dims=2, k=8, rounds=3)
    grid = [(i, [float(i % 5), float(i // 5)], "x") for i in range(25)] * 3
    assert found(spark, grid, plan) == plain(grid, plan)
    few = grid[:3]
    assert found(spark, few, plan) == plain(few, plan)


def test_empty(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    out, centroids = K.clustered(nothing)
    assert out.count() == 0 and centroids == [] and out.columns[0] == "vec_id"
    out, _ = K.clustered(spark.createDataFrame([(1, [1.0], "x")], SCHEMA).withColumn("label", F.lit(1)))
    assert out.count() == 0


def test_whole_nodes_are_assigned():
    """Far apart groups need no vector looked at."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(0, 50, (500, 4)), rng.integers(10_000, 10_050, (500, 4))]).astype(float)
    tree = K.built(points)
    points = points[tree.order]
    low, high, sums = K.boxes(points, tree)
    c = np.array([[25.0] * 4, [10_025.0] * 4])
    ended = list(K.filtered(tree, points, low, high, c))
    assert sum(len(n) for n, _ in ended) == 2 and all((o.sum(1) == 1).all() for _, o in ended)
    count, total = K.summed(tree, points, low, high, sums, c)
    assert count.tolist() == [500, 500] and (total.sum(0) == points.sum(0)).all()
