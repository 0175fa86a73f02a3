"""Centroid clustering by kd-tree filtering, exact over integers.

Vectors become integers, so sums, centroids (floors of means) and squared distances have no rounding and no order of addition matters.

Each task packs its vectors into kd-trees of bounded size. A tree's nodes hold a count, the sum of their vectors and their bounding box; trees are written once. In each round every task walks its trees from the root with
all centroids as candidates: the candidate nearest to the middle of a node's box strictly dominates another if that one is farther from every point of the box, which its nearest corner tells; dominated ones are pruned.
A node with one candidate is assigned whole, by its count and sum; in leaves the candidates left are held against each vector, ties to the smaller number. What leaves a task is a count and a sum for each centroid,
which Spark adds up; the driver sees as many numbers as the centroids have.

Trees hold rows as they come, so equal vectors need no common task; many of them make a box of one point, which is one leaf.

Numbers: where all products fit the 53 bits of a double, arrays of doubles are used, which are then exact; else Python's integers.

Defined cases: vectors that are null, of another length, or with a null or non-finite component (beyond a 32-bit float's range, too) are left out; fewer vectors than centroids make each a centroid; equal ids have
equal hashes, and then vectors decide; null ids come last and are kept; an empty centroid stays where it is; distances and inertias beyond 64 bits are cut at 2**63 - 1; an empty table gives an empty result;
columns other than the id and the vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import free, lean, workers_find_package, written

#: Vectors of a tree and of a leaf at most.
TREE_ROWS, LEAF_ROWS = 4096, 32
#: Numbers of a node x centroid x component array at most.
AT_A_TIME = 1 << 21
#: Doubles hold all integers below it.
EXACT = 1 << 53
#: Sums leave a task in two parts, so that each fits 38 digits.
LIMB = 10**30
LARGEST = (1 << 63) - 1


@dataclass(frozen=True)
class KMeans:
    """Vectors are floor(scale * component); seeds are the vectors with the smallest sha256 of seed_text:id."""

    dims: int = 64
    k: int = 8
    rounds: int = 10
    scale: int = 1024
    seed_text: str = "3"


def encoded(numbers: np.ndarray) -> bytes:
    """Integers in 4 bytes each, or as text where some need more."""
    if numbers.dtype != object and (not numbers.size or np.abs(numbers).max() < 1 << 31):
        return b"i" + numbers.astype(np.int32).tobytes()
    return b"t" + ",".join(str(int(x)) for x in numbers.ravel()).encode()


def decoded(data: bytes, dims: int) -> np.ndarray:
    if data[:1] == b"i":
        return np.frombuffer(data, np.int32, offset=1).astype(np.float64).reshape(-1, dims)
    return np.array([int(x) for x in data[1:].split(b",")], dtype=object).reshape(-1, dims)


def exact(points: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if every squared distance, product and sum of a tree fits, else as Python's integers."""
    most = max((abs(x) for c in centroids for x in c), default=0)
    if points.dtype != object:
        most = max(most, int(np.abs(points).max(initial=0)))
        if 16 * points.shape[1] * max(most, 1) ** 2 < EXACT and most * TREE_ROWS < EXACT:
            return points, np.array(centroids, np.float64)
    whole = np.array([[int(x) for x in row] for row in points.tolist()], dtype=object).reshape(points.shape) if points.dtype != object else points
    return whole, np.array(centroids, dtype=object)


@dataclass
class Tree:
    """Rows in the order of the leaves; first, last and child (of the first of two, 0 for a leaf) of each node, the root first."""

    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray


def built(points: np.ndarray) -> Tree:
    """Nodes are cut in half across the longest side of their box, until they are small or a point."""
    order = np.arange(len(points))
    first, last, child, at = [0], [len(points)], [0], 0
    while at < len(first):
        a, b = first[at], last[at]
        if b - a > LEAF_ROWS:
            own = points[order[a:b]]
            side = own.max(0) - own.min(0)
            axis = int(np.argmax(side))
            if side[axis] > 0:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argsort(own[:, axis], kind="stable")]
                child[at] = len(first)
                first += [a, a + half]
                last += [a + half, b]
                child += [0, 0]
        at += 1
    return Tree(order, np.array(first), np.array(last), np.array(child))


def boxes(points: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowest and highest corner and sum of each node; points in the tree's order."""
    parts = [points[a:b] for a, b in zip(tree.first, tree.last, strict=True)]
    return np.stack([p.min(0) for p in parts]), np.stack([p.max(0) for p in parts]), np.stack([p.sum(0) for p in parts])


def dominated(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Of each node and centroid: still a candidate, and not farther than the one nearest to the box's middle at every point of the box."""
    middle = ((low + high)[:, None, :] - 2 * centroids[None, :, :]) ** 2  # of twice the middle, so that it is whole
    far = middle.sum(2)
    worst = far.max() + 1 if far.size else 0
    best = np.argmin(np.where(open_, far, worst).astype(far.dtype), axis=1)
    apart = centroids[None, :, :] - centroids[best][:, None, :]
    corner = np.where(apart > 0, high[:, None, :], low[:, None, :])  # where the other has its best chance
    square = (centroids * centroids).sum(1)
    more = square[None, :] - square[best][:, None] - 2 * (apart * corner).sum(2)
    return open_ & ~(more > 0)


def nearest(points: np.ndarray, centroids: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest of the open centroids of each point; the first of equals."""
    square = (centroids * centroids).sum(1)
    distance = (points * points).sum(1)[:, None] + square[None, :] - 2 * (points @ centroids.T)
    held = np.where(open_, distance, distance.max(initial=0) + 1).astype(distance.dtype)
    best = np.argmin(held, axis=1)
    return best, distance[np.arange(len(points)), best]


def filtered(tree: Tree, points: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes and their candidates when the walk ends there: one is left, or the node is a leaf."""
    nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    step = max(1, AT_A_TIME // (len(centroids) * points.shape[1]))
    while len(nodes):
        open_ = np.concatenate([dominated(low[nodes[i : i + step]], high[nodes[i : i + step]], centroids, open_[i : i + step]) for i in range(0, len(nodes), step)])
        done = (open_.sum(1) == 1) | (tree.child[nodes] == 0)
        yield nodes[done], open_[done]
        below, left = tree.child[nodes[~done]], open_[~done]
        nodes, open_ = np.concatenate([below, below + 1]), np.concatenate([left, left])


def summed(tree: Tree, points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of each centroid's vectors."""
    count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), points.shape[1]), points.dtype)
    for nodes, open_ in filtered(tree, points, low, high, centroids):
        one = open_.sum(1) == 1
        for node, c in zip(nodes[one], np.argmax(open_[one], axis=1), strict=True):
            count[c] += tree.last[node] - tree.first[node]
            total[c] += sums[node]
        for node, left in zip(nodes[~one], open_[~one], strict=True):
            own = points[tree.first[node] : tree.last[node]]
            best, _ = nearest(own, centroids, left[None, :])
            for c in np.unique(best):
                mine = best == c
                count[c] += mine.sum()
                total[c] += own[mine].sum(0)
    return count, total


def placed(tree: Tree, points: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Centroid and squared distance of each vector, in the tree's order."""
    cluster, distance = np.zeros(len(points), np.int32), [0] * len(points)
    for nodes, open_ in filtered(tree, points, low, high, centroids):
        for node, left in zip(nodes, open_, strict=True):
            a, b = int(tree.first[node]), int(tree.last[node])
            cluster[a:b], far = nearest(points[a:b], centroids, left[None, :])
            distance[a:b] = [min(int(x), LARGEST) for x in far]
    return cluster, distance


_TREES = "ids array<long>, points binary, first array<int>, last array<int>, child array<int>, low binary, high binary, sums binary"


def vectors(docs: DataFrame, plan: KMeans, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and embedding of the vectors that are kept, components as 32-bit floats."""
    kept = docs.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("embedding")).filter(F.size("embedding") == plan.dims)
    return kept.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def whole(column: pa.Array, plan: KMeans) -> np.ndarray:
    """floor(scale * x) of each component: in double precision, which is exact for a scale that is a power of two."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * plan.scale).reshape(-1, plan.dims)
    return x if not x.size or np.abs(x).max() < EXACT else np.array([[int(v) for v in row] for row in x.tolist()], dtype=object)


def trees(kept: DataFrame, plan: KMeans) -> DataFrame:
    """The vectors of each task in trees of at most TREE_ROWS; written."""
    workers_find_package(kept.sparkSession)

    def one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        points = whole(rows.column(1).combine_chunks(), plan)
        tree = built(points)
        points = points[tree.order]
        low, high, sums = boxes(points, tree)
        row = {"ids": rows.column(0).take(pa.array(tree.order)).to_pylist(), "points": encoded(points), "first": tree.first.tolist(), "last": tree.last.tolist(), "child": tree.child.tolist(), "low": encoded(low), "high": encoded(high), "sums": encoded(sums)}
        integers = pa.list_(pa.int32())
        types = {"ids": pa.list_(pa.int64()), "first": integers, "last": integers, "child": integers}
        return pa.RecordBatch.from_pydict({k: pa.array([v], types.get(k, pa.binary())) for k, v in row.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, TREE_ROWS - n))
                at += held[-1].num_rows
                n += held[-1].num_rows
                if n == TREE_ROWS:
                    yield one(held)
                    held, n = [], 0
        if n:
            yield one(held)

    return written(kept.mapInArrow(lean(run), _TREES), "kd-trees")


def _opened(row: dict, centroids: list[list[int]]) -> tuple:
    dims = len(centroids[0])
    points, c = exact(decoded(row["points"], dims), centroids)
    tree = Tree(np.zeros(0), *(np.array(row[k]) for k in ("first", "last", "child")))
    as_one = lambda k: decoded(row[k], dims) if points.dtype != object else exact(decoded(row[k], dims).astype(object), centroids)[0]
    return tree, points, as_one("low"), as_one("high"), as_one("sums"), c


def totals(grown: DataFrame, centroids: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Count and sum of each centroid's vectors over all trees."""
    k, dims = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * k, [[0] * dims for _ in range(k)]
        for batch in batches:
            for i in range(batch.num_rows):
                tree, points, low, high, sums, c = _opened(batch.slice(i, 1).to_pylist()[0], centroids)
                n, s = summed(tree, points, low, high, sums, c)
                count = [a + int(b) for a, b in zip(count, n, strict=True)]
                total = [[a + int(b) for a, b in zip(x, y, strict=True)] for x, y in zip(total, s, strict=True)]
        large = pa.decimal128(38, 0)
        flat = [x for row in total for x in row]
        yield pa.RecordBatch.from_arrays([
            pa.array([c for c in range(k) for _ in range(dims)], pa.int32()), pa.array(list(range(dims)) * k, pa.int32()), pa.array([n for n in count for _ in range(dims)], pa.int64()),
            pa.array([Decimal(x // LIMB) for x in flat], large), pa.array([Decimal(x % LIMB) for x in flat], large),
        ], ["cluster", "dim", "n", "high", "low"])

    rows = grown.mapInArrow(lean(run), "cluster int, dim int, n long, high decimal(38, 0), low decimal(38, 0)").groupBy("cluster", "dim")
    count, total = [0] * k, [[0] * dims for _ in range(k)]
    for c, d, n, high, low in rows.agg(F.sum("n"), F.sum("high"), F.sum("low")).collect():  # k * dims rows
        count[c], total[c][d] = n, int(high) * LIMB + int(low)
    return count, total


def initial(kept: DataFrame, plan: KMeans) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{plan.seed_text}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(digest.asc_nulls_last(), "embedding").limit(plan.k).select("embedding").toArrow()  # k rows
    return [[int(x) for x in row] for row in whole(first.column(0).combine_chunks(), plan).tolist()] if first.num_rows else []


def clustered(docs: DataFrame, plan: KMeans | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that is kept, and the centroids."""
    plan = plan or KMeans()
    spark = docs.sparkSession
    kept = vectors(docs, plan, id_col, vector_col)
    centroids = initial(kept, plan)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], out), []
    grown = trees(kept, plan)
    for _ in range(plan.rounds):
        count, total = totals(grown, centroids)
        centroids = [[x // n for x in s] if n else c for n, s, c in zip(count, total, centroids, strict=True)]
    last = centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                tree, points, low, high, _, c = _opened(row, last)
                cluster, distance = placed(tree, points, low, high, c)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    rows = written(grown.mapInArrow(lean(run), "vec_id long, cluster int, distance long"), "clusters")
    inertia = {c: int(x) for c, x in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)"))).collect()}  # k rows
    told = [(c, min(inertia.get(c, 0), LARGEST), min(sum(inertia.values()), LARGEST), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    free(grown)
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids  # k rows
