"""Near-duplicate documents by b-bit MinHash.

Minima of bands x rows hash functions over a text's word shingles give band keys (all bits) and a sketch (the low bits of each minimum, packed).
Documents that share a band key are candidates; a candidate pair must be able to reach the similarity by its set sizes, then by its sketches, whose agreeing fields,
counted with bit operations and corrected for chance collisions, may fall short by `sigmas` standard deviations; then it is confirmed on the full shingle sets.

No pairs within a group of copies are made. Equal sets are one node. Each band bucket first links its members to its smallest one, and the confirmed links are joined
to components; then only pairs across components of a bucket are left (crosslinks: large buckets of unlinked documents are parted by their rarest shingles). Bitmaps of
the full sets bound how much two can share, so copies that are too far from one another are not made into pairs.

Defined cases: null and empty texts and texts without words have an empty set and are linked with nothing; fewer words than a shingle are one shingle; repeated rows share a set;
rows of one id count as one document that has a link if one of its sets has; a null id is kept and has no component; an empty table gives an empty result;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .crosslinks import link_across
from .kernels import NOT_SPACE, Chunk, chunks, mix, ngram_hashes
from .runtime import free, lean, settle, sweep, workers_find_package, written


@dataclass(frozen=True)
class MinHashPlan:
    """words: of a shingle. percent: least similarity. A pair of just that similarity is missed with probability (1 - s**rows)**bands, 8e-6 at 80 percent and 2e-9 at 85.

    Eight rows let one pair in six of similarity 0.5 and one in 30 of 0.4 share a bucket.
    """

    words: int = 5
    percent: int = 80
    bands: int = 64
    rows: int = 8
    bits: int = 2
    sigmas: float = 6.0
    seed: int = 1

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_matches(self) -> int:
        """Fields of two sketches that must agree: expected at the similarity, with chance agreement of 2**-bits, less sigmas deviations."""
        chance, s = 2.0**-self.bits, self.percent / 100
        p = s + (1 - s) * chance
        return max(0, math.floor(self.hashes * p - self.sigmas * math.sqrt(self.hashes * p * (1 - p))))


def shingles(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, row by row, and how many each row has."""
    c = c.lowered()
    first, last, row = c.words(NOT_SPACE)
    words = c.hashes(first, last)
    n_words = np.bincount(row, minlength=c.n)
    keys, at = ngram_hashes(words, row, k)
    owner = row[at]
    start = np.cumsum(n_words) - n_words
    for n in range(1, k):
        short = np.flatnonzero(n_words == n)
        if len(short):
            h, of = ngram_hashes(words, row, n, start[short])
            keys, owner = np.concatenate([keys, mix(h + np.uint64(n))]), np.concatenate([owner, row[of]])
    order = np.argsort(owner, kind="stable")
    keys, owner = keys[order], owner[order]
    edges = np.searchsorted(owner, np.arange(c.n + 1))
    sets = [np.unique(keys[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else keys), sizes


def minima(values: np.ndarray, starts: np.ndarray, plan: MinHashPlan) -> np.ndarray:
    """hashes x sets: the least 32-bit hash of each set; values from starts[i] on are set i, none is empty."""
    random = np.random.Generator(np.random.PCG64(plan.seed))
    a = random.integers(0, 1 << 63, plan.hashes, np.uint64) * np.uint64(2) + np.uint64(1)
    b = random.integers(0, 1 << 63, plan.hashes, np.uint64)
    out = np.empty((plan.hashes, len(starts)), np.uint64)
    for j in range(plan.hashes):
        out[j] = np.minimum.reduceat((values * a[j] + b[j]) >> np.uint64(32), starts)
    return out


def band_keys(m: np.ndarray, plan: MinHashPlan) -> np.ndarray:
    """sets x bands."""
    keys = np.empty((m.shape[1], plan.bands), np.uint64)
    for band in range(plan.bands):
        h = np.full(m.shape[1], band + 1, np.uint64)
        for j in range(band * plan.rows, (band + 1) * plan.rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + m[j])
        keys[:, band] = h
    return keys


def sketches(m: np.ndarray, plan: MinHashPlan) -> np.ndarray:
    """sets x 64-bit words of packed low bits."""
    per = 64 // plan.bits
    out = np.zeros((m.shape[1], -(-plan.hashes // per)), np.uint64)
    for j in range(plan.hashes):
        out[:, j // per] |= (m[j] & np.uint64((1 << plan.bits) - 1)) << np.uint64(plan.bits * (j % per))
    return out


def matching_fields(left: Column, right: Column, plan: MinHashPlan) -> Column:
    """How many fields of two sketches agree."""
    per = 64 // plan.bits
    low = sum(1 << (plan.bits * i) for i in range(per))
    low -= (low >> 63) << 64
    differing = F.lit(0)
    for k in range(-(-plan.hashes // per)):
        x = left[k].bitwiseXOR(right[k])
        any_bit = x
        for i in range(1, plan.bits):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, i))
        differing = differing + F.bit_count(any_bit.bitwiseAND(F.lit(low)))
    return F.lit(plan.hashes) - differing


def _long_lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * k, pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def signatures(docs: DataFrame, plan: MinHashPlan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_hi and set_lo (a 128-bit fingerprint of the set), bands, sketch; the last two are null for an empty set."""
    workers_find_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                values, sizes = shingles(c, plan.words)
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                prints = np.zeros((2, c.n), np.uint64)
                at = np.full(c.n, -1)
                at[full] = np.arange(len(full))
                if len(full):
                    m = minima(values, starts, plan)
                    keys, packed = band_keys(m, plan), sketches(m, plan)
                    for k in range(2):
                        prints[k, full] = np.add.reduceat(mix(values + np.uint64(k + 1)), starts)
                else:
                    keys, packed = np.zeros((0, plan.bands), np.uint64), np.zeros((0, 1), np.uint64)
                take = pa.array(at, mask=at < 0)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(c.row, c.n), "n_shingles": pa.array(sizes), "set_hi": pa.array(prints[0].view(np.int64)), "set_lo": pa.array(prints[1].view(np.int64)),
                    "bands": _long_lists(keys).take(take), "sketch": _long_lists(packed).take(take),
                })

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(lean(run), "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>, sketch array<long>")


BITMAP = 2048


def bitmaps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """sets x 64-bit words: which of 2048 buckets each set's shingles fall into."""
    seen = np.zeros((len(sizes), BITMAP), np.uint8)
    seen[np.repeat(np.arange(len(sizes)), sizes), (values >> np.uint64(53)).astype(np.int64)] = 1
    return np.packbits(seen, axis=1, bitorder="little").view("<u8")


def shingle_sets(docs: DataFrame, plan: MinHashPlan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, its full set of shingle hashes, and the set's bitmap."""
    workers_find_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                values, sizes = shingles(c, plan.words)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(c.row, c.n), "shingles": pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64))), "bits": _long_lists(bitmaps(values, sizes))})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(lean(run), "doc_id long, shingles array<long>, bits array<long>")


def possible(a: str, b: str, plan: MinHashPlan) -> Column:
    """Whether the similarity can be reached, by set sizes and sketches."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    by_size = F.least(n, m) * 100 >= F.greatest(n, m) * plan.percent
    return by_size & (matching_fields(F.col(f"{a}.sketch"), F.col(f"{b}.sketch"), plan) >= plan.least_matches)


def reachable(a: str, b: str, plan: MinHashPlan) -> Column:
    """Whether the similarity can be reached, by bitmaps: sets differ in at least as many shingles as their bitmaps in bits."""
    differing = F.lit(0)
    for k in range(BITMAP // 64):
        differing = differing + F.bit_count(F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k]))
    return differing * (100 + plan.percent) <= (F.col(f"{a}.size") + F.col(f"{b}.size")) * (100 - plan.percent)


def reach_of(weight: Column, place: Column, plan: MinHashPlan) -> Column:
    """The largest set that one of size `weight` can be as similar to, if what they share stands at its place (from 0) or behind."""
    return F.floor(((weight - place) * (100 + plan.percent) - weight * plan.percent) / plan.percent)


def confirmed(pairs: DataFrame, sets: DataFrame, plan: MinHashPlan) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    one, two = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    both = F.size("set_a") + F.size("set_b") - shared
    return pairs.join(one, "a").join(two, "b").filter(shared * 100 >= both * plan.percent).select("a", "b")


def near_duplicates(docs: DataFrame, plan: MinHashPlan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included) and kept (it is that one), a row for each row."""
    plan = plan or MinHashPlan()
    settle(docs.sparkSession)
    sets = written(signatures(docs, plan, id_col, text_col), "signatures")
    full = sets.filter("n_shingles > 0 and doc_id is not null")
    # Equal sets are one node, named by its smallest document.
    classes = written(full.groupBy("set_hi", "set_lo", "n_shingles").agg(F.min("doc_id").alias("node")), "classes")
    nodes = written(full.join(classes.select(F.col("node").alias("doc_id"), "set_hi", "set_lo"), ["doc_id", "set_hi", "set_lo"], "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", "bands", "sketch"), "nodes")

    # Members of buckets beside the first, and the first of each. Sums go by key, so no task holds a bucket.
    keyed = nodes.select(F.explode("bands").alias("key"), "node")
    shared = written(keyed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), (F.count("*") > 2).alias("more")).filter("first != last").select("key", "first", "more"), "buckets")
    hits = written(keyed.join(shared.hint("shuffle_hash"), "key").filter("node != first"), "hits")  # a row for each key is held
    sweep(docs.sparkSession)
    members = hits.select("key", "node").union(shared.select("key", F.col("first").alias("node")))
    suspects = written(members.select("node").distinct(), "suspects")

    # Full sets of what shares a bucket: the only read of texts besides the signatures'.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    wanted = texts.join(suspects.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi").distinct()
    shingled = written(shingle_sets(wanted, plan).withColumn("size", F.size("shingles")).withColumnRenamed("doc_id", "node"), "sets")

    # Each member against the first of its bucket.
    sketched = nodes.join(suspects, "node", "left_semi").select("node", "n_shingles", "sketch")
    stars = hits.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    stars = written(stars.join(sketched.alias("x"), F.col("a") == F.col("x.node")).join(sketched.alias("y"), F.col("b") == F.col("y.node")).filter(possible("x", "y", plan)).select("a", "b"), "stars")
    links = written(confirmed(stars, shingled, plan), "links")
    found = components(links)

    # Pairs across components of a bucket.
    attributes = shingled.select("node", "size", "bits").join(sketched, "node")

    def sets_of(wide: DataFrame) -> DataFrame:
        least = F.floor((F.col("size") * plan.percent + 99) / 100)
        return shingled.join(wide, "node").select("node", "component", F.col("shingles").alias("elements"), (F.col("size") - least + 1).alias("prefix"), F.col("size").cast("long").alias("weight"))
    settle(docs.sparkSession)
    # The first of each bucket has been held against all others, so the other member of a bucket of two is settled.
    final = link_across(hits.filter("more").select("key", "node").withColumn("role", F.lit(0).cast("byte")), found, attributes, lambda x, y: possible(x, y, plan) & reachable(x, y, plan), sets_of, lambda pairs: confirmed(pairs, shingled, plan), "minhash", lambda weight, place: reach_of(weight, place, plan))
    free(nodes, shared, hits, suspects, shingled, stars, links)
    settle(docs.sparkSession)

    named = sets.select("doc_id", "n_shingles", "set_hi", "set_lo").join(classes, ["set_hi", "set_lo", "n_shingles"], "left")
    named = named.join(final.withColumnRenamed("id", "node"), "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
