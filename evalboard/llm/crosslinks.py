"""Links across components that share a key, without all pairs of a group.

Some links are known, so members of a key fall into components, and only pairs across components are still of interest. First each member outside the key's largest component is held against a few of
that one's members, in rounds: those that share most keys with others, as copies with few changes do, of random parts of the members. That joins most of what belongs together. Then each is held against all members of the largest component, and the others against one another,
if the others are few (DIRECT). Keys with more of them, such as those of boilerplate that many unlike texts share, are given up and their members are keyed anew by a rare-element prefix:
elements are put in one order for all sets, rarest first, and two sets that can share enough must share one of the first elements of both (prefix filter).
So no pair is lost, and unlike members of a large group meet only where they share something rare. What two sets share stands at or behind their first common element in both, so with sizes a place in the order
bounds the sizes a partner may have (positional filter); members that no other of their key can be linked with go before any meet.

The order goes by counts of elements in 2**20 buckets of their hashes, a table of fixed size; counts that are only roughly right make longer lists, not other results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import mix
from .runtime import free, lean, sweep, workers_find_package, written

#: Members of a key outside its largest component that are held against all others directly.
DIRECT = 32
#: Members of the largest component that all others are held against in a round, and the rounds.
SAMPLES, ROUNDS = 8, 1
BUCKET_BITS = 20


def rare_keys(sets: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """key, node and place (from 0), a row for each of the `prefix` rarest elements of a set, with the columns `carried` (longs of a set), so that none is joined on afterwards, a row for each element; sets: node, elements (distinct 64-bit hashes) and prefix, a written table."""
    spark = sets.sparkSession
    workers_find_package(spark)
    shift = np.uint64(64 - BUCKET_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            of = batch.column(0).flatten().to_numpy().view(np.uint64)
            total += np.bincount((mix(of) >> shift).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "n": pa.array(total[at])})

    counted = sets.select("elements").mapInArrow(lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # 2**20 rows at most
    frequency = np.zeros(1 << BUCKET_BITS, np.int64)
    frequency[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    shipped = spark.sparkContext.broadcast(np.minimum(frequency, (1 << 32) - 1).astype(np.uint32))  # 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes = np.diff(part.column(1).offsets.to_numpy())
                of = part.column(1).flatten().to_numpy().view(np.uint64)
                row = np.repeat(np.arange(len(sizes)), sizes)
                spread = mix(of)
                order = np.lexsort((spread, often[(spread >> shift).astype(np.int64)], row))
                place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                taken = place < part.column(2).to_numpy()[row]  # the order keeps rows together, so row holds after it too
                of_set = pa.array(row[taken])
                yield pa.RecordBatch.from_pydict({"key": pa.array(spread[order[taken]].view(np.int64)), "node": part.column(0).take(of_set), "place": pa.array(place[taken]), **{c: part.column(3 + k).take(of_set) for k, c in enumerate(carried)}})

    return sets.select("node", "elements", F.col("prefix").cast("long"), *carried).mapInArrow(lean(run), ", ".join(f"{c} long" for c in ("key", "node", "place", *carried)))


def within_reach(keyed: DataFrame) -> DataFrame:
    """The members of keys whose smallest member is not beyond their reach; keyed: key, weight (a set's size) and reach (the largest weight of a set that this may be its first common element with), a written table."""
    return keyed.join(keyed.groupBy("key").agg(F.min("weight").alias("least")), "key").filter("least <= reach").drop("least")


def sampled_pairs(open_rows: DataFrame, degree: DataFrame, turn: int) -> DataFrame:
    """a and b: each node outside of its key's main component and SAMPLES of that one's members at most, those of one of the keys that it shares with the component."""
    lot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(SAMPLES))
    central = open_rows.filter("component = main").join(degree, "node").groupBy("key", lot).agg(F.max_by("node", F.struct("degree", "node")).alias("central")).select("key", "central")
    one = open_rows.filter("component != main").groupBy("node", "main").agg(F.min("key").alias("key"))
    return one.join(central, "key").select(F.col("node").alias("a"), F.col("central").alias("b")).distinct()


def _open(members: DataFrame) -> DataFrame:
    """The members of keys with more than one component, the key's largest component (main) and how many members are outside it (others)."""
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("others"))
    return members.join(main.filter("others > 0"), "key")


def link_across(members: DataFrame, found: DataFrame, attributes: DataFrame, near: Callable[[str, str], Column], sets_of: Callable[[DataFrame], DataFrame], verified: Callable[[DataFrame], DataFrame], name: str, reach: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """id and component, written: the components `found`, joined by all links between nodes that share a key.

    members: key, node and role (two of role 1 do not meet); a member that has been held against all others of its key may be left out. attributes: by node, what `near` needs, a condition on the aliases of two rows with them, which says whether a pair can be
    linked. verified: the pairs (a, b) of those given that are linked. sets_of: node, component (as given), elements and prefix of each of the nodes given, and with `reach` its size as weight; reach: of a weight and a place, the largest weight of a set that can be linked if the first common element stands there.
    """

    def labelled() -> DataFrame:
        rows = written(_open(members.join(found.withColumnRenamed("id", "node"), "node", "left").select("key", "node", "role", F.coalesce("component", "node").alias("component"))), f"{name}-open", "zstd")
        sweep(members.sparkSession)
        return rows

    def joined(pairs: DataFrame) -> DataFrame:
        links = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
        return components(links.union(verified(pairs)))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    degree = written(members.groupBy("node").agg(F.count("*").alias("degree")), f"{name}-degree")
    x, y = attributes.alias("x"), attributes.alias("y")
    for turn in range(ROUNDS):
        open_rows = labelled()
        if open_rows.isEmpty():
            free(open_rows, degree)
            return found
        pairs = sampled_pairs(open_rows, degree, turn)
        sampled = written(ordered(pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).filter(near("x", "y"))).distinct(), f"{name}-sampled")
        sweep(members.sparkSession)
        before, found = found, joined(sampled)
        free(open_rows, sampled, before)
        sweep(members.sparkSession)

    open_rows = labelled()
    temporary, meeting = [open_rows], [open_rows.filter(F.col("others") <= DIRECT)]
    wide = open_rows.filter(F.col("others") > DIRECT)
    if not wide.isEmpty():
        nodes = written(wide.select("node", "component").distinct(), f"{name}-wide")
        sets = written(sets_of(nodes), f"{name}-sets", "zstd")
        sweep(members.sparkSession)
        keyed, carried = rare_keys(sets, ("component", "weight") if reach else ("component",)).withColumn("role", F.lit(0).cast("byte")), []
        if reach:
            keyed, carried = written(keyed.withColumn("reach", reach(F.col("weight"), F.col("place"))), f"{name}-keyed", "zstd"), ["weight", "reach"]
            temporary.append(keyed)
            keyed = within_reach(keyed)
        meeting.append(written(_open(keyed).select(*open_rows.columns, *carried), f"{name}-rare", "zstd"))
        free(nodes, sets)
        temporary.append(meeting[-1])
        sweep(members.sparkSession)
    crossing = []
    for rows in meeting:  # one after the other, as each needs disk
        full = written(rows.join(attributes, "node"), f"{name}-members", "zstd")
        sweep(members.sparkSession)
        apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
        far = (F.col("x.weight") <= F.col("y.reach")) & (F.col("y.weight") <= F.col("x.reach")) if "reach" in full.columns else F.lit(True)
        x, y = full.filter("component != main").alias("x"), full.alias("y")
        crossing.append(written(ordered(x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.role") + F.col("y.role") < 2) & apart & far & near("x", "y"))).distinct(), f"{name}-across"))
        free(full)
        sweep(members.sparkSession)
    across = reduce(DataFrame.union, crossing).distinct()
    out = joined(across)
    free(*temporary, *crossing, found, degree)
    return out
