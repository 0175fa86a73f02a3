"""Sharding by fixed virtual slots.

A record hashes into one of a fixed number of slots; bytes are summed for each slot; a versioned map names the shard of each slot,
and rebalancing edits the map, moving as few slots as it needs. Versions of the map are stored, each once; records are placed by the version that was read from it.
The map and the sums have as many rows as there are slots, whatever the input's size; nothing else reaches the driver.

Defined cases: null text has no bytes and counts as its row's overhead only; null ids are hashed like any other value; repeated rows share a slot and get
places of their own; an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import scratch, written

SLOTS = 8192
OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """The shard of each slot."""

    version: int
    shards: tuple[int, ...]

    @classmethod
    def initial(cls, n_slots: int, n_shards: int) -> SlotMap:
        return cls(1, tuple(slot % n_shards for slot in range(n_slots)))

    @property
    def n_shards(self) -> int:
        return max(self.shards) + 1

    def rebalanced(self, weights: list[int], tolerance: float = 0.0001) -> SlotMap:
        """The next version: slots move from the heaviest shard to the lightest until their loads differ by less than tolerance of the mean, or no move helps."""
        n, shards = self.n_shards, list(self.shards)
        own: list[set[int]] = [set() for _ in range(n)]
        load = [0] * n
        for slot, shard in enumerate(shards):
            own[shard].add(slot)
            load[shard] += weights[slot]
        limit = tolerance * sum(load) / n
        for _ in range(len(shards) * 4):
            high, low = max(range(n), key=lambda s: (load[s], s)), min(range(n), key=lambda s: (load[s], s))
            gap = load[high] - load[low]
            fitting = [s for s in own[high] if 0 < weights[s] < gap]
            if gap <= limit or not fitting:
                break
            slot = min(fitting, key=lambda s: (abs(2 * weights[s] - gap), s))
            own[high].remove(slot)
            own[low].add(slot)
            shards[slot] = low
            load[high] -= weights[slot]
            load[low] += weights[slot]
        return SlotMap(self.version + 1, tuple(shards))

    def grown(self, weights: list[int] | None = None) -> SlotMap:
        """The next version, with one more shard that takes slots from the others, each from the heaviest; no slot moves between old shards."""
        n, shards = self.n_shards, list(self.shards)
        weights = weights or [1] * len(shards)
        own: list[list[int]] = [[] for _ in range(n)]
        for slot, shard in enumerate(shards):
            own[shard].append(slot)
        heap = [(-sum(weights[s] for s in x), shard) for shard, x in enumerate(own)]
        heapq.heapify(heap)
        goal, taken = sum(weights) / (n + 1), 0
        while heap:
            load, shard = heapq.heappop(heap)
            if not own[shard]:
                continue
            slot = own[shard].pop()
            if taken + weights[slot] > goal:
                break
            shards[slot] = n
            taken += weights[slot]
            heapq.heappush(heap, (load + weights[slot], shard))
        return SlotMap(self.version + 1, tuple(shards))

    def frame(self, spark: SparkSession) -> DataFrame:
        """version, virtual_slot, shard: the form in which versions are stored."""
        return spark.createDataFrame([(self.version, slot, shard) for slot, shard in enumerate(self.shards)], "version int, virtual_slot int, shard int")


def load_map(stored: DataFrame, version: int | None = None) -> SlotMap:
    """A stored version, the latest by default; its slots must be distinct and complete."""
    version = version or stored.agg(F.max("version")).first()[0]
    rows = stored.filter(F.col("version") == version).orderBy("virtual_slot").collect()  # as many rows as slots
    if not rows or [r["virtual_slot"] for r in rows] != list(range(len(rows))):
        raise ValueError(f"the stored map has not each slot once in version {version}")
    return SlotMap(version, tuple(r["shard"] for r in rows))


class MapStore:
    """The stored versions of a map: a folder at a path that all machines share, with a Parquet folder for each version, which is written once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, version: int) -> str:
        return f"{self.path}/version-{version:08d}"

    def versions(self) -> list[int]:
        """Versions that are whole, in order."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        files = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(top):
            return []
        found = [f.getPath() for f in files.listStatus(top) if f.getPath().getName().startswith("version-")]
        return sorted(int(p.getName().removeprefix("version-")) for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def append(self, slot_map: SlotMap) -> None:
        """Stores a version. One that is there already stays: the same again (a job that is repeated) is no fault, another map under its number is."""
        if slot_map.version in self.versions():
            if self.load(slot_map.version) != slot_map:
                raise ValueError(f"version {slot_map.version} is there with another map")
            return
        slot_map.frame(self.spark).coalesce(1).write.mode("overwrite").parquet(self._place(slot_map.version))  # what a broken job has left goes

    def empty(self) -> bool:
        return not self.versions()

    def load(self, version: int | None = None) -> SlotMap:
        """A version, the latest by default."""
        return load_map(self.spark.read.schema("version int, virtual_slot int, shard int").parquet(self._place(version or self.versions()[-1])))


def measured(docs: DataFrame, n_slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each record."""
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(body).cast("long") + OVERHEAD).alias("size"), F.crc32(body).alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(n_slots)).cast("int"))


def shard_by_slots(docs: DataFrame, n_shards: int, store: str | None = None, n_slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, SlotMap]:
    """Each record's shard and its place there, and the map that says so: the latest version in the store (an initial one is stored where there is none) after rebalancing by bytes, stored as the next if a slot has moved.

    A place is the number of records in the shard's lower slots, plus those of the slot in lower parts of the input, plus the record's rank among those of its slot and part;
    so no task sees more of one slot than a part of the input holds.
    """
    spark = docs.sparkSession
    maps = MapStore(spark, store or scratch(spark, "slot-map"))
    rows = written(measured(docs, n_slots, id_col, text_col).withColumn("part", F.spark_partition_id()), "slots")
    counted = written(rows.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "slot-parts")
    sums = counted.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()  # a row for each slot at most
    weights, counts = [0] * n_slots, [0] * n_slots
    for slot, size, n in sums:
        weights[slot], counts[slot] = size, n
    if maps.empty():
        maps.append(SlotMap.initial(n_slots, n_shards))
    current = maps.load()
    if (len(current.shards), current.n_shards) != (n_slots, n_shards):
        raise ValueError("the stored map has other slots or shards")
    moved = current.rebalanced(weights)
    if moved.shards != current.shards:
        maps.append(moved)
    slot_map = maps.load()
    base, filled = [0] * n_slots, [0] * n_shards
    for slot, shard in enumerate(slot_map.shards):
        base[slot] = filled[shard]
        filled[shard] += counts[slot]
    bases = spark.createDataFrame([(slot, slot_map.shards[slot], base[slot]) for slot in range(n_slots)], "virtual_slot int, shard int, base long")
    lower = F.coalesce(F.sum("n").over(Window.partitionBy("virtual_slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counted.select("virtual_slot", "part", lower.alias("lower"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "size", "text_crc32"))
    placed = rows.withColumn("rank", rank).join(parts, ["virtual_slot", "part"]).join(F.broadcast(bases), "virtual_slot")  # n_slots rows
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("lower") + F.col("rank") - 1).alias("slot"), "virtual_slot"), slot_map
