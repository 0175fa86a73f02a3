"""The ranked table kept up to date by changes.

State is kept in parts: a group's ranked rows, and for the header, how many models have each name and each date, in hash buckets. A change names the rows that go and the rows that come (an edit is both). Only the groups and
buckets that hold one of them are read, merged with the change, ranked and written; the others stay where the version that wrote them has put them. A manifest names the version that holds each part and keeps the part's share of the
header (distinct names, latest date), so the header is a sum over parts. A version is seen when the pointer names it, whole or not at all.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import text
from ..sources.pointer import point, pointed
from .ranking import numbered
from .view import ViewParams, group_ord, group_title, is_baseline, rank_order

BUCKETS = 64
MANIFEST = "kind string, part int, held string, n long, high string"
VALUE = "kind string, value string, n long"


@dataclass(frozen=True)
class Merge:
    """What a change has touched, and the files of rows that it read."""

    version: str
    groups: tuple[int, ...]
    buckets: tuple[int, ...]
    read: tuple[str, ...]


class MaintainedView:
    def __init__(self, spark: SparkSession, folder: str, params: ViewParams | None = None):
        self.spark, self.folder, self.params = spark, folder.rstrip("/"), params or ViewParams()

    def version(self) -> str | None:
        return pointed(self.spark, f"{self.folder}/CURRENT")

    def manifest(self) -> DataFrame:
        """kind (rows or values), part, held (the version), n and high: a part's rows, or its distinct names and latest date."""
        version = self.version()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/{version}") if version else self.spark.createDataFrame([], MANIFEST)

    def _parts(self, kind: str) -> dict[int, str]:
        return {r["part"]: r["held"] for r in self.manifest().filter(F.col("kind") == kind).collect()}  # a row for each group or bucket

    def _paths(self, kind: str, wanted: set[int] | None = None) -> list[str]:
        return [f"{self.folder}/{kind}/{held}/part={part}" for part, held in sorted(self._parts(kind).items()) if wanted is None or part in wanted]

    def rows(self) -> DataFrame | None:
        """All ranked rows, unsorted; None before the first change."""
        paths = self._paths("rows")
        return self.spark.read.parquet(*paths) if paths else None

    def header(self) -> DataFrame:
        """Distinct model names and the latest date, from the manifest alone."""
        values = self.manifest().filter("kind = 'values'")
        return values.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("models"), F.coalesce(F.max("high"), F.lit("—")).alias("updated"))

    def apply(self, gone: DataFrame | None = None, come: DataFrame | None = None) -> Merge:
        """Merges a change: typed rows, `line` tells them apart; gone are as they were put in."""
        given = [x for x in (gone, come) if x is not None]
        if not given:
            raise ValueError("a change needs rows")
        version = f"v-{uuid.uuid4().hex[:12]}"
        grouped = [x.withColumn("group_ord", group_ord()) for x in given]
        groups = {r[0] for x in grouped for r in x.select("group_ord").distinct().collect() if r[0] is not None}  # one for each group
        read = self._merged_rows(version, grouped[0] if gone is not None else None, grouped[-1] if come is not None else None, groups)
        buckets = self._merged_values(version, gone, come)
        point(self.spark, f"{self.folder}/CURRENT", self._listed(version, groups, buckets))
        return Merge(version, tuple(sorted(groups)), tuple(sorted(buckets)), tuple(read))

    def _merged_rows(self, version: str, gone: DataFrame | None, come: DataFrame | None, groups: set[int]) -> list[str]:
        paths = self._paths("rows", groups)
        kept = self.spark.read.parquet(*paths) if paths else None
        read = kept.inputFiles() if kept is not None else []
        if kept is not None:
            kept = kept.drop("rank", "group_title")
            kept = kept.join(gone.select("line"), "line", "left_anti") if gone is not None else kept
        fresh = come.filter("group_ord is not null") if come is not None else None
        rows = fresh if kept is None else kept if fresh is None else kept.unionByName(fresh.select(*kept.columns))
        if rows is not None:
            ranked = numbered(rows.withColumn("group_title", group_title(F.col("group_ord"))), ["group_ord"], rank_order(self.params))
            ranked.withColumn("rank", F.when(~is_baseline(), F.col("rank").cast("int"))).withColumn("part", F.col("group_ord")).write.partitionBy("part").parquet(f"{self.folder}/rows/{version}")
        return read

    def _merged_values(self, version: str, gone: DataFrame | None, come: DataFrame | None) -> set[int]:
        change = None
        for rows, sign in ((gone, -1), (come, 1)):
            if rows is None:
                continue
            models = rows.filter("type = 'model'")
            values = models.select(F.lit("model").alias("kind"), text(F.col("model")).alias("value")).unionByName(models.filter(text(F.col("date").cast("string")) != "").select(F.lit("date").alias("kind"), F.col("date").cast("string").alias("value")))
            counted = values.groupBy("kind", "value").agg((F.count("*") * sign).alias("n"))
            change = counted if change is None else change.unionByName(counted)
        bucket = F.pmod(F.xxhash64("kind", "value"), F.lit(BUCKETS)).cast("int")
        touched = {r[0] for r in change.select(bucket).distinct().collect()}  # BUCKETS at most
        paths = self._paths("values", touched)
        merged = self.spark.read.schema(VALUE).parquet(*paths).unionByName(change) if paths else change
        left = merged.groupBy("kind", "value").agg(F.sum("n").alias("n")).filter("n > 0")
        left.withColumn("part", bucket).write.partitionBy("part").parquet(f"{self.folder}/values/{version}")
        return touched

    def _listed(self, version: str, groups: set[int], buckets: set[int]) -> str:
        """Writes the manifest."""
        touched = F.when(F.col("kind") == "rows", F.col("part").isin(sorted(groups) or [-1])).otherwise(F.col("part").isin(sorted(buckets) or [-1]))
        listed = self.manifest().filter(~touched)
        rows = self.spark.read.schema("group_ord int, part int").parquet(f"{self.folder}/rows/{version}") if self._written("rows", version) else None
        if rows is not None:
            listed = listed.unionByName(rows.groupBy("part").agg(F.count("*").alias("n")).select(F.lit("rows").alias("kind"), "part", F.lit(version).alias("held"), "n", F.lit(None).cast("string").alias("high")))
        if self._written("values", version):
            values = self.spark.read.schema(f"{VALUE}, part int").parquet(f"{self.folder}/values/{version}")
            shares = values.groupBy("part").agg(F.count_if(F.col("kind") == "model").alias("n"), F.max(F.when(F.col("kind") == "date", F.col("value"))).alias("high"))
            listed = listed.unionByName(shares.select(F.lit("values").alias("kind"), "part", F.lit(version).alias("held"), "n", "high"))
        listed.coalesce(1).write.parquet(f"{self.folder}/manifest/{version}")
        return version

    def _written(self, kind: str, version: str) -> bool:
        from ..sources.staged import path_of

        files, place = path_of(self.spark, f"{self.folder}/{kind}/{version}")
        return files.exists(place) and any("part=" in f.getPath().getName() for f in files.listStatus(place))
