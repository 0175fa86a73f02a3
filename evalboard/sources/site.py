"""Versions of a document set: published whole or not at all, and built from what has changed.

A site is a folder. `objects` holds texts by their digest, each version's new ones in a folder of its own; `manifest` says for each version which path has which digest and which version holds it; `scans` keeps what a scan for
terms has found, by digest; the file CURRENT names the version that readers see. A build writes objects, scans and the manifest by tasks and then replaces CURRENT by one rename; until then readers see the old version, whatever
happens to the build. Objects of a build that ended early are in a folder that no manifest names.

A new version moves only what is new: a page whose digest the last version has is neither written nor scanned again. No text passes the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pointer import point, pointed
from .staged import path_of

OBJECT = "digest string, text string"
MANIFEST = "path string, size long, digest string, held string"
SCAN = "digest string, line int, term string, n int"


@dataclass(frozen=True)
class Build:
    """What a build did: pages in all, texts written, texts scanned, and leaks (path, line, term, n), or None without terms."""

    version: str
    pages: int
    written: int
    scanned: int
    leaks: DataFrame | None


class Site:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def current(self) -> str | None:
        """The version that readers see."""
        return pointed(self.spark, f"{self.folder}/CURRENT")

    def versions(self) -> list[str]:
        files, root = path_of(self.spark, f"{self.folder}/manifest")
        return sorted(f.getPath().getName() for f in files.listStatus(root)) if files.exists(root) else []

    def manifest(self, version: str | None = None) -> DataFrame:
        """path, size, digest and held (the version that wrote the text) of each page; of no page before the first build."""
        version = version or self.current()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/{version}") if version else self.spark.createDataFrame([], MANIFEST)

    def documents(self, version: str | None = None) -> DataFrame:
        """path and text of each page."""
        pages = self.manifest(version)
        held = [r["held"] for r in pages.select("held").distinct().collect()]  # a row for each version at most
        if not held:
            return self.spark.createDataFrame([], "path string, text string")
        texts = self.spark.read.schema(OBJECT).parquet(*[f"{self.folder}/objects/{v}" for v in held])
        return pages.join(texts, "digest").select("path", "text")

    def switch(self, version: str) -> None:
        """Makes a version the current one, by one rename; also an earlier one."""
        if version not in self.versions():
            raise ValueError(f"no such version: {version}")
        point(self.spark, f"{self.folder}/CURRENT", version)

    def build(self, docs: DataFrame, terms: list[str] | None = None) -> Build:
        """Writes the next version of (path, text), which nobody sees before switch(). A null text is an empty page; a path may stand once."""
        before, version = self.manifest(), f"{len(self.versions()):06d}-{uuid.uuid4().hex[:8]}"
        pages = docs.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
        known = before.select("digest", "held").distinct()
        new = pages.join(known, "digest", "left_anti").dropDuplicates(["digest"])
        new.select("digest", "text").write.parquet(f"{self.folder}/objects/{version}")
        listed = pages.select("path", F.octet_length("text").cast("long").alias("size"), "digest").join(known, "digest", "left")
        listed.select("path", "size", "digest", F.coalesce("held", F.lit(version)).alias("held")).write.parquet(f"{self.folder}/manifest/{version}")
        made = self.manifest(version)
        if made.count() != made.select("path").distinct().count():
            raise ValueError("a path stands twice")
        written = self.spark.read.schema(OBJECT).parquet(f"{self.folder}/objects/{version}").count()
        scanned, leaks = self._scan(version, terms) if terms else (0, None)
        return Build(version, made.count(), written, scanned, leaks)

    def publish(self, docs: DataFrame, terms: list[str] | None = None) -> Build:
        """Builds, and switches if no term is found; else the old version stays."""
        made = self.build(docs, terms)
        if made.leaks is None or made.leaks.isEmpty():
            self.switch(made.version)
        return made

    def _scan(self, version: str, terms: list[str]) -> tuple[int, DataFrame]:
        """Scans the texts of a version that no build has scanned for these terms."""
        from ..operators.terms import find_terms

        name = hashlib.sha256("\0".join(sorted(set(terms))).encode()).hexdigest()[:16]
        root = f"{self.folder}/scans/{name}"
        files, folder = path_of(self.spark, root)
        done = [f.getPath().toString() for f in files.listStatus(folder) if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "of/_SUCCESS"))] if files.exists(folder) else []
        seen = self.spark.read.schema("digest string").parquet(*[f"{d}/of" for d in done]) if done else self.spark.createDataFrame([], "digest string")
        pages = self.manifest(version)
        fresh = pages.select("digest", "held").distinct().join(seen, "digest", "left_anti")
        held = [r["held"] for r in fresh.select("held").distinct().collect()]  # a row for each version at most
        if held:
            texts = self.spark.read.schema(OBJECT).parquet(*[f"{self.folder}/objects/{v}" for v in held]).join(fresh.select("digest"), "digest", "left_semi")
            find_terms(texts, terms, "digest").write.parquet(f"{root}/{version}/leaks")
            fresh.select("digest").write.parquet(f"{root}/{version}/of")  # its _SUCCESS says that the leaks are whole
            done.append(f"{root}/{version}")
        n = self.spark.read.schema("digest string").parquet(f"{root}/{version}/of").count() if held else 0
        found = self.spark.read.schema(SCAN).parquet(*[f"{d}/leaks" for d in done]) if done else self.spark.createDataFrame([], SCAN)
        return n, pages.join(found, "digest").select("path", "line", "term", "n")
