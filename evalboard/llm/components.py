"""Connected components of an edge table, by alternating star steps on written tables, until all edges are stars. Nothing but one answer a round reaches the driver.

An edge with a null end is no edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import free, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours now hang on its smallest one."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours now hang on its smallest one."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the smallest id that it reaches) for each id that has an edge to another, written; an edge table may hold loops, repeats and both directions."""
    one, two = F.col(a), F.col(b)
    now = written(edges.select(F.greatest(one, two).alias("a"), F.least(one, two).alias("b")).filter(one.isNotNull() & two.isNotNull() & (one != two)).distinct(), "edges")
    while not _stars(now):
        before, now = now, written(_small_star(_large_star(now)), "edges")
        free(before)
    roots = now.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    out = written(now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots), "components")
    free(now)
    return out
