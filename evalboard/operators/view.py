"""The ranked table: filter, sort, group, rank."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import contract as C
from ..functions.columns import haystack, missing_last, text, trained
from .ranking import numbered


@dataclass(frozen=True)
class ViewParams:
    sort: str = "acc_fs"
    ascending: bool = False
    query: str = ""
    access: str = "all"
    verified_only: bool = False

    def clicked(self, key: str) -> ViewParams:
        """After a click on a column: the same one turns round; another starts ascending if it is a name or lower is better."""
        if key not in C.SORT_KEYS:
            raise ValueError(f"no such column: {key}")
        if key == self.sort:
            return replace(self, ascending=not self.ascending)
        return replace(self, sort=key, ascending=key in ("model", "method", *C.LOWER_IS_BETTER))


def clicked_states(clicks: DataFrame, by: str, order: list[str], key: str = "key") -> DataFrame:
    """by, sort and ascending after each viewer's clicks on columns, in order, from the default view: the last column, turned round once for each click on it since another one. No viewer's clicks are gathered."""
    at = F.struct(*order)
    start = ViewParams()
    last = clicks.groupBy(by).agg(F.max_by(key, at).alias("sort"))
    placed = clicks.select(by, key, at.alias("_at")).join(last, by)
    since = placed.groupBy(by).agg(F.max(F.when(F.col(key) != F.col("sort"), F.col("_at"))).alias("_since"))
    run = placed.join(since, by).groupBy(by, "sort").agg(F.count_if(F.col("_since").isNull() | (F.col("_at") > F.col("_since"))).alias("_n"), F.bool_and(F.col("_since").isNull()).alias("_all"))
    first = F.col("sort").isin("model", "method", *C.LOWER_IS_BETTER)
    first = F.when(F.col("_all") & (F.col("sort") == start.sort), F.lit(not start.ascending)).otherwise(first)
    return run.select(by, "sort", (first == (F.col("_n") % 2 == 1)).alias("ascending"))


def is_baseline() -> Column:
    return F.col("type").eqNullSafe("baseline")


def shown(params: ViewParams) -> Column:
    """References pass the access and verified filters; the search holds for every row."""
    keep = F.lit(True)
    if params.access != "all":
        keep = keep & (is_baseline() | F.col("access").eqNullSafe(params.access))
    if params.verified_only:
        keep = keep & (is_baseline() | F.col("verified").eqNullSafe("yes"))
    if params.query:
        keep = keep & F.contains(haystack(F.col("model"), F.col("organization"), F.col("method")), F.lit(params.query.lower()))
    return keep


def group_ord() -> Column:
    """The place of a row's group; null for a type that has none."""
    model, music = F.col("type").eqNullSafe("model"), F.col("domain").eqNullSafe("music")
    return F.when(model & ~music & ~trained(F.col("method")), 0).when(model & ~music, 1).when(model & ~trained(F.col("method")), 2).when(model, 3).when(is_baseline(), 4)


def group_title(ord_: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in C.GROUPS]), ord_ + 1)


def display_order(params: ViewParams) -> list[Column]:
    """Numbers with the missing last in both directions, names by Unicode collation; then file order."""
    if params.sort in ("model", "method"):
        key = F.collate(text(F.col(params.sort)), "UNICODE")
        return [key.asc() if params.ascending else key.desc(), F.col("line").asc()]
    return [*missing_last(F.col(params.sort), params.ascending), F.col("line").asc()]


def _grouped(board: DataFrame, params: ViewParams, keep: Column) -> DataFrame:
    """The rows shown that are kept, with group_ord and group_title."""
    rows = board.filter(shown(params)).withColumn("group_ord", group_ord()).filter(F.col("group_ord").isNotNull() & keep)
    return rows.withColumn("group_title", group_title(F.col("group_ord")))


def rank_order(params: ViewParams) -> list[Column]:
    return [*missing_last(F.col("acc_fs"), False), *display_order(params)]


def ranked(board: DataFrame, params: ViewParams | None = None) -> DataFrame:
    """The rows shown, with group_ord, group_title and rank, unsorted.

    Ranks run from 1 in each group of models, by acc_fs from the highest, ties by display order, after filtering; references have none. A group may span any number of tasks.
    """
    params = params or ViewParams()
    rows = numbered(_grouped(board, params, F.lit(True)), ["group_ord"], rank_order(params))
    return rows.withColumn("rank", F.when(~is_baseline(), F.col("rank").cast("int")))


def placed(board: DataFrame, params: ViewParams | None = None, name: str = "place") -> DataFrame:
    """All rows with their place in display order, from 1."""
    return numbered(board, [], display_order(params or ViewParams()), name).withColumn(name, F.col(name).cast("int"))


def board_view(board: DataFrame, params: ViewParams | None = None) -> DataFrame:
    """The ranked rows as they are shown, group after group."""
    params = params or ViewParams()
    return ranked(board, params).orderBy("group_ord", *display_order(params))


def top_ranked(board: DataFrame, k: int, params: ViewParams | None = None) -> DataFrame:
    """The first k of each group of models. References are out before the window, so its limit is pushed below the shuffle: each task sends k rows of a group at most."""
    params = params or ViewParams()
    place = F.row_number().over(Window.partitionBy("group_ord").orderBy(*rank_order(params)))
    return _grouped(board, params, ~is_baseline()).withColumn("rank", place).filter(F.col("rank") <= k)


def header_stats(board: DataFrame) -> DataFrame:
    """Distinct model names and the latest date, before any filter."""
    models = board.filter("type = 'model'")
    return models.agg(F.count_distinct("model").alias("models"), F.coalesce(F.max(F.nullif(F.col("date").cast("string"), F.lit(""))), F.lit("—")).alias("updated"))


def chance_level(board: DataFrame) -> DataFrame:
    """One row: overall of the first reference whose name has "chance" in it, else the default."""
    found = board.filter(is_baseline() & F.contains(F.lower(text(F.col("model"))), F.lit("chance")))
    return found.agg(F.coalesce(F.min_by("overall", "line"), F.lit(C.DEFAULT_CHANCE)).alias("chance"))


def degenerate(board: DataFrame) -> DataFrame:
    """Models that answer one letter alone, or whose scores all equal a reference's."""
    vector = F.struct(*[F.col(c) for c in C.REQUIRED_PERCENT])
    known = board.filter(is_baseline()).select(vector.alias("_vector")).distinct()
    models = board.filter("type = 'model'").withColumn("_vector", vector)
    same = models.join(known.withColumn("_same", F.lit(True)), "_vector", "left")
    return same.filter(F.col("a_rate").isin(0.0, 100.0) | F.col("_same")).drop("_vector", "_same")
