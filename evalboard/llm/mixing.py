"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

Documents hang in a tree (say domain, language, source). A budget of tokens goes down the tree by weight; a child that cannot use its share (its subtree's supply times
the epochs allowed, without what lies below a weight of 0) leaves the rest to its siblings, by weight, and only what all of them leave goes to its parent's siblings.
Each leaf orders its documents anew in each epoch by a seeded hash, takes whole epochs while its budget lasts, and of the last epoch the documents that begin before the budget ends.

Leaves are cut by the hash of the first document left out. To find it, tokens are summed for each leaf and each of 4096 ranges of hashes, and only the range in which the budget ends is sorted,
so no task sees a whole leaf: the sums of one leaf are 4096 rows at most, whatever the input. Texts never pass a shuffle, but where Spark finds the table of leaves too large to broadcast.

Defined cases: null names are the name "?"; null and empty texts have no tokens and are taken if they come before the cut; a name without a weight has the default weight, and weight 0 takes nothing;
repeated rows have one hash and are taken or left together; an empty table gives an empty result; the columns of the input pass through, and `epoch`, `tokens` and the tree's names
take the place of columns so named; no other name of the input matters. A share is rounded down to whole tokens at each node.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import free, written

RANGE_DIGITS = 3


@dataclass(frozen=True)
class MixPlan:
    """levels: name of each level from the root down, and the SQL expression that gives it. weights: for each level, of its names. budget_percent: of all tokens supplied. epochs: how often a document may come at most."""

    levels: tuple[tuple[str, str], ...]
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    default_weight: int = 1
    budget_percent: int = 60
    epochs: int = 2
    seed: str = "mix"


def words_of(text: Column) -> Column:
    """Runs of anything but space and the controls 9 to 13."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_hash(seed: str, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), epoch.cast("string"), F.lit("|"), F.coalesce(key.cast("string"), F.lit("?"))).cast("binary"))


def shares(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent's names, name, weight over 0, cap, budget of the parent) with `share`: as by weight, but no more than cap, the rest among those below theirs."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ratio = F.col("cap") / F.col("weight")
    before = by.orderBy(ratio, name).rowsBetween(Window.unboundedPreceding, -1)
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # Tokens for a unit of weight, if all children before were full; the true level is the greatest of these.
    level = F.max("_level").over(every)
    return nodes.withColumn("_level", left.cast("double") / weight).withColumn("share", F.least("cap", F.floor(level * F.col("weight")).cast("long"))).drop("_level")


def leaf_budgets(supply: DataFrame, plan: MixPlan) -> DataFrame:
    """The tree's names and budget of each leaf; supply: the names and tokens of each leaf."""
    names = [n for n, _ in plan.levels]
    total = supply.agg((F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * plan.budget_percent / 100)).cast("long").alias("budget"))
    weights = {}
    for name in names:
        table = plan.weights.get(name, {})
        weights[name] = F.coalesce(*[F.when(F.col(name) == k, F.lit(w)) for k, w in table.items()], F.lit(plan.default_weight)).cast("long")
    usable = supply.filter(reduce(and_, [w > 0 for w in weights.values()]))
    given = total
    for depth, name in enumerate(names):
        parent = names[:depth]
        nodes = usable.groupBy(*parent, name).agg((F.sum("tokens") * plan.epochs).alias("cap")).withColumn("weight", weights[name])
        nodes = nodes.join(given, parent) if parent else nodes.join(F.broadcast(given))  # one row: the total
        given = shares(nodes, parent, name).select(*parent, name, F.col("share").alias("budget"))
    return given


def leaf_cuts(rows: DataFrame, plan: MixPlan, key: str) -> DataFrame:
    """The names, whole epochs and cut of each leaf; rows: names, key and tokens of each document."""
    names = [n for n, _ in plan.levels]
    supply = written(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "supply")
    budgets = leaf_budgets(supply, plan).join(supply, names)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("int")
    leaves = written(budgets.select(*names, whole.alias("whole"), (F.col("budget") - whole * F.col("tokens")).alias("rest")), "leaves")
    hashed = rows.join(leaves.filter("rest > 0"), names).withColumn("_hash", order_hash(plan.seed, F.col("whole"), F.col(key))).withColumn("_range", F.substring("_hash", 1, RANGE_DIGITS))
    hashed = written(hashed.select(*names, "rest", "_hash", "_range", "tokens"), "hashed")
    sums = hashed.groupBy(*names, "rest", "_range").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = sums.withColumn("_before", before).filter("_before < rest and _before + n >= rest").select(*names, "_range", "_before")
    running = F.coalesce(F.sum("tokens").over(Window.partitionBy(*names, "_range").orderBy("_hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = hashed.join(edge, [*names, "_range"]).withColumn("_at", F.col("_before") + running)
    cuts = inside.groupBy(*names, "_range").agg(F.min(F.when(F.col("_at") >= F.col("rest"), F.col("_hash"))).alias("cut"))
    # Where the budget ends with the range, all of the range is taken.
    cuts = cuts.select(*names, F.coalesce("cut", F.concat("_range", F.lit("g"))).alias("cut"))
    return written(leaves.join(cuts, names, "left").select(*names, "whole", "rest", F.when(F.col("rest") > 0, F.coalesce("cut", F.lit("g"))).otherwise(F.lit("")).alias("cut")), "cuts")


def mix(docs: DataFrame, plan: MixPlan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are taken, once for each epoch, with the tree's names, `tokens` and `epoch`."""
    # Columns and levels go by number inside, so that no name meets another.
    inner = replace(plan, levels=tuple((f"n{j}", e) for j, (_, e) in enumerate(plan.levels)), weights={f"n{j}": plan.weights.get(n, {}) for j, (n, _) in enumerate(plan.levels)})
    places = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], *[F.coalesce(F.expr(e).cast("string"), F.lit("?")).alias(n) for n, e in inner.levels])
    rows = written(base.select(places[id_col].alias("key"), *[n for n, _ in inner.levels], words_of(places[text_col]).alias("tokens")), "tokens")
    cuts = leaf_cuts(rows, inner, "key")
    free(rows)
    taken = base.join(cuts, [n for n, _ in inner.levels]).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    taken = taken.filter((F.col("epoch") < F.col("whole")) | (order_hash(plan.seed, F.col("epoch"), places[id_col]) < F.col("cut")))
    clash = {*[n for n, _ in plan.levels], "tokens", "epoch"}
    kept = [c.alias(name) for name, c in places.items() if name not in clash]
    return taken.select(*kept, *[F.col(f"n{j}").alias(n) for j, (n, _) in enumerate(plan.levels)], words_of(places[text_col]).alias("tokens"), F.col("epoch").cast("int").alias("epoch"))
