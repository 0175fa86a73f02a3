"""The contract as a list of rules, all checked in one scan. Every violation is a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contract as C
from ..functions.columns import among, blank, combined, decimal_text, differs, iso_date, mean, percent, text
from ..sources.board import CORRUPT, header_violation, read_board


@dataclass(frozen=True)
class Rule:
    """broken is true where a record violates the rule; null counts as not broken."""

    name: str
    broken: Column
    message: Column


def _rule(name: str, broken: Column, message: str | Column) -> Rule:
    return Rule(name, broken, F.lit(message) if isinstance(message, str) else message)


def rules() -> list[Rule]:
    """R01 to R22, in the order in which they are reported. Rules on several numbers hold only where all of them are valid."""
    model = F.col("type").eqNullSafe("model")
    v = {c: percent(F.col(c)) for c in C.PERCENT}
    average, derived = mean(*[v[t] for t in C.TASKS]), combined(v["miss_rate"], v["false_flip_rate"])
    found = [
        _rule("R01", ~among(F.col("type"), C.TYPES), F.concat(F.lit("type is baseline or model, not "), text(F.col("type")))),
        _rule("R02", ~among(F.col("verified"), C.VERIFIED), F.concat(F.lit("verified is no or yes, not "), text(F.col("verified")))),
        _rule("R03", blank(F.col("model")), "model is empty"),
        *[_rule(f"R{4 + i:02d}", v[c].isNull(), f"{c} is not a percentage from 0 to 100") for i, c in enumerate(C.REQUIRED_PERCENT)],
        _rule("R12", (text(F.col("a_rate")) != "") & v["a_rate"].isNull(), "a_rate is not a percentage from 0 to 100"),
        _rule("R13", differs(average, v["overall"], C.TOLERANCE), F.format_string("overall is %.1f but the tasks' mean is %.2f", v["overall"], average)),
        _rule("R14", differs(derived, v["acc_fs"], C.TOLERANCE), F.format_string("acc_fs is %.1f but 100 - (miss_rate + false_flip_rate) / 2 is %.2f", v["acc_fs"], derived)),
        _rule("R15", model & ~among(F.col("access"), C.ACCESS), "access is open or closed"),
        _rule("R16", model & ~among(F.col("domain"), C.DOMAIN), "domain is general or music"),
        _rule("R17", model & ~among(F.col("readout"), C.READOUT), "readout is logprob or generated"),
        _rule("R18", model & blank(F.col("method")), "method is empty"),
        _rule("R19", model & (text(F.col("params_b")) != "") & ~decimal_text(text(F.col("params_b"))), "params_b is a number of billions or empty"),
        _rule("R20", model & (text(F.col("source_url")) == "") & F.col("verified").eqNullSafe("no"), "a self-reported result has no source_url"),
        _rule("R21", iso_date(text(F.col("date"))).isNull(), "date is not yyyy-MM-dd"),
        _rule("R22", ~among(F.col("benchmark_version"), C.VERSIONS), "benchmark_version is unknown"),
    ]
    return found


KEY = ("model", "method", "benchmark_version")


def key_digest(columns: list[Column]) -> Column:
    """32 bytes that stand for a key, however long its parts are; lengths keep parts apart."""
    parts = [F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def with_repeats(rows: DataFrame, key: tuple[str, ...] = KEY, line: str = "line") -> DataFrame:
    """rows and `_again`: an earlier record has the same key, untrimmed and case-sensitive. First lines are found by a combining aggregate over digests of keys, so a frequent key does not gather in a task and long keys are not shuffled for it."""
    keyed = rows.withColumn("_digest", key_digest([text(F.col(c)) for c in key]))
    firsts = keyed.groupBy("_digest").agg(F.min(line).alias("_first"))
    return keyed.join(firsts, "_digest").withColumn("_again", F.col(line) > F.col("_first")).drop("_digest", "_first")


def repeat_rule(key: tuple[str, ...] = KEY) -> Rule:
    """R23, for rows with `_again`."""
    return _rule("R23", F.col("_again"), F.concat(F.lit("the key stands in an earlier record: "), F.concat_ws(", ", *[text(F.col(c)) for c in key])))


def broken_rules(rows: DataFrame, checked: list[Rule], keys: list[str]) -> DataFrame:
    """keys, rule and message of every violation, and `ord`, the rule's place; one scan, whatever the number of rules."""
    marks = [F.when(r.broken, F.struct(F.lit(i).alias("ord"), F.lit(r.name).alias("rule"), r.message.alias("message"))) for i, r in enumerate(checked)]
    return rows.select(*keys, F.explode(F.array_compact(F.array(*marks))).alias("v")).select(*keys, "v.*")


def violations(rows: DataFrame) -> DataFrame:
    """line, ord, rule and message of each violation of R01 to R23."""
    return broken_rules(with_repeats(rows), [*rules(), repeat_rule()], ["line"])


def validate(spark: SparkSession, path: str) -> DataFrame:
    """line, rule and message in the order of report; wrong headers are the only violations that are then reported."""
    header = header_violation(spark, path)
    if not header.isEmpty():
        return header
    return violations(read_board(spark, path)).orderBy("line", "ord").select("line", "rule", "message")


def misshapen(rows: DataFrame) -> DataFrame:
    """line and message of records with too few or too many cells, of rows read with them. That is no violation by itself: what lacks breaks its own rule, what is too much is not looked at."""
    return rows.filter(F.col(CORRUPT).isNotNull()).select("line", F.concat(F.lit(f"the record has not {len(C.COLUMNS)} cells: "), F.col(CORRUPT)).alias("message")).orderBy("line")


def annotations(found: DataFrame, file: str, kind: str = "error") -> DataFrame:
    """As lines of a continuous-integration log."""
    return found.select(F.format_string("::%s file=%s,line=%d::%s", F.lit(kind), F.lit(file), F.col("line"), F.col("message")).alias("annotation"))


def exit_code(found: DataFrame) -> int:
    return 0 if found.isEmpty() else 1
