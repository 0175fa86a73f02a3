"""Repeated keys as records arrive, in any order.

A record is a repeat if an earlier line has its key. State keeps each key's least line; a later line is a repeat at once, and when a line arrives that is earlier than the least so far, that one turns out to be a repeat and is
reported then. Nothing that was reported is ever wrong, so the reports only grow, and when all records are in they are the batch check's.

Two steps, so that a frequent key is not one task's: keys are first salted by line, where most repeats are found; only the least lines of the salted groups go on to the second step. Spark keeps one such state in a query,
so each step is a query of its own, with a table between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import text
from ..operators.validate import KEY, key_digest

SALT = 16
STEP = "digest binary, line long, message string, sure boolean"
_STATE = "least long"


def _earliest(repeats_only: bool):
    """A step over groups: `sure` rows are repeats; the others, if they are passed on, the group's least lines so far."""

    def run(key: tuple, chunks: Iterator[Any], state: Any) -> Iterator[Any]:
        import pandas as pd

        digest = key[0]
        least, known, found, first = (state.get[0] if state.exists else None), None, [], None
        for rows in chunks:
            for line, message in zip(rows["line"], rows["message"], strict=True):
                known = message
                if least is None:
                    least = first = line
                elif line > least:
                    found.append((digest, line, message, True))
                elif line < least:
                    if repeats_only or first is not None:  # else an earlier call has passed it on, and the second step will see that it was not the first
                        found.append((digest, least, message, True))
                    least = first = line
        if first is not None:
            state.update((int(least),))
            if not repeats_only:
                found.append((digest, least, known, False))
        yield pd.DataFrame(found, columns=["digest", "line", "message", "sure"])

    return run


def salted_repeats(records: DataFrame, key: tuple[str, ...] = KEY, line: str = "line") -> DataFrame:
    """The first step, for a stream of raw records with their lines: digest, line, message and sure, to be written to a table that final_repeats() reads. State: a digest and 8 bytes for each key and salt."""
    columns = [text(F.col(c)) for c in key]
    message = F.concat(F.lit("the key stands in an earlier record: "), F.concat_ws(", ", *columns))
    rows = records.select(key_digest(columns).alias("digest"), F.col(line).cast("long").alias("line"), message.alias("message")).withColumn("salt", F.pmod(F.xxhash64("line"), F.lit(SALT)).cast("int"))
    return rows.groupBy("digest", "salt").applyInPandasWithState(_earliest(False), STEP, _STATE, "append", "NoTimeout")


def final_repeats(step: DataFrame) -> DataFrame:
    """line, rule and message of R23, from a stream of what the first step has written. A record that is delivered twice under one line is one record, though its report may come twice."""
    open_ = step.filter("not sure").groupBy("digest").applyInPandasWithState(_earliest(True), STEP, _STATE, "append", "NoTimeout")
    return step.filter("sure").unionByName(open_).select("line", F.lit("R23").alias("rule"), "message")
