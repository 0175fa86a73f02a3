"""Occurrences of many terms in one pass: an automaton over all of them, in any case.

A term is found as a case-insensitive search for its characters would find it (long s for s, the Kelvin sign for k, final sigma and so on); occurrences of one term do not overlap, those of different terms may, and a term may hold line ends.
Terms are dealt into shards of bounded size, by hash if they come as a table; a shard is one automaton with failure links, and one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the terms of one automaton.
SHARD_CHARS = 1 << 22


def fold_table() -> dict[int, str]:
    """A character for each that is another one's case: those with the same lower-case letter, and lower-case letters with the same upper case, are one. Every character stays one, so places hold."""
    classes: dict[str, str] = {}
    table = {}
    for i in range(0x1E944):  # no cased letters lie beyond
        c = chr(i)
        low = c.lower()[0]
        if c.isascii() and low == c and not c.isalpha():
            continue
        if low != c or low.upper() != low:
            put = classes.setdefault(low.upper(), low)
            if put != c:
                table[i] = put
    return table


def find_terms(docs: DataFrame, terms: list[str] | DataFrame, name: str = "path", body: str = "text") -> DataFrame:
    """name, line (from 1, where the occurrence begins), term and n: how often each term begins in each line. terms: a list, or a table whose first column they are; empty and null ones are left out."""
    if isinstance(terms, DataFrame):
        wanted = terms.select(F.col(terms.columns[0]).cast("string").alias("term")).filter("term <> ''").distinct()
        chars = wanted.agg(F.coalesce(F.sum(F.char_length("term")), F.lit(0))).first()[0]
        n_shards = -(-chars // SHARD_CHARS)
        shards = ([r["term"] for r in wanted.filter(F.pmod(F.xxhash64("term"), F.lit(n_shards)) == i).toLocalIterator()] for i in range(n_shards))  # SHARD_CHARS characters or so at a time
    else:
        wanted = sorted({t for t in terms if t})
        shards = [wanted] if wanted else []
    out = None
    for shard in shards:
        found = _scan(docs, shard, name, body)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.select(F.col(name), F.lit(1).alias("line"), F.lit("").alias("term"), F.lit(0).alias("n")).limit(0)


def _scan(docs: DataFrame, shard: list[str], name: str, body: str) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast((shard, fold_table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect

        import ahocorasick

        listed, table = shipped.value
        fold = lambda s: s.lower() if s.isascii() else s.translate(table)
        of: dict[str, list[str]] = {}
        for term in listed:
            of.setdefault(fold(term), []).append(term)
        machine = ahocorasick.Automaton()
        for folded in of:
            machine.add_word(folded, folded)
        machine.make_automaton()
        for batch in batches:
            names, lines, terms, counts = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                free: dict[str, int] = {}  # where a term's next occurrence may begin
                hits: dict[tuple[int, str], int] = {}
                ends = None
                for last, folded in machine.iter(fold(text)):
                    begin = last - len(folded) + 1
                    if begin < free.get(folded, 0):
                        continue
                    free[folded] = last + 1
                    if ends is None:
                        ends = [k for k, c in enumerate(text) if c == "\n"]
                    at = (bisect.bisect_left(ends, begin) + 1, folded)
                    hits[at] = hits.get(at, 0) + 1
                for (line, folded), n in hits.items():
                    for term in of[folded]:
                        names.append(i)
                        lines.append(line)
                        terms.append(term)
                        counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(names, pa.int64())), pa.array(lines, pa.int32()), pa.array(terms, pa.string()), pa.array(counts, pa.int32())], [name, "line", "term", "n"])

    texts = docs.select(name, body)
    kind = texts.schema[name].dataType.simpleString()
    return texts.mapInArrow(run, f"`{name}` {kind}, line int, term string, n int")
