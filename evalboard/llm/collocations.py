"""Phrase collocation mining: sketch, exact counts of candidates, thresholds.

1. Sketch. Each task hashes the phrases of its texts (one, two and three words) into cells and counts them; counts of cells are summed over tasks, block by block of 65536 cells, and cut at the threshold,
   so a cell's count is an upper bound of each of its phrases'. Cells that reach the threshold are kept as a bitmap. A phrase's bound is the least of its own and its parts', so longer phrases need no cells.
2. Counts. A phrase whose bound reaches the threshold is a candidate, and so at all of its places. Tasks count candidates by a 64-bit hash of language and words and pass each on with its count, by text; these are summed.
   Both steps are one pass over the texts each, whatever the number of candidates.
3. Thresholds on the exact counts, scores by integer arithmetic in 38 digits, and the first phrases of each language.

A false candidate costs a row that is dropped after the sums; a phrase over the threshold is always a candidate. What reaches the driver is the bitmap (a bit for each cell, 2**30 at most).
Two phrases that one task meets between two flushes share a hash with probability below 2**-26.

Defined cases: null and empty texts have no words; a null language is `und`; repeated rows count each time, ids are not read; long texts are read whole; ties in rank go to the more frequent phrase, then to the one
that sorts first by bytes; an empty table gives an empty result; columns other than text and language are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import Chunk, byte_class, chunks, mix, ngram_hashes
from .runtime import free, lean, workers_find_package, written

#: Fixed values: `[.,;:!?\x0A-\x0D]` separate pieces, space and tab separate words.
PIECE_END = byte_class(*[(ord(c), ord(c)) for c in ".,;:!?"], (0x0A, 0x0D))
WORD = ~(PIECE_END | byte_class((0x20, 0x20), (0x09, 0x09)))
UNKNOWN = "und"

BLOCK = 1 << 16
#: Text bytes for a cell; cells at least and at most.
BYTES_PER_CELL, LEAST_CELLS, MOST_CELLS = 32, 1 << 16, 1 << 30
#: Keys that a task gathers before it passes their counts on.
FLUSH = 1 << 22
#: Parts in which a block's counts are summed before they are summed up.
LOTS = 16
#: Bytes of text that are worked on at a time.
PIECE_BYTES = 1 << 21
#: Languages whose totals are broadcast; of more, Spark chooses the join.
MOST_LANGUAGES_SENT = 1 << 16
#: Candidates that a task counts before it passes their counts on.
REMEMBERED = 1 << 19
#: Tasks for each core in the scan whose tasks pass on every candidate they meet: longer tasks meet it again and pass on less.
TASKS_PER_CORE = 2


@dataclass(frozen=True)
class Collocations:
    """longest: words of a phrase; sketched: sizes that have cells; shard_chars: without effect, as candidates are counted in one pass; contained: percent of a phrase's count at which a longer one replaces it."""

    longest: int = 5
    least: int = 100
    sketched: tuple[int, ...] = (1, 2, 3)
    contained: int = 100
    first: int = 2000
    shard_chars: int = 1 << 22
    scale: int = 1000


def words_of(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of a lower-cased chunk: first byte, byte after the last, row, and a number that is the same for words of one piece only."""
    first, last, row = c.words(WORD)
    ends = np.concatenate([[0], np.cumsum(PIECE_END[c.data])])
    return first, last, row, ends[first] + row


def languages(column: pa.Array, c: Chunk) -> tuple[list[str], np.ndarray]:
    """The languages of a chunk's rows, and which each row has."""
    coded = column.slice(c.row, c.n).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def seeds(names: list[str]) -> np.ndarray:
    """A hash of each language."""
    if not names:
        return np.zeros(0, np.uint64)
    coded = [n.encode() + b"\n" for n in names]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int64)
    c = Chunk(0, np.frombuffer(b"".join(coded), np.uint8), offsets)
    return c.hashes(c.starts, c.ends)


def keyed(words: np.ndarray, piece: np.ndarray, seed: np.ndarray, n: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each phrase of n words with its language, and the index of its first word."""
    h, at = ngram_hashes(words, piece, n, at)
    return mix(h ^ seed[at] ^ np.uint64(n * 0x5851F42D4C957F2D & (1 << 64) - 1)), at


def cell(keys: np.ndarray, cells: int) -> np.ndarray:
    return (keys & np.uint64(cells - 1)).astype(np.uint32)


def blocks(cells: np.ndarray, counts: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, cells, counts) of sorted distinct cells; counts are cut at most."""
    kind = np.min_scalar_type(most)
    block = cells >> np.uint32(16)
    edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(cells) else np.zeros(1, np.int64)
    low, cut = (cells & np.uint32(BLOCK - 1)).astype(np.uint16), np.minimum(counts, most).astype(kind)
    n = len(edge) - 1
    packed = [pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((edge * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (low, cut)]
    yield pa.RecordBatch.from_arrays([pa.array(block[edge[:-1]].astype(np.int32)), *packed], ["block", "cells", "counts"])


_BLOCKS = "block int, cells binary, counts binary"


def merged(rows: DataFrame, by: list, n_parts: int, most: int, heavy_only: bool = False) -> DataFrame:
    """The rows of each block summed within what `by` deals out; heavy_only: those cells alone that reach the most."""
    kind = np.min_scalar_type(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                total = held.setdefault(block, np.zeros(BLOCK, np.uint32))
                at = np.frombuffer(cells, np.uint16)
                total[at] = np.minimum(total[at] + np.frombuffer(counts, kind), most)
        for block, total in held.items():
            at = np.flatnonzero(total >= (most if heavy_only else 1)).astype(np.uint32)
            if len(at):
                yield from blocks(at + np.uint32(block << 16), total[at], most)

    return rows.repartition(n_parts, *by).select("block", "cells", "counts").mapInArrow(lean(run), _BLOCKS)


def heavy_cells(texts: DataFrame, cells: int, plan: Collocations) -> np.ndarray:
    """A bit for each cell: whether its count reaches the threshold."""
    sizes, most = plan.sketched, plan.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for c in chunks(batch.column(1), PIECE_BYTES):
                c = c.lowered()
                first, last, row, piece = words_of(c)
                names, of = languages(batch.column(0), c)
                seed, words = seeds(names)[of[row]], c.hashes(first, last)
                for size in sizes:
                    keys, _ = keyed(words, piece, seed, size)
                    held.append(cell(keys, cells))
                    n += len(keys)
                if n >= FLUSH:
                    yield from blocks(*np.unique(np.concatenate(held), return_counts=True), most)
                    held, n = [], 0
        if n:
            yield from blocks(*np.unique(np.concatenate(held), return_counts=True), most)

    rows = texts.mapInArrow(lean(run), _BLOCKS)
    n_parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), cells // BLOCK // 64)
    lots = merged(rows, ["block", F.pmod(F.spark_partition_id(), F.lit(LOTS))], n_parts, most)
    bits = np.zeros(cells // 8, np.uint8)
    found = written(merged(lots, ["block"], n_parts, most, heavy_only=True).select("block", "cells"), "cells")  # else the driver would compute one partition after the other
    for block, at in found.toLocalIterator():  # one partition at a time; a bit for each cell is kept
        flags = np.zeros(BLOCK, bool)
        flags[np.frombuffer(at, np.uint16)] = True
        bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.packbits(flags, bitorder="little")
    free(found)
    return bits


def is_heavy(bits: np.ndarray, keys: np.ndarray, cells: int) -> np.ndarray:
    at = cell(keys, cells)
    return (bits[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8) & 1).astype(bool)


def likely(words: np.ndarray, piece: np.ndarray, seed: np.ndarray, bits: np.ndarray, cells: int, plan: Collocations) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size, the keys and first words of the phrases whose bound reaches the threshold."""
    shorter = np.ones(len(words) + 1, bool)
    for n in range(1, plan.longest + 1):
        at = np.flatnonzero(shorter[:-1] & shorter[1:]) if n > 1 else np.arange(len(words))
        keys, at = keyed(words, piece, seed, n, at)
        if n in plan.sketched:
            keep = is_heavy(bits, keys, cells)
            keys, at = keys[keep], at[keep]
        shorter = np.zeros(len(words) + 1, bool)
        shorter[at] = True
        yield n, keys, at


class Tally:
    """Counts of candidates by hash, with the language and text of each, in the order in which they were first met."""

    def __init__(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by key
        self.counts = np.zeros(0, np.int64)
        self.langs: list[str] = []
        self.phrases: list[bytes] = []

    def add(self, keys: np.ndarray, at: np.ndarray, text: Callable[[int], tuple[str, bytes]]) -> None:
        """keys of places `at`; text gives language and phrase of a place."""
        keys, index, n = np.unique(keys, return_index=True, return_counts=True)
        place = np.searchsorted(self.keys, keys)
        old = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        old[inside] = self.keys[place[inside]] == keys[inside]
        self.counts[self.slots[place[old]]] += n[old]
        new = ~old
        if new.any():
            slots = len(self.phrases) + np.arange(int(new.sum()))
            for i in at[index[new]].tolist():
                lang, phrase = text(i)
                self.langs.append(lang)
                self.phrases.append(phrase)
            self.counts = np.concatenate([self.counts, n[new]])
            self.slots = np.insert(self.slots, place[new], slots)
            self.keys = np.insert(self.keys, place[new], keys[new])

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.langs, pa.string()), pa.array(self.phrases, pa.binary()).cast(pa.string()), pa.array(self.counts)], ["lang", "phrase", "n"])


def phrase_counts(texts: DataFrame, bits: np.ndarray, cells: int, plan: Collocations) -> DataFrame:
    """lang, phrase and n, how often it occurs, of each phrase that reaches the threshold, and one row without a phrase for each language, with its number of words; written.

    Whether a phrase is a candidate depends on cells alone, so all of its places are counted or none is.
    """
    shipped = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, tallies, totals = shipped.value, [Tally() for _ in range(plan.longest)], {}
        for batch in batches:
            for c in chunks(batch.column(1), PIECE_BYTES):
                c = c.lowered()
                first, last, row, piece = words_of(c)
                names, of = languages(batch.column(0), c)
                lang = of[row]
                for name, n in zip(names, np.bincount(lang, minlength=len(names)).tolist(), strict=True):
                    totals[name] = totals.get(name, 0) + n
                for n, keys, at in likely(c.hashes(first, last), piece, seeds(names)[lang], heavy, cells, plan):
                    tallies[n - 1].add(keys, at, lambda i, n=n: (names[lang[i]], b" ".join([c.data[first[j] : last[j]].tobytes() for j in range(i, i + n)])))  # noqa: B023
                if sum(len(t.phrases) for t in tallies) > REMEMBERED:
                    yield from (t.rows() for t in tallies)
                    tallies = [Tally() for _ in range(plan.longest)]
        yield from (t.rows() for t in tallies)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], ["lang", "phrase", "n"])

    found = texts.mapInArrow(lean(run), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    out = written(found.filter((F.col("n") >= plan.least) | F.col("phrase").isNull()), "phrases")
    shipped.unpersist()
    return out


def guarded(c: Chunk, first: np.ndarray, last: np.ndarray, piece: np.ndarray) -> str:
    """The words with a space before and after each and a line end between pieces."""
    if not len(first):
        return ""
    lengths = last - first
    new = np.concatenate([[False], piece[1:] != piece[:-1]])
    begin = np.cumsum(np.where(new, 3, 1)) + np.cumsum(lengths) - lengths
    out = np.full(begin[-1] + lengths[-1] + 1, 0x20, np.uint8)
    step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(begin, lengths) + step] = c.data[np.repeat(first, lengths) + step]
    out[begin[new] - 2] = 0x0A
    return out.tobytes().decode("utf-8", "replace")


def scored(counts: DataFrame, totals: DataFrame, plan: Collocations) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score, from exact counts (lang, phrase, n) of phrases of one word or more and the words of each language (lang, total)."""
    of = counts.withColumn("w", F.split("phrase", " ", -1)).withColumn("size", F.size("w"))
    long = of.filter("size > 1").select("lang", "phrase", F.col("n").alias("a"), "w", "size")
    joined = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    cut = long.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    l, r = (counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)) for side, name in (("left", "l"), ("right", "r")))  # noqa: E741
    n_of = totals.select("lang", F.col("total").alias("n"))
    if n_of.count() <= MOST_LANGUAGES_SENT:
        n_of = F.broadcast(n_of)
    each = cut.join(l, ["lang", "left"]).join(r, ["lang", "right"]).join(n_of, "lang")
    big = {c: f"cast({c} as decimal(38, 0))" for c in ("a", "n", "l", "r")}
    each = each.withColumn("score", F.expr(f"({plan.scale}BD * {big['a']} * {big['n']}) div ({big['l']} * {big['r']})"))
    best = each.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    sizes = F.expr("filter(transform(sequence(0, size * size - 1), i -> struct(cast(floor(i / size) + 1 as int) as first, cast(i % size + 1 as int) as len)), x -> x.len > 1 and x.len < size and x.first + x.len <= size + 1)")
    inner = long.filter("size > 2").select("lang", "a", "w", F.explode(sizes).alias("x")).select("lang", joined(F.col("x.first"), F.col("x.len")).alias("phrase"), "a")
    within = inner.groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    kept = best.join(within, ["lang", "phrase"], "left").filter(F.col("outer").isNull() | (100 * F.col("outer") < plan.contained * F.col("a")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = kept.withColumn("rank", place).filter(F.col("rank") <= plan.first)  # Spark keeps so many rows of a task at most before it shuffles them
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, plan: Collocations | None = None, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The first phrases of each language by score."""
    plan = plan or Collocations()
    workers_find_package(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (max(size // BYTES_PER_CELL, 1) - 1).bit_length()))
    bits = heavy_cells(texts, cells, plan)
    longer = texts.coalesce(TASKS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism)
    found = phrase_counts(longer, bits, cells, plan)
    counts = found.filter("phrase is not null")
    totals = found.filter("phrase is null").select("lang", F.col("n").alias("total"))
    out = written(scored(counts, totals, plan), "collocations")
    free(found)
    return out
