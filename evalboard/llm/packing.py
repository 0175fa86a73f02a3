"""Hierarchical packing of token sequences into several context sizes.

Each document's tokens are cut into full windows of the longest context and a rest; rests are routed to tiers by the smallest context that holds
them, each tier's window takes one rest of its own tier and its gap is filled from shorter tiers, whole rests first and a cut one last.
So every window is full; what is left when a task ends goes into ever shorter windows. Context sizes are powers of two.

Step groups are balanced over the whole corpus: windows of all tasks, longest tier first, are dealt to the steps in turn. So no two steps differ by more than one window of the longest context, each has
its share of every tier, and none holds more than step_tokens. For that, only counts of windows by task and tier are summed up.

A task packs the rows it reads, in rounds of bounded size, and shares nothing with others: no texts or ids are shuffled, and a lost task is redone from its own input.
The pieces are written, so they keep their numbers.

Defined cases: null or empty text is a document of the end id alone; repeated rows are documents of their own; an empty table gives an empty result;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .runtime import lean, settle, workers_find_package, written


@dataclass(frozen=True)
class PackingPlan:
    """context: longest window; rests of round_tokens are packed together; steps hold step_tokens at most, which are two windows or more."""

    context: int = 1024
    step_tokens: int = 8192
    round_documents: int = 16_384
    round_tokens: int = 4_000_000


Piece = tuple[int, int, int]  # document, start, length


def pack_round(lengths: list[int], context: int) -> list[list[Piece]]:
    """Windows, each a list of pieces; the sum of a window's lengths is a power of two, context at most; each token lies in one piece."""
    windows: list[list[Piece]] = []
    rests: list[tuple[int, int, int]] = []  # length, document, start
    for doc, n in enumerate(lengths):
        full = n // context
        windows += [[(doc, i * context, context)] for i in range(full)]
        if n % context:
            rests.append((n % context, doc, full * context))
    rests.sort()
    while rests:
        n, doc, start = rests.pop()
        size = 1 << (n - 1).bit_length()
        window, gap = [(doc, start, n)], size - n
        while gap and rests:
            at = bisect_right(rests, (gap, 1 << 62, 0)) - 1
            if at >= 0:  # the longest that fits
                n, doc, start = rests.pop(at)
                window.append((doc, start, n))
                gap -= n
            else:  # cut the shortest
                n, doc, start = rests.pop(0)
                window.append((doc, start, gap))
                insort(rests, (n - gap, doc, start + gap))
                gap = 0
        if gap:
            windows += _halved(window)
        else:
            windows.append(window)
    return windows


def _halved(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces cut into windows of ever smaller powers of two, without a gap."""
    total, windows, queue = sum(n for _, _, n in pieces), [], list(reversed(pieces))
    while total:
        size = room = 1 << (total.bit_length() - 1)
        window = []
        while room:
            doc, start, n = queue.pop()
            if n > room:
                queue.append((doc, start + room, n - room))
                n = room
            window.append((doc, start, n))
            room -= n
        windows.append(window)
        total -= size
    return windows


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context long"
#: Which window of its size in its task a piece is in.
PLACE = "task long, nth long"


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, plan: PackingPlan | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence, the sequence's context size and its step; with_ids adds the ids as 32-bit little-endian bytes."""
    plan = plan or PackingPlan()
    workers_find_package(docs.sparkSession)
    settle(docs.sparkSession)
    if plan.step_tokens < 2 * plan.context:
        raise ValueError("a step must hold two windows")
    schema = f"{SCHEMA}, {PLACE}" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], encode.dtype).tobytes()
        sequence, made = 0, Counter()
        ids: list = []
        tokens: list[np.ndarray] = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal sequence
            out: dict[str, list] = {n: [] for n in names}
            windows = pack_round([len(t) for t in tokens], plan.context)
            for window in windows:
                offset, size = 0, sum(n for _, _, n in window)
                for doc, start, n in window:
                    body = tokens[doc][start : start + n].astype("<u4").tobytes()
                    for k, v in zip(names, (ids[doc], start, n, zlib.crc32(body), len(tokens[doc]), task << 32 | sequence, offset, size, task, made[size], body), strict=False):
                        out[k].append(v)
                    offset += n
                sequence += 1
                made[size] += 1
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()})

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part_of = batch.slice(at, 512)
                for doc, text in zip(part_of.column(0).to_pylist(), part_of.column(1).to_pylist(), strict=True):
                    ids.append(doc)
                    tokens.append(np.frombuffer(encode.ids(text or "") + end, encode.dtype))
                    held += len(tokens[-1])
                    if len(ids) >= plan.round_documents or held >= plan.round_tokens:
                        yield packed()
                        ids, tokens, held = [], [], 0
        if ids:
            yield packed()

    pieces = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema), "pieces")
    return with_steps(pieces, plan).select(*[x.split()[0] for x in SCHEMA.split(", ")], "step", *["ids"] * with_ids)


def with_steps(pieces: DataFrame, plan: PackingPlan) -> DataFrame:
    """pieces with the step that their window is dealt to."""
    counts = written(pieces.groupBy("context", "task").agg((F.max("nth") + 1).alias("n")), "windows")
    sums = counts.groupBy("context").agg(F.sum("n").alias("n")).collect()  # a row for each tier
    total, before, longer = sum(r["context"] * r["n"] for r in sums), 0, {}
    for r in sorted(sums, key=lambda r: -r["context"]):
        longer[r["context"]], before = before, before + r["n"]
    steps = max(1, -(-total // (plan.step_tokens - plan.context)))
    if not longer:
        return pieces.withColumn("step", F.lit(0).cast("long"))
    # A row for each task and tier.
    lower = F.coalesce(F.sum("n").over(Window.partitionBy("context").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.coalesce(*[F.when(F.col("context") == c, F.lit(n)) for c, n in longer.items()]) + lower
    return pieces.join(counts.select("context", "task", first.alias("first")), ["context", "task"]).withColumn("step", (F.col("first") + F.col("nth")) % steps)
