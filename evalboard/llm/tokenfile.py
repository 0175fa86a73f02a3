"""Token files of patched frame-of-reference blocks.

A block holds up to 512 ids: the block's minimum is subtracted, the differences are packed at a width that fits a percentile of them, and the others
stand in an exception list with their place and value. A segment is a run of whole documents: its table of documents, an index of block starts, and the blocks.
Segments are rows of a Parquet table in ascending doc_id order; each knows its part and how many ids of that part stand before it,
so only one sum for each part is needed to place every document in the whole stream.

Documents are range-partitioned and sorted by id; a task streams its part and holds one segment.

Defined cases: null or empty text is the end id alone; null ids come first; repeated rows are documents of their own, in an order by text;
an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder
from .runtime import free, lean, scratch, workers_find_package, written

MAGIC, BLOCK = b"PFOR1\0\0\0", 512
_NO_ID = -(1 << 63)  # stands for a null doc_id
_WHOLE = (8, 16, 32)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 512 values under 2**width as rows of 8 * width 64-bit words."""
    if width in _WHOLE:  # little-endian integers of that width are packed already
        return np.ascontiguousarray(values.astype(f"<u{width // 8}")).view("<u8")
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    words = np.zeros((BLOCK * width // 64, len(values)), np.uint64)
    if not width:
        return words.T
    for i in range(BLOCK):
        at, shift = divmod(i * width, 64)
        words[at] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            words[at + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    if width in _WHOLE:
        return np.ascontiguousarray(words).view(f"<u{width // 8}").astype(np.uint32)
    columns, mask = np.ascontiguousarray(words.T), np.uint64((1 << width) - 1)
    values = np.zeros((BLOCK, len(words)), np.uint64)
    for i in range(BLOCK):
        at, shift = divmod(i * width, 64)
        v = columns[at] >> np.uint64(shift)
        if shift + width > 64:
            v = v | columns[at + 1] << np.uint64(64 - shift)
        values[i] = v & mask
    return np.ascontiguousarray(values.T).astype(np.uint32)


def pack_blocks(ids: np.ndarray, percentile: float = 0.98) -> tuple[np.ndarray, bytes]:
    """Byte offsets at which blocks start, and the blocks. A block: minimum (u32), width (u8), 0 (u8), exceptions (u16), packed words, places (u16), values (u32)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    v = np.empty(blocks * BLOCK, np.uint32)
    v[:n] = ids
    if blocks:
        v[n:] = v[n - 1]
    v = v.reshape(blocks, BLOCK)
    low = v.min(1) if blocks else np.zeros(0, np.uint32)
    v = v - low[:, None]
    rank = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    edge = np.partition(v, rank, axis=1)[:, rank] if blocks else low
    width = np.array([int(x).bit_length() for x in edge], np.int64)
    out: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        over = v[mine] >= np.uint64(1 << int(w))
        packed = _pack(np.where(over, 0, v[mine]), int(w))
        for k, b in enumerate(mine):
            places = np.flatnonzero(over[k]).astype("<u2")
            out[b] = struct.pack("<IBBH", low[b], w, 0, len(places)) + packed[k].astype("<u8").tobytes() + places.tobytes() + v[b][places].astype("<u4").tobytes()
    starts = np.concatenate([[0], np.cumsum([len(x) for x in out])[:-1]]) if blocks else np.zeros(0)
    return starts.astype("<u8"), b"".join(out)


def unpack_blocks(starts: np.ndarray, body: bytes, n: int) -> np.ndarray:
    """The n ids of pack_blocks()."""
    blocks = len(starts)
    heads = [struct.unpack_from("<IBBH", body, int(s)) for s in starts]
    low, width = np.array([h[0] for h in heads], np.uint32), np.array([h[1] for h in heads], np.int64)
    v = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        size = 8 * int(w)
        words = np.stack([np.frombuffer(body, "<u8", size, int(starts[b]) + 8) for b in mine])
        v[mine] = _unpack(words, int(w)) if w else 0
    for b, (_, w, _, exceptions) in enumerate(heads):
        if exceptions:
            at = int(starts[b]) + 8 + 64 * w
            v[b][np.frombuffer(body, "<u2", exceptions, at)] = np.frombuffer(body, "<u4", exceptions, at + 2 * exceptions)
    return (v + low[:, None]).ravel()[:n]


def write_segment(docs: list[int | None], lengths: list[int], ids: np.ndarray, percentile: float = 0.98) -> bytes:
    starts, body = pack_blocks(ids, percentile)
    table = np.array([_NO_ID if d is None else d for d in docs], "<i8").tobytes() + np.array(lengths, "<u8").tobytes()
    return MAGIC + struct.pack("<QQQ", len(docs), len(ids), len(starts)) + table + starts.tobytes() + body


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths, and all ids."""
    if data[:8] != MAGIC:
        raise ValueError("not a token segment")
    n_docs, n_ids, n_blocks = struct.unpack_from("<QQQ", data, 8)
    at = 32
    docs = np.frombuffer(data, "<i8", n_docs, at)
    lengths = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    starts = np.frombuffer(data, "<u8", n_blocks, at + 16 * n_docs)
    return [None if d == _NO_ID else d for d in docs.tolist()], lengths, unpack_blocks(starts, data[at + 16 * n_docs + 8 * n_blocks :], n_ids)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, percentile: float = 0.98, segment_ids: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Segments in ascending id order as a Parquet table: part, before (ids of the part that precede), n_ids, segment."""
    workers_find_package(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([encode.ids(text or "") + end for text in rows.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, part = encoder(tokenizer).dtype, TaskContext.get().partitionId()
        ids, lengths, bodies, before, held = [], [], [], 0, 0

        def segment() -> pa.RecordBatch:
            data = write_segment(ids, lengths, np.frombuffer(b"".join(bodies), kind), percentile)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([held], pa.int64()), "segment": pa.array([data], pa.binary())})

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                bodies.append(body)
                lengths.append(len(body) // kind.itemsize)
                held += lengths[-1]
                if held >= segment_ids:
                    yield segment()
                    before += held
                    ids, lengths, bodies, held = [], [], [], 0
        if ids:
            yield segment()

    # Texts stay where they are; ids are dealt out, two bytes each, by id and then by what tells rows of one id apart, so an id of many rows spans many tasks.
    table = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(encoded), "doc_id long, ids binary"), "encoded", "zstd")
    order = ["doc_id", "_hash", "_row"]
    rows = table.withColumns({"_hash": F.xxhash64("ids"), "_row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select("doc_id", "ids").mapInArrow(lean(run), "part long, before long, n_ids long, segment binary").write.option("compression", "zstd").parquet(path)
    free(table)


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document of a written token table: doc_id, start, n_tokens, ids_crc32; with_ids adds the ids as 32-bit little-endian bytes."""
    workers_find_package(spark)
    table = spark.read.schema("part long, before long, n_ids long, segment binary").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, lengths, ids = read_segment(batch.column(2)[i].as_buffer().to_pybytes())
                ends = np.cumsum(lengths)
                bodies = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends, lengths, strict=True)]
                made = {"part": pa.array(np.full(len(docs), batch.column(0)[i].as_py())), "doc_id": pa.array(docs, pa.int64()), "within": pa.array(ends - lengths + batch.column(1)[i].as_py()), "n_tokens": pa.array(lengths), "ids_crc32": pa.array([zlib.crc32(b) for b in bodies], pa.int64())}
                yield pa.RecordBatch.from_pydict(made | ({"ids": pa.array(bodies, pa.binary())} if with_ids else {}))

    sums = table.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each file part
    base, total = [], 0
    for part, n in sums:
        base.append((part, total))
        total += n
    bases = spark.createDataFrame(base, "part long, base long")
    rows = table.select("part", "before", "segment").mapInArrow(lean(run), "part long, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)  # bases: a row for each part


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Documents written in the file format and read back."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
