"""Quality rules by repetition coverage: characters inside duplicated n-grams and lines, from rolling hashes in numpy.

Every text is read whole, as bytes, in chunks; a task holds one Arrow batch and a chunk. No shuffle, no state between rows.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows each get their own, equal result;
an empty table gives an empty result; columns of the input other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import NOT_SPACE, Chunk, byte_class, chunks, covered, mix, ngram_hashes, repeated, repeats
from .runtime import lean, workers_find_package

SYMBOLS = byte_class(*((ord(c), ord(c)) for c in "#*$%&|<>"))


@dataclass(frozen=True)
class QualityRules:
    """Limits of the repetition rules: the largest share of a text's word characters in windows of n words that equal an earlier one, and in lines that do; symbols for each word."""

    min_words: int = 20
    base_window: int = 8
    base_percent: int = 30
    ngram_share: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    line_share: float = 0.20
    symbols_per_word: float = 0.10


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "dup_line_share double, dup_ngram_shares array<double>, reason string"
)


def _per_row(n: int, row: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.bincount(row, weights, n).astype(np.int64)


def measure(chunk: Chunk, rules: QualityRules) -> dict[str, np.ndarray]:
    """The columns of SCHEMA but the id, for the rows of a chunk."""
    first, last, row = chunk.words(NOT_SPACE)
    n, words = chunk.n, chunk.hashes(first, last)
    n_words = np.bincount(row, minlength=n)
    points = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum((chunk.data & 0xC0) != 0x80, out=points[1:])
    chars = points[last] - points[first]
    word_chars = _per_row(n, row, chars)
    n_symbols = chunk.counts(SYMBOLS[chunk.data])

    line_first, line_last, line_row = chunk.lines()
    word_at = np.searchsorted(first, line_first)
    with_word = word_at < np.searchsorted(first, line_last)
    line_first, line_last, line_row = line_first[with_word], line_last[with_word], line_row[with_word]
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))  # equal lines of two texts stay apart
    later = repeats(chunk.hashes(line_first, line_last) ^ salt[line_row])
    n_dup_lines = np.bincount(line_row[later], minlength=n)
    chars_to = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=chars_to[1:])
    line_chars = chars_to[np.searchsorted(first, line_last)] - chars_to[np.searchsorted(first, line_first)]
    per = np.maximum(word_chars, 1)
    line_share = _per_row(n, line_row[later], line_chars[later]) / per

    shares, n_repeat_words = {}, np.zeros(n, np.int64)
    at = None  # a window that occurs twice starts where a shorter one does
    for width in sorted({*rules.ngram_share, rules.base_window}):
        keys, at = ngram_hashes(words, row, width, at)
        keys = keys ^ salt[row[at]]
        many = repeated(keys)
        at, keys = at[many], keys[many]
        if width == rules.base_window:
            n_repeat_words = np.bincount(row[covered(len(words), at, width)], minlength=n)
        if width in rules.ngram_share:
            inside = covered(len(words), at[repeats(keys)], width)
            shares[width] = _per_row(n, row[inside], chars[inside]) / per

    reason = np.full(n, None, object)
    for name, failed in (
        ("few_words", n_words < rules.min_words),
        ("repeated_windows", 100 * n_repeat_words > rules.base_percent * n_words),
        ("duplicate_lines", line_share > rules.line_share),
        *((f"duplicate_{w}_grams", shares[w] > limit) for w, limit in sorted(rules.ngram_share.items())),
        ("symbols", n_symbols > rules.symbols_per_word * n_words),
    ):
        reason[failed & (reason == None)] = name  # noqa: E711
    base_failed = (n_words < rules.min_words) | (100 * n_repeat_words > rules.base_percent * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words, "base_failed": base_failed,
        "kept": reason == None, "dup_line_share": line_share, "dup_ngram_shares": np.stack([shares[w] for w in sorted(shares)], 1), "reason": reason,  # noqa: E711
    }


def repetition_quality(docs: DataFrame, rules: QualityRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts, shares of repeated characters, the first rule that fails (null if none) and the verdict.

    dup_ngram_shares has one share for each n-gram length of the rules, in ascending order of length.
    """
    rules = rules or QualityRules()
    workers_find_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                m = measure(c, rules)
                shares = m.pop("dup_ngram_shares")
                flat = pa.ListArray.from_arrays(np.arange(c.n + 1, dtype=np.int32) * shares.shape[1], pa.array(shares.ravel()))
                made = {"doc_id": batch.column(0).slice(c.row, c.n)} | {k: pa.array(v, pa.string()) if k == "reason" else pa.array(v.astype(np.int64) if v.dtype.kind == "i" else v.astype(bool) if v.dtype == object else v) for k, v in m.items()}
                made["dup_ngram_shares"] = flat
                yield pa.RecordBatch.from_pydict({k: made[k] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_share", "dup_ngram_shares", "reason")})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), SCHEMA)
