"""Language identification of mixed text: script ranges narrow the candidates, per-word scores judge them, and Viterbi with a switching penalty labels spans.

A model is two tables of log probabilities for each language: of byte trigrams (word ends included) and of whole words, both hashed to a fixed number of buckets.
It is fitted on a bounded sample of labelled rows (LanguageTraining.sample_documents for each language, drawn by hash of the id), so its size and
the driver's share do not grow with the input; every text is then labelled whole.

Viterbi runs over all words of a chunk at once: words are cut into segments, the best score from each entry state to each exit state of a segment is found
for all segments together, segments of a text are joined in order, and the paths are read back.

Defined cases: null text and text without a letter give `und` with score 0, as does everything where no row is labelled; repeated rows each get their own, equal result;
an empty table gives an empty result; other columns pass through, but those named as the result's are replaced. Letters without a script of their own (as in signs) are
labelled with the first language and score 0 where a text has no others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, Chunk, byte_class, chunks
from .runtime import lean, settle, workers_find_package

BUCKETS = 1 << 16

ASCII_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))
#: First code points of ranges and what they hold (blocks of Unicode); "" is no letter (punctuation, spaces, symbols, pictures).
RANGES = (
    (0x0000, ""), (0x0041, "latin"), (0x005B, ""), (0x0061, "latin"), (0x007B, ""), (0x00AA, "latin"), (0x00AB, ""), (0x00B5, "latin"), (0x00B6, ""), (0x00BA, "latin"), (0x00BB, ""),
    (0x00C0, "latin"), (0x00D7, ""), (0x00D8, "latin"), (0x00F7, ""), (0x00F8, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x08A0, "arabic"), (0x0900, "brahmic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, ""), (0x2070, "other"), (0x20A0, ""), (0x2100, "other"), (0x2190, ""), (0x2C00, "other"), (0x2E00, ""), (0x3005, "east_asian"), (0x3008, ""), (0x3021, "east_asian"),
    (0x3030, ""), (0x3031, "east_asian"), (0x3130, "hangul"), (0x3190, "east_asian"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "east_asian"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"), (0xFEFF, ""), (0xFF21, "latin"), (0xFF3B, ""), (0xFF41, "latin"), (0xFF5B, ""), (0xFF66, "east_asian"),
    (0xFFA0, "hangul"), (0xFFE0, ""), (0x10000, "other"), (0x1F000, ""), (0x20000, "east_asian"), (0x32000, "other"),
)
SCRIPTS = tuple(sorted({name for _, name in RANGES} - {""}))
_FIRST = np.array([low for low, _ in RANGES])
_SCRIPT = np.array([SCRIPTS.index(name) if name else -1 for _, name in RANGES], np.int8)
_ASCII_SCRIPT = _SCRIPT[np.searchsorted(_FIRST, np.arange(128), "right") - 1]


def scripts(data: np.ndarray) -> np.ndarray:
    """The script of the letter that each byte of UTF-8 belongs to, by its code point; -1 where it is no letter."""
    out = np.where(data < 0x80, _ASCII_SCRIPT[data & 0x7F], np.int8(-1))
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return out
    head = data[lead].astype(np.int64)
    more = 1 + (head >= 0xE0) + (head >= 0xF0)
    point = head & (0x3F >> more)
    for k in (1, 2, 3):
        has = more >= k
        point = np.where(has, point << 6 | (data[np.minimum(lead + k, len(data) - 1)] & 0x3F), point)
    of = _SCRIPT[np.searchsorted(_FIRST, point, "right") - 1]
    out[lead] = of
    for k in (1, 2, 3):
        at = lead[more >= k] + k
        inside = at < len(data)
        out[at[inside]] = of[more >= k][inside]
    return out


@dataclass(frozen=True)
class LanguageTraining:
    """sample_documents: bound of rows for each language. smoothing: added to each count. script_share: part of a language's words that a script needs to keep it a candidate."""

    sample_documents: int = 4000
    smoothing: float = 0.5
    script_share: float = 0.001


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    trigrams: np.ndarray  # bucket x language
    words: np.ndarray  # bucket x language
    candidates: np.ndarray  # script x language
    penalty: float = 8.0
    word_weight: float = 1.0
    word_limit: float = 6.0


def _lowered(c: Chunk) -> Chunk:
    """ASCII and Latin-1 letters in lower case."""
    data = LOWER[c.data]
    if len(data) > 1:
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[upper] += 0x20
    return Chunk(c.row, data, np.append(c.starts, c.ends[-1:]))


def features(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a lowered chunk: first, last and row of each word (a run of letters), its first letter's script, its bucket, and the trigram bucket at every byte (of the bytes around it, with 0 outside the word)."""
    script = scripts(c.data)
    letter = script >= 0
    first, last, row = c.runs(letter)
    inside = np.where(letter, c.data, 0).astype(np.uint32)
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[first], after[last - 1] = 0, 0
    trigram = (before << np.uint32(16)) | (inside << np.uint32(8)) | after
    trigram = (trigram * np.uint32(0x9E3779B1)) >> np.uint32(16)
    bucket = (c.hashes(first, last) >> np.uint64(48)).astype(np.int64)
    return first, last, row, script[first].astype(np.int64), bucket, trigram


def held_out(id_col: str = "doc_id") -> Column:
    """The documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, training: LanguageTraining | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model of the languages of the labelled rows given (all of which may be learned from)."""
    t = training or LanguageTraining()
    workers_find_package(docs.sparkSession)
    settle(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    counts = {lang: n for lang, n in rows.groupBy("lang").count().collect()}  # a row for each language
    languages = tuple(sorted(counts))
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS, 0)), np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS), 0), bool))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, t.sample_documents / n))) for lang, n in counts.items()])
    number = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(i)) for i, lang in enumerate(languages)])
    sample = rows.filter(place < share).select("text", number.cast("int").alias("lang"))
    n_langs = len(languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(k * n_langs, np.int64) for k in (BUCKETS, BUCKETS, len(SCRIPTS))]
        for batch in batches:
            langs = batch.column(1).to_numpy()
            for c in chunks(batch.column(0)):
                c = _lowered(c)
                first, last, row, script, bucket, trigram = features(c)
                lang = langs[c.row + row]
                per_byte = np.repeat(lang, last - first)
                at = np.repeat(first, last - first) + np.arange(int((last - first).sum())) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
                for table, keys, of in ((0, trigram[at], per_byte), (1, bucket, lang), (2, script, lang)):
                    tables[table] += np.bincount(keys.astype(np.int64) * n_langs + of, minlength=len(tables[table]))
        for k, table in enumerate(tables):
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(at), k)), "cell": pa.array(at), "n": pa.array(table[at])})

    summed = sample.mapInArrow(lean(count), "kind long, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).toArrow()  # at most buckets x languages x 2 rows
    kind, cell, n = (summed.column(k).to_numpy() for k in range(3))
    tables = []
    for k, size in enumerate((BUCKETS, BUCKETS, len(SCRIPTS))):
        table = np.zeros(size * n_langs)
        table[cell[kind == k]] = n[kind == k]
        tables.append(table.reshape(size, n_langs))
    logs = []
    for table in tables[:2]:
        p = np.log((table + t.smoothing) / (table.sum(0) + t.smoothing * BUCKETS))
        logs.append((p - p.mean(1, keepdims=True)).astype(np.float32))
    candidates = tables[2] / np.maximum(tables[2].sum(0), 1) >= t.script_share
    return LanguageModel(languages, logs[0], logs[1], candidates)


def word_scores(c: Chunk, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first, last, row and a score for each word and language; a word of a script that no language has says nothing."""
    first, last, row, script, bucket, trigram = features(c)
    scores = np.empty((len(first), len(model.languages)), np.float32)
    sums = np.zeros(len(trigram) + 1, np.float64)
    for k in range(len(model.languages)):
        np.cumsum(model.trigrams[:, k][trigram], out=sums[1:])
        scores[:, k] = sums[last] - sums[first]
    scores += model.word_weight * model.words[bucket]
    scores -= scores.max(1, keepdims=True) if len(scores) else 0
    np.maximum(scores, -model.word_limit, out=scores)
    possible = model.candidates[script]
    possible |= ~possible.any(1, keepdims=True)
    unknown = ~model.candidates.any(1)[script]
    scores[~possible] = -4 * model.word_limit
    scores[unknown] = 0
    return first, last, row, scores


def spans(row: np.ndarray, scores: np.ndarray, penalty: float, segment: int = 128) -> np.ndarray:
    """The language of each word on the path that maximises the sum of scores less a penalty for each change, for each row on its own; row ascends."""
    n, k = scores.shape
    out = np.zeros(n, np.int64)
    if not n or k < 2:
        return out
    row_start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    sizes = np.diff(np.append(row_start, n))
    per_row = -(-sizes // segment)
    seg_row = np.repeat(np.arange(len(sizes)), per_row)
    seg_no = np.arange(len(seg_row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = row_start[seg_row] + seg_no * segment
    length = np.minimum(segment, sizes[seg_row] - seg_no * segment)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    active = [int(np.searchsorted(-length, -t, "left")) for t in range(segment + 1)]  # segments longer than t
    p, s = np.float32(penalty), len(order)
    enter = np.where(np.eye(k, dtype=bool), np.float32(0), -p)
    pointer = np.min_scalar_type(-k)  # holds every state

    best = enter[None] + scores[start][:, None, :]  # segment, entry, state
    for t in range(1, int(length[0])):
        a = active[t]
        v = best[:a]
        np.maximum(v, v.max(2, keepdims=True) - p, out=v)
        v += scores[start[:a] + t][:, None, :]
    place = np.empty(s, np.int64)
    place[order] = np.arange(s)  # of each segment in row order

    first_seg = np.cumsum(per_row) - per_row
    by_size = np.argsort(-per_row, kind="stable")
    reached = np.zeros((len(sizes), k), np.float32)
    came = np.zeros((s, k), pointer)
    for j in range(int(per_row.max())):
        rows = by_size[: int(np.searchsorted(-per_row[by_size], -j, "left"))]
        at = place[first_seg[rows] + j]
        total = reached[rows][:, :, None] + best[at]
        came[at] = total.argmax(1)
        reached[rows] = total.max(1)
        reached[rows] -= reached[rows].max(1, keepdims=True)  # keeps long texts precise
    entry, leave = np.zeros(s, np.int64), np.zeros(s, np.int64)
    state = reached.argmax(1)
    for j in range(int(per_row.max()) - 1, -1, -1):
        rows = by_size[: int(np.searchsorted(-per_row[by_size], -j, "left"))]
        at = place[first_seg[rows] + j]
        leave[at] = state[rows]
        state[rows] = entry[at] = came[at, state[rows]]

    v = enter[entry] + scores[start]
    changed = np.zeros((segment, s, k), bool)
    source = np.zeros((segment, s), pointer)
    for t in range(1, int(length[0])):
        a = active[t]
        x = v[:a]
        top = x.argmax(1)
        jump = x[np.arange(a), top][:, None] - p
        changed[t, :a] = jump > x
        source[t, :a] = top
        np.maximum(x, jump, out=x)
        x += scores[start[:a] + t]
    state = leave
    for t in range(int(length[0]) - 1, -1, -1):
        a = active[t]
        now = state[:a]
        out[start[:a] + t] = now
        if t:
            state[:a] = np.where(changed[t, np.arange(a), now], source[t, :a], now)
    return out


def label_chunk(c: Chunk, model: LanguageModel) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """Language, score and spans of each row."""
    if not model.languages:
        return ["und"] * c.n, np.zeros(c.n), [[] for _ in range(c.n)]
    low = _lowered(c)
    first, last, row, scores = word_scores(low, model)
    label = spans(row, scores, model.penalty)
    k = len(model.languages)
    weight = np.bincount(row * k + label, last - first, c.n * k).reshape(c.n, k) if len(row) else np.zeros((c.n, k))
    total = weight.sum(1)
    best = weight.argmax(1)
    score = np.divide(weight.max(1), total, out=np.zeros(c.n), where=total > 0)
    ascii_letter = c.counts(ASCII_LETTER[c.data]) > 0
    pred = []
    for i in range(c.n):
        known = ascii_letter[i] or any(ch.isalpha() for ch in c.text(i).decode("utf-8", "replace"))
        pred.append(model.languages[best[i]] if known else "und")
        if not known:
            score[i] = 0.0
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (label[1:] != label[:-1])])) if len(row) else np.zeros(0, np.int64)
    found: list[list[dict]] = [[] for _ in range(c.n)]
    if len(row):
        for a, b in zip(new, np.append(new[1:], len(row)), strict=True):
            r = row[a]
            if pred[r] != "und":
                found[r].append({"lang": model.languages[label[a]], "first_byte": int(first[a] - c.starts[r]), "end_byte": int(last[b - 1] - c.starts[r])})
    return pred, score, found


SPAN = "array<struct<lang:string,first_byte:long,end_byte:long>>"


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """The columns of docs with lang_pred, score (the share of letters in spans of that language) and, with_spans, lang_spans. Only texts go to Python and only labels come back."""
    spark = docs.sparkSession
    workers_find_package(spark)
    shipped = spark.sparkContext.broadcast(model)  # two tables of fixed size for each language
    added = {"lang_pred": "string", "score": "double"} | ({"lang_spans": SPAN} if with_spans else {})
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_byte", pa.int64()), ("end_byte", pa.int64())]))
    limit = max(1, (1 << 19) // max(1, len(model.languages) ** 2 // 64))  # paths take space by the square of the languages

    def run(texts: pa.Array) -> pa.Array:
        held = shipped.value
        preds, scores, spans_of = [], [np.zeros(0)], []
        for c in chunks(texts, limit):
            pred, score, found = label_chunk(c, held)
            preds += pred
            scores.append(score)
            spans_of += found if with_spans else []
        columns = [pa.array(preds, pa.string()), pa.array(np.concatenate(scores))] + ([pa.array(spans_of, kind)] if with_spans else [])
        return pa.StructArray.from_arrays(columns, names=list(added))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    labels = F.arrow_udf(lean(run), ", ".join(f"{k} {v}" for k, v in added.items())).asNondeterministic()  # else a filter on a label would run it twice
    kept = [f"`{c}`" for c in docs.columns if c not in added]
    found = docs.select(*kept, labels(F.col(f"`{text_col}`")).alias("_found_labels"))
    return found.select(*kept, *[F.col("_found_labels")[k].alias(k) for k in added])
