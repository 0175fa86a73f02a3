"""Line deduplication by a segment-partition edit join.

Two lines are alike if they differ by few insertions, deletions and substitutions: of UTF-8 bytes (`edits` at most), or, with words_per_edit, of words where both lines have min_words or more:
one word for each words_per_edit words of the shorter line, MOST_EDITS at most. So the threshold grows with the line, and one replaced word is one edit however long it is.

By bytes, each line is split into edits + 1 segments; any line within reach holds one of them unchanged, near its place. Segments are indexed by length of line, number and content; a line probes
with the substrings that may meet a segment of a line as long as itself or up to `edits` shorter (the multi-match-aware selection, which is complete). Probes grow with the cube of the edits, so
the segments of lines that are compared by words are cut by content instead: the smallest hash of ANCHOR words in every window of places, narrow enough that any run which so many edits
must leave unchanged holds one. This is complete too. Candidates are verified by banded bit-parallel edit distance, many pairs at once. Alike lines form components; all but the first occurrence of each go.

Equal lines are one node. Keys travel packed, many in a row, by ranges of the key; each member of a key is paired with one segment of it (its first), and a range that holds very many members lets
those that are paired go, so no task holds a key of any size. Each carries a sketch of its line; in keys of bounded size all pairs that sketches allow are made, and those few are verified. Verified links are joined to components, and then only pairs across components of large keys are left (crosslinks: large keys of unlike lines are parted by their rarest words), so groups of alike lines are never paired in full. Pairs whose bitmaps
differ in more than the edits can explain are not made.

A node is a 62-bit hash of its line: among n distinct lines, two share one with probability n**2 / 2**63.

Defined cases: lines shorter than min_bytes are outside the edit join: with equal_short, those that are not blank go if an equal one stands earlier, else they stay; blank lines stay, and so do
null and empty texts; the first occurrence is that of the smallest doc_id (null first), then the smallest line number, then the smallest hash of its text; rows equal in id and text
stand at one place, so both keep their lines; an empty table gives an empty result; columns other than the id and the text pass through, whatever their names. Runs of spaces of any kind
separate words, and count for bytes only. Text written without spaces is compared by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .crosslinks import link_across
from .kernels import BASE, NOT_SPACE, Chunk, chunks, mix
from .runtime import free, lean, settle, sweep, workers_find_package, written


#: The band of `within` is a 64-bit word.
MOST_EDITS = 30
#: Words of an anchor, and the most places among which one is chosen.
ANCHOR, WIDEST = 4, 64


@dataclass(frozen=True)
class LinePlan:
    edits: int = 2
    min_bytes: int = 24
    equal_short: bool = False  # whether lines under min_bytes go where they equal an earlier one
    words_per_edit: int = 0  # if not 0, lines of min_words or more are compared by words
    min_words: int = 10

    def __post_init__(self) -> None:
        if self.edits < 0 or self.edits > 30 or self.min_bytes < 2 * (self.edits + 1):
            raise ValueError("edits must be 0 to 30, and lines at least two bytes for each segment")
        if self.words_per_edit and windows(np.arange(self.min_words, self.min_words + 40 * self.words_per_edit), self).min() < 1:
            raise ValueError("edits must leave runs that hold an anchor")

    def allowed(self, words: np.ndarray) -> np.ndarray:
        """The words that lines may differ in, the shorter one of so many words."""
        return np.clip(words // self.words_per_edit, 1, MOST_EDITS)

    def allowed_column(self, words: Column) -> Column:
        return F.greatest(F.lit(1), F.least(F.floor(words / self.words_per_edit), F.lit(MOST_EDITS)))

    def by_words(self, words: np.ndarray) -> np.ndarray:
        return words >= self.min_words if self.words_per_edit else np.zeros(len(words), bool)

    def by_bytes(self, words: np.ndarray) -> np.ndarray:
        """Lines with a line within reach that has fewer than min_words: an edited byte adds one word at most."""
        return words < self.min_words + self.edits if self.words_per_edit else np.ones(len(words), bool)


def segments(length: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes (segment x line) of the edits + 1 segments of lines of the lengths; later ones take the remainder."""
    k = edits + 1
    short, longer = length // k, length % k
    sizes = np.stack([short + (i >= k - longer) for i in range(k)])
    return np.cumsum(sizes, 0) - sizes, sizes


def probes(length: np.ndarray, edits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For lines of the lengths: segment number, length of the indexed line, start of a substring and its size; a start of -1 is none.

    A line's own segments are not among them: as such they meet those of other lines of its length already.
    """
    for shorter in range(edits + 1):
        other = length - shorter
        starts, sizes = segments(other, edits)
        for i in range(edits + 1):
            low = np.maximum(starts[i] - i, starts[i] + shorter - (edits - i)).clip(0)
            high = np.minimum(np.minimum(starts[i] + i, starts[i] + shorter + (edits - i)), length - sizes[i])
            for step in range(2 * edits + 1):
                at = low + step
                if (at > high).all():
                    break
                own = (at == starts[i]) if shorter == 0 else False
                yield i, other, np.where((at <= high) & ~np.asarray(own), at, -1), sizes[i]


def _key(hashes: np.ndarray, number: int, length: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(length.astype(np.uint64) * np.uint64(64) + np.uint64(number)))


def windows(words: np.ndarray, plan: LinePlan) -> np.ndarray:
    """How many places a line of so many words chooses an anchor from.

    A shorter line of m words and e edits is cut by them to e + 1 unchanged runs, so one has (m - e) / (e + 1) words; the least of that over all lines that this one may be compared with.
    """
    run = np.full(len(words), 1 << 40)
    for less in range(MOST_EDITS + 1):
        other = words - less
        edits = plan.allowed(other)
        met = (other >= plan.min_words) & (less <= edits)
        run[met] = np.minimum(run[met], -(-(other - edits) // (edits + 1))[met])
    return np.minimum(run - ANCHOR + 1, WIDEST)


def anchors(hashes: np.ndarray, first: np.ndarray, count: np.ndarray, plan: LinePlan) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and which line each is of: the smallest hash of ANCHOR words in every window of places; hashes are of words, first and count say which are a line's.

    Lines that hold the same run of window + ANCHOR - 1 words have that run's smallest hash in common, also if the window of one is narrower.
    """
    keys, lines = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    least = np.zeros(max(len(hashes) - ANCHOR + 1, 0), np.uint64)
    for j in range(ANCHOR):
        least = least * np.uint64(BASE) + hashes[j : j + len(least)]
    least = mix(least)
    width = windows(count, plan)
    places = count - ANCHOR + 1 - width + 1
    step = 1
    while step <= WIDEST:  # least[i] is now that of step places
        mine = np.flatnonzero((width >= step) & (width < 2 * step))
        n = places[mine]
        line = np.repeat(mine, n)
        at = first[line] + np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
        key = np.minimum(least[at], least[at + width[line] - step])
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        keys.append(key[new])
        lines.append(line[new])
        least = np.minimum(least[: max(len(least) - step, 0)], least[step:])
        step *= 2
    return mix(np.concatenate(keys)), np.concatenate(lines)


def _lines(c: Chunk, plan: LinePlan, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, row, number in its text and hash of each line that is long enough; short: and of shorter ones that are not blank."""
    first, last, row = c.lines()
    number = np.arange(len(first)) - np.searchsorted(row, row)
    taken = last - first >= plan.min_bytes
    if short:
        seen = np.concatenate([[0], np.cumsum(NOT_SPACE[c.data])])
        taken |= seen[last] > seen[first]
    at = np.flatnonzero(taken)
    first, last = first[at], last[at]
    return first, last, row[at], number[at], c.hashes(first, last) >> np.uint64(2)


def line_words(c: Chunk, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of a chunk's words, and the first word and the number of words of each line."""
    begin, end, _ = c.words(NOT_SPACE)
    at = np.searchsorted(begin, first)
    return c.hashes(begin, end), at, np.searchsorted(begin, last) - at


#: A member of a key is its node, with this bit set if it is a probe: all segments are smaller than all probes.
PROBE = 1 << 62


#: Keys that a task gathers before it packs them; members of a range of keys that are held before those that have met go; lines for each range of keys.
PACKED, HELD, RANGE_LINES = 1 << 19, 1 << 22, 50_000
MEMBER = np.uint64(PROBE - 1)
#: Members of a key whose pairs are looked at where the key is, and pairs for each member that are made there.
LOOKED_AT, PAIRS = 2048, 8
#: Bytes of the runs whose parities are the sketch of a line that is compared by bytes.
RUN = 2
#: Sizes: words with ANCHORED set, or bytes, with WORDY set if the line is compared by words with others of many words.
ANCHORED, WORDY = 1 << 15, 1 << 14
#: A key travels by its lower half, as the upper one tells its range: two of a range are taken for one with probability 2**-32, which adds members to look at and takes none away.
ENTRY = np.dtype([("key", "<u4"), ("member", "<u8"), ("sketch", "<u8"), ("size", "<u2")])


def distinct_members(key: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Places in the order of keys, the members of each in ascending order, each once."""
    order = np.argsort(key)
    key, of = key[order], member[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    at = np.flatnonzero(same[1:] | same[:-1])  # most keys have one member
    order[at] = order[at][np.lexsort((of[at], key[at]))]
    of = member[order]
    new = np.ones(len(key), bool)
    new[1:] = ~same[1:-1] | (of[1:] != of[:-1])
    return order[new]


def _parities(hashes: np.ndarray) -> np.ndarray:
    """Of the things before each place and at the end: which of 64 buckets hold an odd number of them."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.bitwise_xor.accumulate(np.uint64(1) << (hashes >> np.uint64(58)), out=sums[1:])
    return sums


def line_keys(c: Chunk, plan: LinePlan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, member, sketch and size of each segment, anchor and probe of a chunk; equal lines come once, and a line is one member of a key at most.

    The sketch holds parities of a line's words for its anchors, of its runs of RUN bytes for its segments. An edited word changes two of them at most, an edited byte twice RUN.
    """
    first, last, _, _, node = _lines(c, plan)
    node, one = np.unique(node, return_index=True)
    first, last = first[one], last[one]
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint16))]
    if not len(one):
        return found[0]
    wordy = np.zeros(len(one), bool)
    if plan.words_per_edit:
        hashes, at, count = line_words(c, first, last)
        wordy = plan.by_words(count)
        few, many = plan.by_bytes(count), np.flatnonzero(wordy)
        key, line = anchors(hashes, at[many], count[many], plan)
        of, words = many[line], _parities(hashes)
        found.append((key, node[of], (words[at + count] ^ words[at])[of], (np.minimum(count, ANCHORED - 1) | ANCHORED).astype(np.uint16)[of]))
        first, last, node, wordy = first[few], last[few], node[few], wordy[few]
    length = last - first
    starts, sizes = segments(length, plan.edits)
    keys, lines, roles = [], [], []
    for i in range(plan.edits + 1):
        begin = first + starts[i]
        keys.append(_key(c.hashes(begin, begin + sizes[i]), i, length))
        lines.append(np.arange(len(first)))
        roles.append(np.zeros(len(first), np.uint64))
    for i, other, at, size in probes(length, plan.edits):
        good = np.flatnonzero((at >= 0) & (other >= plan.min_bytes))
        begin = first[good] + at[good]
        keys.append(_key(c.hashes(begin, begin + size[good]), i, other[good]))
        lines.append(good)
        roles.append(np.full(len(good), PROBE, np.uint64))
    key, line = np.concatenate(keys), np.concatenate(lines)
    member = node[line] | np.concatenate(roles)
    at = distinct_members(key, member)
    key, member, line = key[at], member[at], line[at]
    # A line's probe may meet its own segment, which then stands for both.
    order = np.lexsort((member, member & MEMBER, key)) if len(key) and (key[1:] == key[:-1]).any() else np.arange(len(key))
    key, member, line = key[order], member[order], line[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | ((member[1:] ^ member[:-1]) & MEMBER != 0)
    gram = np.zeros(max(len(c.data) - RUN + 1, 0), np.uint64)
    for k in range(RUN):
        gram = gram << np.uint64(8) | c.data[k : k + len(gram)]
    runs = _parities(mix(gram + np.uint64(1)))
    sketch = runs[last - RUN + 1] ^ runs[first]
    found.append((key[new], member[new], sketch[line[new]], (np.minimum(length, WORDY - 1) | np.where(wordy, WORDY, 0)).astype(np.uint16)[line[new]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def packed_keys(docs: DataFrame, plan: LinePlan, ranges: int, text_col: str = "text") -> DataFrame:
    """part (a range of keys) and packed (an ENTRY for each key of it and each of its members)."""
    workers_find_package(docs.sparkSession)

    def pack(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, member, sketch, size = (np.concatenate(x) for x in zip(*found, strict=True))
        at = distinct_members(key, member)
        part = ((key[at] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
        offsets = np.append(begin, len(part)).astype(np.int32) * np.int32(ENTRY.itemsize)
        data = np.empty(len(at), ENTRY)
        data["key"], data["member"], data["sketch"], data["size"] = key[at].astype(np.uint32), member[at], sketch[at], size[at]
        return pa.RecordBatch.from_pydict({"part": pa.array(part[begin].view(np.int64)), "packed": pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            for c in chunks(batch.column(0)):
                found.append(line_keys(c, plan))
                n += len(found[-1][0])
                if n >= PACKED:
                    yield pack(found)
                    found, n = [], 0
        if n:
            yield pack(found)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "part long, packed binary")


class Near:
    """Which members of a key may be alike, by their sketches and sizes."""

    def __init__(self, sketch: np.ndarray, size: np.ndarray, plan: LinePlan) -> None:
        anchored = size >= ANCHORED
        self.sketch, self.wordy = sketch, ~anchored & (size & WORDY > 0)
        # Anchors and segments, which may share half a key, are far from each other in size.
        self.size = np.where(anchored, size & (ANCHORED - 1), -1 - (size & (WORDY - 1)).astype(np.int32) - 2 * MOST_EDITS).astype(np.int32)
        self.edits = np.where(anchored, plan.allowed(self.size.clip(0)) if plan.words_per_edit else 0, plan.edits).astype(np.int32)
        self.bits = np.where(anchored, 2 * self.edits, 2 * RUN * self.edits).astype(np.int32)

    def pairs(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether these may be. Two lines that are compared by words have an anchor in common if they are alike, so their segments need not meet."""
        at = np.flatnonzero(np.abs(self.size[one] - self.size[two]) <= np.minimum(self.edits[one], self.edits[two]))
        out, one, two = np.zeros(len(one), bool), one[at], two[at]
        out[at] = (np.bitwise_count(self.sketch[one] ^ self.sketch[two]) <= np.minimum(self.bits[one], self.bits[two])) & ~(self.wordy[one] & self.wordy[two])
        return out


class Meeting:
    """The members of a range of keys, given piece by piece. Each key's first is a segment that all other members are paired with; it stays the first once any has been."""

    def __init__(self, plan: LinePlan | None = None, looked_at: int = 0) -> None:
        """looked_at: all pairs of keys with so many members are looked at, if all are held at once."""
        none = np.zeros(0, np.uint64)
        self.plan, self.looked_at = plan or LinePlan(), looked_at
        self.parts, self.size, self.limit = [], 0, HELD
        self.met = none  # keys in ascending order of which some members have gone
        self.first = (none, none, np.zeros(0, np.uint16))  # their firsts: member, sketch, size

    def add(self, key: np.ndarray, member: np.ndarray, sketch: np.ndarray | None = None, size: np.ndarray | None = None) -> pa.RecordBatch | None:
        """Members that go now, if too many are held."""
        self.parts.append((key, member, np.zeros(len(key), np.uint64) if sketch is None else sketch, np.zeros(len(key), np.uint16) if size is None else size))
        self.size += len(key)
        return self.pairs(last=False) if self.size >= self.limit else None

    def pairs(self, last: bool) -> pa.RecordBatch:
        """key, node, role (0: segment, 1: probe), first (another member of the key), near (whether node and first may be alike) and more (whether other members beside the key's first may still be linked with this one).

        Pairs that are neither are not made. A member may come again if not all are held at once, and with firsts that are not the key's if its pairs were looked at.
        """
        columns = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        at = distinct_members(*columns[:2])
        key, member, sketch, size = (x[at] for x in columns)
        at = np.searchsorted(self.met, key)
        known = at < len(self.met)
        known[known] = self.met[at[known]] == key[known]
        begin = np.concatenate([[True], key[1:] != key[:-1]])
        run = np.cumsum(begin) - 1
        starts = np.flatnonzero(begin)
        n = np.diff(np.append(starts, len(key)))
        # The first of each key stands among the members, or behind them if it has gone before.
        back = starts[known[starts]]
        of = [np.concatenate([x, y[at[back]]]) for x, y in zip((member, sketch, size), self.first, strict=True)]
        first, second = starts.copy(), member[np.minimum(starts + 1, len(key) - 1)]
        first[known[starts]] = len(key) + np.arange(len(back))
        near = Near(of[1], of[2], self.plan)
        meets = (of[0][first] < np.uint64(PROBE)) & (known[starts] | (n > 1))
        out = np.flatnonzero(meets[run] & (member != of[0][first[run]]))
        more = known[starts] | (not last) | ((n > 2) & (second < np.uint64(PROBE)))
        one, two = first[run[out]], out
        if last and self.looked_at:
            looked = np.flatnonzero(meets & more & ~known[starts] & (n <= self.looked_at + 1))
            more[looked], x, y = self._look(starts[looked], n[looked], near, member)
            one, two = np.concatenate([one, x]), np.concatenate([two, y])
        more = more[run]
        close = near.pairs(one, two)
        taken = close | more[two]
        one, two, close = one[taken], two[taken], close[taken]
        gone = pa.RecordBatch.from_pydict({"key": pa.array(key[two].view(np.int64)), "node": pa.array((member[two] & MEMBER).view(np.int64)), "role": pa.array((member[two] >= np.uint64(PROBE)).astype(np.int8)), "first": pa.array((of[0][one] & MEMBER).view(np.int64)), "near": pa.array(close), "more": pa.array(more[two])})
        if not last:
            kept, new = ~meets[run], starts[meets & ~known[starts]]
            order = np.argsort(met := np.concatenate([self.met, key[new]]))
            self.met, self.first = met[order], tuple(np.concatenate([y, x[new]])[order] for x, y in zip((member, sketch, size), self.first, strict=True))
            self.parts, self.size = [tuple(x[kept] for x in (key, member, sketch, size))], int(kept.sum())
            self.limit = max(HELD, 2 * self.size)
        return gone

    def _look(self, starts: np.ndarray, n: np.ndarray, near: Near, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the keys given by their first places and members: those with more than PAIRS near pairs a member, as groups of alike lines have, and the near pairs of the others; each key's first is left out."""
        made, one, two, of = np.zeros(len(n), np.int64), [], [], []
        which = np.repeat(np.arange(len(n)), n - 1)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n - 1) - (n - 1), n - 1)
        at, left = starts[which] + 1 + place, n[which] - 2 - place  # members of the key behind this one
        step = 1
        while len(at):
            live = (left >= step) & (made[which] <= PAIRS * n[which])
            at, left, which = at[live], left[live], which[live]
            met = near.pairs(at, at + step) & (member[at] < np.uint64(PROBE))  # probes stand last
            one.append(at[met])
            two.append(at[met] + step)
            of.append(which[met])
            made += np.bincount(which[met], minlength=len(n))
            step += 1
        dense = made > PAIRS * n
        one, two, of = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (one, two, of))
        return dense, one[~dense[of]], two[~dense[of]]


def key_pairs(packed: DataFrame, plan: LinePlan) -> DataFrame:
    """key, node, role, first, near and more, of the keys with a segment and another member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Meeting(plan, LOOKED_AT)
        for batch in batches:
            for part, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now and held.parts:
                    yield held.pairs(last=True)
                    held = Meeting(plan, LOOKED_AT)
                now = part
                rows = np.frombuffer(values.as_buffer(), ENTRY)
                if (gone := held.add(rows["key"] | np.uint64(part << 32), *(rows[c].copy() for c in ("member", "sketch", "size")))) is not None:
                    yield gone
        if held.parts:
            yield held.pairs(last=True)

    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(lean(run), "key long, node long, role byte, first long, near boolean, more boolean")


def occurrences(docs: DataFrame, plan: LinePlan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, line and node of each line that may go."""
    workers_find_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2)):
                _, _, row, number, node = _lines(c, plan, plan.equal_short)
                at = pa.array(c.row + row)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(at), "text_hash": batch.column(1).take(at), "line": pa.array(number.astype(np.int32)), "node": pa.array(node.view(np.int64))})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id long, text_hash long, line int, node long")


def line_texts(docs: DataFrame, plan: LinePlan, text_col: str = "text", part: int = 0, parts: int = 1) -> DataFrame:
    """node and body of each line that is long enough and whose node is of the part (by its remainder); lines equal within a chunk come once."""
    workers_find_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(0)):
                first, last, _, _, node = _lines(c, plan)
                node, one = np.unique(node, return_index=True)
                mine = node % np.uint64(parts) == part
                node, one = node[mine], one[mine]
                yield pa.RecordBatch.from_pydict({"node": pa.array(node.view(np.int64)), "body": pa.array([c.data[a:b].tobytes() for a, b in zip(first[one], last[one], strict=True)], pa.binary())})

    return docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "node long, body binary")


def within(left: list, right: list, edits: int | np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most edits (one for all, or one each); the pairs are bytes, or arrays of any integers.

    Common ends are cut off first, which settles most pairs, and of long pairs those that have too few letters in common. The rest go by bands, those of few edits first.
    """
    edits = np.broadcast_to(np.asarray(edits, np.int64), len(left))
    close = np.zeros(len(left), bool)
    left, right = ([np.frombuffer(v, np.uint8) if isinstance(v, bytes) else v for v in side] for side in (left, right))
    m, n = (np.array([len(v) for v in side], np.int64) for side in (left, right))
    met = np.flatnonzero(np.abs(m - n) <= edits)
    pattern, text, kept = [], [], []
    for some in np.split(met, np.flatnonzero(np.diff(np.cumsum(np.maximum(m, n)[met]) >> 16)) + 1):  # a longer pair is one of its own
        if not len(some):
            continue
        one, two = [left[k] for k in some], [right[k] for k in some]
        head, tail = _common_ends(one, two)
        cut = [(k, x[h : len(x) - t], y[h : len(y) - t]) for k, x, y, h, t in zip(some.tolist(), one, two, head.tolist(), tail.tolist(), strict=True)]
        allowed = edits[some].tolist()
        close[[k for (k, x, y), e in zip(cut, allowed, strict=True) if max(len(x), len(y)) <= e]] = True
        rest = [c for c, e in zip(cut, allowed, strict=True) if max(len(c[1]), len(c[2])) > e and min(len(c[1]), len(c[2]))]
        far = _differ_much([c[1] for c in rest], [c[2] for c in rest], edits[[c[0] for c in rest]])
        for (k, x, y), f in zip(rest, far.tolist(), strict=True):
            if not f:
                kept.append(k)
                pattern.append(x)
                text.append(y)
    which, low = np.array(kept, np.int64), 0
    for high in (2, 4, 8, 16, MOST_EDITS):
        mine = np.flatnonzero((edits[which] > low - (low == 0)) & (edits[which] <= high))
        if len(mine):
            close[which[mine]] = _banded([pattern[i] for i in mine], [text[i] for i in mine], edits[which[mine]])
        low = high
    return close


def _common_ends(left: list, right: list) -> tuple[np.ndarray, np.ndarray]:
    """How many letters each pair has in common at the start, and how many of the others at the end."""
    if len(left) == 1 and max(len(left[0]), len(right[0])) > 1 << 16:  # by less memory
        x, y = left[0], right[0]
        n = min(len(x), len(y))
        differ = x[:n] != y[:n]
        head = int(differ.argmax()) if differ.any() else n
        differ = (x[len(x) - n + head :] != y[len(y) - n + head :])[::-1]
        return np.array([head]), np.array([int(differ.argmax()) if differ.any() else n - head])
    m, n = (np.array([len(v) for v in side], np.int64) for side in (left, right))
    x, y = np.concatenate(left), np.concatenate(right)
    x_end, y_end = np.cumsum(m), np.cumsum(n)

    def common(most: np.ndarray, x_at: np.ndarray, y_at: np.ndarray, way: int) -> np.ndarray:
        row = np.repeat(np.arange(len(most)), most)
        place = np.arange(len(row)) - np.repeat(np.cumsum(most) - most, most)
        at = np.flatnonzero(x[x_at[row] + way * place] != y[y_at[row] + way * place])[::-1]
        out = most.copy()
        out[row[at]] = place[at]  # the last one written is the first in place
        return out

    head = common(np.minimum(m, n), x_end - m, y_end - n, 1)
    return head, common(np.minimum(m, n) - head, x_end - 1, y_end - 1, -1)


#: Letters of a pair from which on its letters are counted first, and the buckets they are counted in.
LONG, BUCKETS = 12, 512


def _differ_much(left: list, right: list, edits: np.ndarray) -> np.ndarray:
    """Pairs of which more letters occur an odd number of times in both together than that many edits, each of which changes two at most, can explain; letters are counted in buckets."""
    out = np.zeros(len(left), bool)
    size = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64)
    mine = np.flatnonzero((size > 2 * LONG) & (size > 2 * edits))
    for at in range(0, len(mine), 256):
        some = mine[at : at + 256]
        letters = mix(np.concatenate([v for k in some for v in (left[k], right[k])])) >> np.uint64(55)
        row = np.repeat(np.arange(len(some)), size[some])
        odd = np.bincount(row * BUCKETS + letters.astype(np.int64), minlength=len(some) * BUCKETS) & 1
        out[some] = odd.reshape(-1, BUCKETS).sum(1) > 2 * edits[some]
    return out


def _banded(pattern: list[np.ndarray], text: list[np.ndarray], edits: np.ndarray) -> np.ndarray:
    """The same for pairs of about equal edits, with bit-parallel bands.

    The band of 2 * edits + 1 diagonals of a pair, as wide as the most edits need, is one 64-bit word; bit b of column j stands for row j - edits + b. Vertical differences are kept as two words,
    and the band moves down a row with each column. The distance is followed along the lowest diagonal to the last row, then along that row.
    """
    close = np.zeros(len(pattern), bool)
    band = int(edits.max())
    m, n = np.array([len(x) for x in pattern]), np.array([len(x) for x in text])
    p_at, t_at = np.cumsum(m) - m, np.cumsum(n) - n
    p, t = np.concatenate(pattern), np.concatenate(text)
    width = 2 * band + 1
    full, one = np.uint64((1 << width) - 1), np.uint64(1)
    met = _met(p, m, t, n, band)
    which = np.arange(len(pattern))
    distance = np.minimum(m, band)
    vp = np.full(len(m), (1 << width) - (1 << band), np.uint64)
    vn = np.zeros(len(m), np.uint64)
    j = 0
    while len(which):
        over = n == j
        if over.any():
            close[which[over & (distance <= edits)]] = True
        # Beyond the lowest diagonal the distance falls by one a column at most.
        live = ~over & (distance <= edits + band + np.maximum(n - m, 0) + np.abs(n - m))
        if not live.all() and (over.any() or j % 32 == 0):
            which, m, n, p_at, t_at, distance, edits, vp, vn = (v[live] for v in (which, m, n, p_at, t_at, distance, edits, vp, vn))
            if not len(which):
                break
        if len(which) <= FEW:
            for i in range(len(which)):
                close[which[i]] = _banded_one(p[p_at[i] : p_at[i] + m[i]], t[t_at[i] : t_at[i] + n[i]], int(edits[i]))
            break
        j += 1
        equal = met[t_at + j - 1]
        d0 = ((((equal & vp) + vp) ^ vp) | equal | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        bit = np.clip(m - j + band, 0, width - 1).astype(np.uint64)  # the last row's
        on_diagonal = j + band <= m
        distance = distance + np.where(on_diagonal, ((d0 >> np.uint64(width - 1)) & one) == 0, ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64))
        vp = (hn | ~((d0 >> one) | hp)) & full
        vn = (d0 >> one) & hp
    return close


def _met(p: np.ndarray, m: np.ndarray, t: np.ndarray, n: np.ndarray, band: int) -> np.ndarray:
    """For each letter of the texts t, which rows of its column's band hold it in the pattern of the same pair; m and n are the lengths of patterns and texts."""
    row, column = (np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of) for of in (m, n))
    pair = np.concatenate([np.repeat(np.arange(len(of)), of) for of in (m, n)])
    letter = np.unique(np.concatenate([p, t]), return_inverse=True)[1]
    letter = np.unique(pair * (letter.max() + 1) + letter, return_inverse=True)[1]
    span = max(int(m.max()), int(n.max())) + 2 * band + 1
    place = letter[: len(p)] * span + row
    order = np.argsort(place)
    place, low = place[order], letter[len(p) :] * span + column
    begin, end = np.searchsorted(place, low - np.minimum(column, band)), np.searchsorted(place, low + band, "right")
    count = end - begin
    at = np.flatnonzero(count)
    starts = np.cumsum(count[at]) - count[at]
    found = np.repeat(begin[at] - starts, count[at]) + np.arange(count.sum())
    bits = np.uint64(1) << (row[order[found]] - np.repeat(column[at], count[at]) + band).astype(np.uint64)
    out = np.zeros(len(t), np.uint64)
    if len(at):
        out[at] = np.bitwise_or.reduceat(bits, starts)
    return out


#: So many pairs are followed one by one: a step of all costs about as much as so many steps of one.
FEW = 12


def _banded_one(pattern: np.ndarray, text: np.ndarray, edits: int) -> bool:
    """The same for one pair, with Python's integers: each letter's places in the pattern are one integer, which is shifted to the band."""
    places: dict[int, int] = {}
    for i, letter in enumerate(pattern.tolist()):
        places[letter] = places.get(letter, 0) | 1 << i
    m, width = len(pattern), 2 * edits + 1
    full, vp, vn, distance = (1 << width) - 1, (1 << width) - (1 << edits), 0, min(m, edits)
    for j, letter in enumerate(text.tolist(), 1):
        of, down = places.get(letter, 0), j - edits - 1
        equal = (of >> down if down >= 0 else of << -down) & full
        d0 = ((((equal & vp) + vp) ^ vp) | equal | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if j + edits <= m:
            distance += not d0 >> (width - 1) & 1
        else:
            bit = max(m - j + edits, 0)
            distance += (hp >> bit & 1) - (hn >> bit & 1)
        if distance > 2 * edits + max(len(text) - m, 0) + abs(len(text) - m):
            return False
        vp, vn = (hn | ~(d0 >> 1 | hp)) & full, d0 >> 1 & hp
    return distance <= edits


BITMAP, GRAM = 640, 4


def _grams(c: Chunk, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of GRAM bytes within each row that is taken, and their rows."""
    rows = np.flatnonzero(taken)
    n = np.maximum(c.ends[rows] - c.starts[rows] - GRAM + 1, 0)
    row = np.repeat(rows, n)
    at = c.starts[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    gram = np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        gram = gram << np.uint64(8) | c.data[at + k]
    return mix(gram + np.uint64(1)), row


def _profile(c: Chunk, plan: LinePlan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows that are lines: how many words each has, whether it is compared by words, and the rows and buckets of what its bitmaps hold: its words and, beyond BITMAP, its pairs of neighbouring words; or its runs of four bytes."""
    hashes, _, count = line_words(c, c.starts, c.ends)
    by_words = plan.by_words(count)
    row = np.repeat(np.arange(c.n), count)
    gram, gram_row = _grams(c, ~by_words)
    words = by_words[row]
    pair = np.flatnonzero(words[1:] & (row[1:] == row[:-1])) if len(row) else np.zeros(0, np.int64)
    both = mix(hashes[pair] * np.uint64(BASE) + hashes[pair + 1]) if len(pair) else np.zeros(0, np.uint64)
    bucket = lambda h: (h % np.uint64(BITMAP)).astype(np.int64)
    return count, by_words, np.concatenate([row[words], gram_row, row[pair]]), np.concatenate([bucket(hashes[words]), bucket(gram), bucket(both) + BITMAP])


def bitmaps(lines: DataFrame, plan: LinePlan) -> DataFrame:
    """node, body, size (bytes), words, by_words, bits_0 and so on (two bitmaps of BITMAP bits, of a line's words and of its pairs of neighbouring words, or one of its runs of four bytes) and ones, how many are set in each.

    An edit takes one word, two pairs of words or four runs from a line at most, and adds no more to it.
    """
    workers_find_package(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                count, by_words, row, bucket = _profile(c, plan)
                seen = np.zeros((c.n, 2 * BITMAP), np.uint8)
                seen[row, bucket] = 1
                words = np.packbits(seen, axis=1, bitorder="little").view("<i8")
                ones = [pa.array(seen[:, k : k + BITMAP].sum(1, dtype=np.int32)) for k in (0, BITMAP)]
                part = batch.slice(c.row, c.n)
                yield pa.RecordBatch.from_pydict({
                    "node": part.column(0), "body": part.column(1), "ones_0": ones[0], f"ones_{BITMAP}": ones[1], "size": pa.array((c.ends - c.starts).astype(np.int32)), "words": pa.array(count.astype(np.int32)), "by_words": pa.array(by_words),
                    **{f"bits_{k}": pa.array(np.ascontiguousarray(words[:, k])) for k in range(words.shape[1])},
                })

    return lines.mapInArrow(lean(run), f"node long, body binary, ones_0 int, ones_{BITMAP} int, size int, words int, by_words boolean, " + ", ".join(f"bits_{k} long" for k in range(2 * BITMAP // 64)))


def _missing(a: str, b: str, first: int) -> Column:
    """How many bits of one line's bitmap the other's lacks, the greater of both ways. Few and plain operations, as the whole condition must stay small enough to be compiled."""
    shared = F.lit(0)
    for k in range(first // 64, (first + BITMAP) // 64):
        shared = shared + F.bit_count(F.col(f"{a}.bits_{k}").bitwiseAND(F.col(f"{b}.bits_{k}")))
    return F.greatest(F.col(f"{a}.ones_{first}"), F.col(f"{b}.ones_{first}")) - shared


def reachable(a: str, b: str, plan: LinePlan) -> Column:
    """Whether two lines can be alike, by their lengths and bitmaps."""
    of_a, of_b = F.col(f"{a}.by_words"), F.col(f"{b}.by_words")
    sizes = F.abs(F.col(f"{a}.size") - F.col(f"{b}.size")) <= plan.edits
    if not plan.words_per_edit:
        return sizes & (_missing(a, b, 0) <= plan.edits * GRAM)
    edits = plan.allowed_column(F.least(f"{a}.words", f"{b}.words"))
    lengths = F.when(of_a & of_b, F.abs(F.col(f"{a}.words") - F.col(f"{b}.words")) <= edits).otherwise(sizes)
    # A line by words and one by bytes have bitmaps of other things; pairs of words are marked for the former alone.
    single = F.when(of_a & of_b, edits).when(of_a | of_b, F.lit(BITMAP)).otherwise(F.lit(plan.edits * GRAM))
    return lengths & (_missing(a, b, 0) <= single) & (_missing(a, b, BITMAP) <= F.when(of_a & of_b, 2 * edits).otherwise(F.lit(BITMAP)))


def alike(left: pa.Array, right: pa.Array, plan: LinePlan) -> np.ndarray:
    """Whether the lines of each pair are alike."""
    n = len(left)
    close = np.zeros(n, bool)
    sides = []
    for lines in (left, right):
        c = next(chunks(lines, 1 << 62))
        hashes, at, count = line_words(c, c.starts, c.ends)
        sides.append((c, hashes, at, count))
    (c, hashes, at, count), (d, d_hashes, d_at, d_count) = sides
    both = plan.by_words(count) & plan.by_words(d_count)
    edits = np.where(both, plan.allowed(np.minimum(count, d_count)) if plan.words_per_edit else 0, plan.edits)
    for words in (True, False):
        mine = np.flatnonzero(both == words)
        if words:
            one, two = ([h[f[i] : f[i] + k[i]] for i in mine] for h, f, k in ((hashes, at, count), (d_hashes, d_at, d_count)))
        else:
            one, two = ([x.data[x.starts[i] : x.ends[i]] for i in mine] for x in (c, d))
        close[mine] = within(one, two, edits[mine])
    return close


def alike_lines(docs: DataFrame, plan: LinePlan, text_col: str = "text", n_lines: int = 0) -> DataFrame:
    """id (a node that is like another) and its component; n_lines: how many lines there are, about, by which keys are parted."""
    spark = docs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_lines // RANGE_LINES)
    hits = written(key_pairs(packed_keys(docs, plan, ranges, text_col), plan), "hits")
    settle(spark)
    wanted = written(hits.select("node").union(hits.select(F.col("first").alias("node"))).distinct(), "wanted")
    bodies = written(bitmaps(line_texts(docs, plan, text_col).join(wanted.hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"]), plan), "lines", "zstd")
    sweep(spark)
    bits = bodies.drop("body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(alike(batch.column(2), batch.column(3), plan)))

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = (bodies.select(F.col("node").alias(k), F.col("body").alias(f"body_{k}")) for k in "ab")
        return pairs.join(one, "a").join(two, "b").select("a", "b", "body_a", "body_b").mapInArrow(lean(run), "a long, b long")

    near = hits.filter("near").select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b")).distinct()
    links = written(verified(near), "links")
    sweep(spark)
    found = components(links)

    def sets_of(nodes: DataFrame) -> DataFrame:
        return rare_sets(bodies.join(nodes, "node").select("node", "body", "component"), plan)

    settle(spark)
    # Most keys are settled where they are: all their pairs that may be alike are among the links. Left are those of large groups, and of very large keys.
    out = link_across(hits.filter("more").select("key", "node", "role"), found, bits, lambda x, y: reachable(x, y, plan), sets_of, verified, "lines")
    free(hits, bodies, wanted, links)
    sweep(spark)
    return out


def rare_sets(lines: DataFrame, plan: LinePlan) -> DataFrame:
    """node, elements, prefix and the component given for crosslinks: a line's distinct words if it is compared by words, its runs of four bytes if by bytes, and both in a row each where it may be either."""
    workers_find_package(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                hashes, _, count = line_words(c, c.starts, c.ends)
                gram, gram_row = _grams(c, plan.by_bytes(count))
                word_row = np.repeat(np.arange(c.n), count)
                for held, row, of, prefix in ((hashes, word_row, plan.by_words(count), plan.allowed(count) + 1 if plan.words_per_edit else count), (gram, gram_row, plan.by_bytes(count), np.full(c.n, GRAM * plan.edits + 1))):
                    mine = of[row]
                    held, row = held[mine], row[mine]
                    order = np.lexsort((held, row))
                    held, row = held[order], row[order]
                    new = np.ones(len(held), bool)
                    new[1:] = (held[1:] != held[:-1]) | (row[1:] != row[:-1])
                    rows = np.flatnonzero(of)
                    offsets = np.searchsorted(row[new], np.append(rows, c.n)).astype(np.int32)
                    part, at = batch.slice(c.row, c.n), pa.array(rows)
                    yield pa.RecordBatch.from_pydict({"node": part.column(0).take(at), "component": part.column(2).take(at), "elements": pa.ListArray.from_arrays(offsets, pa.array(held[new].view(np.int64))), "prefix": pa.array(prefix[rows].astype(np.int64))})

    return lines.mapInArrow(lean(run), "node long, component long, elements array<long>, prefix long")


def duplicate_lines(docs: DataFrame, plan: LinePlan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash (xxhash64), line, first_doc and first_line: every line that is like an earlier one, and where the first of its component stands."""
    plan = plan or LinePlan()
    seen = written(occurrences(docs, plan, id_col, text_col), "occurrences")
    found = alike_lines(docs, plan, text_col, seen.count())
    named = written(seen.join(found.withColumnRenamed("id", "node"), "node", "left").select("doc_id", "text_hash", "line", F.coalesce("component", "node").alias("component")), "named")
    free(seen, found)
    place = F.struct("doc_id", "line", "text_hash")
    firsts = written(named.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("component", "first"), "firsts")
    later = named.join(firsts, "component").filter(~place.eqNullSafe(F.col("first")))
    return later.select("doc_id", "text_hash", "line", F.col("first.doc_id").alias("first_doc"), F.col("first.line").alias("first_line"))


def dedup_lines(docs: DataFrame, plan: LinePlan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with those lines taken out of their texts; documents keep their rows, also where no line is left."""
    workers_find_package(docs.sparkSession)
    found = duplicate_lines(docs, plan, id_col, text_col)
    # A row for each text that loses lines; it has no more numbers than the text has lines.
    drops = written(found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("drop")), "drops")
    settle(docs.sparkSession)
    # Columns go by number inside, so that no name of docs meets another.
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text, key = named[f"c{docs.columns.index(text_col)}"], named[f"c{docs.columns.index(id_col)}"].cast("long")
    joined = named.join(drops.hint("shuffle_hash"), key.eqNullSafe(drops["doc_id"]) & (F.xxhash64(text) == drops["text_hash"]), "left")

    def without(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for body, lines in zip(texts, gone, strict=True):
            if not lines.is_valid:
                out.append(None)
                continue
            kept = np.ones(body.as_py().count("\n") + 1, bool)
            kept[lines.values.to_numpy()] = False
            out.append("\n".join(x for x, k in zip(body.as_py().split("\n"), kept, strict=True) if k))
        return pa.array(out, pa.string())

    without.__annotations__ = {"texts": pa.Array, "gone": pa.Array, "return": pa.Array}
    loses = drops["drop"].isNotNull()
    cleaned = F.when(loses, F.arrow_udf(lean(without), "string")(F.when(loses, text), drops["drop"])).otherwise(text)  # only texts that lose lines go to Python
    return joined.select(*[(cleaned if c == text_col else named[f"c{i}"]).alias(c) for i, c in enumerate(docs.columns)])
