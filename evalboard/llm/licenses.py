"""Licence scans by an exact set-similarity join of text blocks with licence templates.

Tokens are pairs of adjacent words, so a bag of a notice's words in another order holds none of them. A block is a window of consecutive words, whatever line ends lie between (notices are wrapped), as long as the template's words over
the threshold; so it is bounded by its template, and any shorter run of words lies in one. Blocks and templates are sets of tokens, and all blocks with |block & template| >= threshold * |template| are found.

Template tokens are ordered by their document frequency in the whole corpus, rarest first. A block may lack size - need tokens, so it holds at least k of the first size - need + k in that order:
for k = 1 that is the prefix filter, for larger k a positional one, and for k = need the length filter. Blocks that pass these have their distinct tokens counted. Tokens that stand in no template add nothing to any overlap,
so blocks are kept as places of template tokens.

What a block stands for is its run, from its first to its last token of the template; words before and behind the run decide nothing. Blocks of one template that overlap are one notice in several windows, of which the one
with the largest overlap, then the shortest run, then the first is kept. Notices share words, so one text may meet several templates: a match gives way to one of higher containment (then of larger overlap, then of the template listed
first) that shares more than half of the shorter run's words.

The templates are a fixed list, so they and their frequencies travel with the tasks; the corpus is read twice and never shuffled, but for one row of counts from each task.

Defined cases: null and empty texts have no words and no label; repeated rows each get their own, equal result; an empty table
gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Chunk, byte_class, chunks, ngram_hashes
from .runtime import lean, workers_find_package

WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

#: Fixed values of the base rule: label and phrase.
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))


@dataclass(frozen=True)
class Template:
    """A notice."""

    label: str
    text: str


#: Labels and wording of public licence notices.
TEMPLATES = (
    Template("gpl", "This work is licensed under the GNU General Public License, version 3."),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("gpl", "You should have received a copy of the GNU General Public License along with this program; if not, see <https://www.gnu.org/licenses/>."),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    Template("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    Template("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    Template("boost", "Distributed under the Boost Software License, Version 1.0."),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
    Template("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    Template("cc-by", "Licensed under CC BY 4.0"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial License"),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    Template("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives License"),
    Template("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    Template("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    Template("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives License"),
    Template("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike License"),
    Template("all-rights-reserved", "All rights reserved."),
    # Whole texts.
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)


def bytes_words(text: str) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())


def word_keys(words: list[bytes]) -> np.ndarray:
    """The hashes that chunks give these words."""
    if not words:
        return np.zeros(0, np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    c = Chunk(0, np.frombuffer(b"".join(words), np.uint8), offsets.astype(np.int64))
    return c.hashes(c.starts, c.ends)


def pair_keys(words: list[bytes]) -> np.ndarray:
    """The hashes of adjacent pairs of these words."""
    keys = word_keys(words)
    return ngram_hashes(keys, np.zeros(len(keys), np.int64), 2)[0]


@dataclass
class Index:
    """Templates over a sorted vocabulary of tokens."""

    labels: list[str]
    vocabulary: np.ndarray
    sizes: np.ndarray  # distinct tokens of each template
    need: np.ndarray  # smallest overlap
    window: np.ndarray  # tokens of a template's blocks
    rank: np.ndarray  # template x token: the token's place in the template, rarest in the corpus first; -1 if it is none of its tokens


def vocabulary_of(templates: tuple[Template, ...]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *[pair_keys(bytes_words(t.text)) for t in templates]]))


def build_index(templates: tuple[Template, ...], frequency: np.ndarray, threshold: float) -> Index:
    vocabulary = vocabulary_of(templates)
    rank = np.full((len(templates), len(vocabulary)), -1)
    for i, t in enumerate(templates):
        own = np.unique(np.searchsorted(vocabulary, pair_keys(bytes_words(t.text))))
        rank[i, own[np.lexsort((own, frequency[own]))]] = np.arange(len(own))
    sizes = (rank >= 0).sum(1)
    need = np.maximum(1, np.ceil(threshold * sizes - 1e-9).astype(np.int64))
    window = np.ceil(np.array([max(len(bytes_words(t.text)) - 1, 0) for t in templates]) / threshold - 1e-9).astype(np.int64)
    return Index([t.label for t in templates], vocabulary, sizes, need, window, rank)


def template_tokens(hashes: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the tokens that stand in some template, and which of the vocabulary each is."""
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    found = np.flatnonzero(vocabulary[at] == hashes)
    return found, at[found]


def blocks(found: np.ndarray, row: np.ndarray, token: np.ndarray, index: Index) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each template, row, overlap and run (first and last token of the template) of every block that meets the threshold; found are the places of template tokens, row and token what they are of and which."""
    gap = int(index.window.max(initial=0))  # no block reaches the next row
    place = found + row * gap
    before = np.full(len(place), -1)  # the same token's place before
    by_token = np.lexsort((place, token))
    same = token[by_token[1:]] == token[by_token[:-1]]
    before[by_token[1:][same]] = place[by_token[:-1][same]]
    for t in range(len(index.labels)):
        rank = index.rank[t][token]
        mine = np.flatnonzero(rank >= 0)
        p, rank, need, lacking = place[mine], rank[mine], index.need[t], index.sizes[t] - index.need[t]
        start = np.arange(len(mine))
        end = np.searchsorted(p, p + index.window[t])  # blocks begin at a token of the template
        for k in sorted({1, *(1 << i for i in range(1, 9)), int(need)}):
            if k <= need and len(start):  # at least k of the rarest tokens
                rare = np.concatenate([[0], np.cumsum(rank < lacking + k)])
                start = start[rare[end[start]] - rare[start] >= k]
        if not len(start):
            continue
        held = end[start] - start
        overlap = np.zeros(len(start), np.int64)
        for d in range(int(held.max())):
            at = np.minimum(start + d, len(mine) - 1)
            overlap += (d < held) & (before[mine[at]] < p[start])
        good = overlap >= need
        start = start[good]
        if len(start):
            rows = row[mine[start]]
            yield t, rows, overlap[good], p[start] - rows * gap, p[end[start] - 1] - rows * gap


def matches(found: np.ndarray, row: np.ndarray, token: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, template, overlap, first, last) of every notice: of blocks that overlap, the one with the largest overlap, then the shortest run, then the first."""
    out = []
    for t, rows, overlap, first, last in blocks(found, row, token, index):
        furthest = np.maximum.accumulate(last + rows * (int(last.max()) + 2)) - rows * (int(last.max()) + 2)  # of this row's blocks so far
        new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (first[1:] > furthest[:-1])])
        cluster = np.cumsum(new)
        best = np.lexsort((first, last - first, -overlap, cluster))
        best = best[np.concatenate([[True], cluster[best[1:]] != cluster[best[:-1]]])]
        out += zip(rows[best].tolist(), [t] * len(best), overlap[best].tolist(), first[best].tolist(), last[best].tolist(), strict=True)
    return out


def standing(found: list[tuple[int, int, int, int]], sizes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Of one text's (template, overlap, first, last), those that give way to no better one."""
    order = sorted(found, key=lambda m: (-m[1] / sizes[m[0]], -m[1], m[0], m[2]))
    kept = []
    for i, m in enumerate(order):
        shared = (min(m[3], b[3]) - max(m[2], b[2]) + 1 > (min(m[3] - m[2], b[3] - b[2]) + 1) / 2 for b in order[:i])
        if not any(shared):
            kept.append(m)
    return kept


def phrase_places(hashes: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Indexes of the words at which the phrase starts, within one row."""
    k = len(phrase)
    at = np.flatnonzero(hashes[: len(hashes) - k + 1] == phrase[0]) if len(hashes) >= k else np.zeros(0, np.int64)
    for j in range(1, k):
        at = at[hashes[at + j] == phrase[j]]
    return at[row[at] == row[at + k - 1]]


_NOTICE = {"label": pa.string(), "template": pa.int32(), "overlap": pa.int32(), "size": pa.int32(), "first_word": pa.int64(), "last_word": pa.int64()}
_NOTICES = pa.list_(pa.struct(list(_NOTICE.items())))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label: string, template: int, overlap: int, size: int, first_word: long, last_word: long>>"


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: words, places of the base phrases, labels of phrases and of matching blocks, and notices, the blocks' templates, overlaps and runs (words from 0).

    score is 1 where a base phrase stands, else the largest containment of a template in a block that meets the threshold, else 0.
    """
    spark = docs.sparkSession
    workers_find_package(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = vocabulary_of(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for c in chunks(batch.column(0)):
                c = c.lowered()
                first, last, row = c.words(WORD)
                pairs, at = ngram_hashes(c.hashes(first, last), row, 2)
                found, token = template_tokens(pairs, vocabulary)
                total += np.bincount(np.unique(row[at[found]] * len(vocabulary) + token) % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_pydict({"token": pa.array(np.arange(len(total))), "n": pa.array(total)})

    counted = texts.select("text").mapInArrow(lean(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    frequency = np.zeros(len(vocabulary), np.int64)
    for token, n in counted.collect():  # a row for each token of the fixed templates
        frequency[token] = n
    index = build_index(templates, frequency, threshold)
    base = [(label, word_keys(bytes_words(p))) for label, p in phrases]
    sizes = index.sizes

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                low = c.lowered()
                first, last, row = low.words(WORD)
                hashes = low.hashes(first, last)
                places = [(label, phrase_places(hashes, row, p)) for label, p in base]
                own, more = [set() for _ in range(c.n)], [set() for _ in range(c.n)]
                score = np.zeros(c.n)
                for label, at in places:
                    for r in np.unique(row[at]):
                        own[r].add(label)
                        score[r] = 1.0
                pairs, at = ngram_hashes(hashes, row, 2)
                found, token = template_tokens(pairs, index.vocabulary)
                of: dict[int, list] = {}
                for r, *m in matches(at[found], row[at[found]], token, index):
                    of.setdefault(r, []).append(tuple(m))
                notices = [[] for _ in range(c.n)]
                start = np.searchsorted(row, np.arange(c.n))
                for r, listed in of.items():
                    for t, n, a, b in standing(listed, sizes):
                        more[r].add(index.labels[t])
                        score[r] = max(score[r], n / sizes[t])
                        notices[r].append({"label": index.labels[t], "template": t, "overlap": n, "size": int(sizes[t]), "first_word": int(a - start[r]), "last_word": int(b - start[r]) + 1})
                every = np.sort(np.concatenate([at for _, at in places])) if places else np.zeros(0, np.int64)
                every_row = row[every]
                n_base = np.bincount(every_row, minlength=c.n)
                with_base = n_base > 0
                ends = np.cumsum(n_base)
                lowest, highest = np.zeros(c.n, np.int64), np.zeros(c.n, np.int64)
                lowest[with_base] = every[(ends - n_base)[with_base]] - start[with_base]
                highest[with_base] = every[(ends - 1)[with_base]] - start[with_base]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(c.row, c.n), "n_words": pa.array(np.bincount(row, minlength=c.n)), "n_base": pa.array(n_base),
                    "first_word": pa.array(lowest, mask=~with_base), "last_word": pa.array(highest, mask=~with_base),
                    "base_labels": pa.array([",".join(sorted(x)) for x in own]), "labels": pa.array([",".join(sorted(x | y)) for x, y in zip(own, more, strict=True)]), "score": pa.array(score),
                    "notices": pa.array([sorted(x, key=lambda m: (m["first_word"], m["template"])) for x in notices], _NOTICES),
                })

    return texts.mapInArrow(lean(scan), SCHEMA)
