"""Whole texts to token ids with the tokenizers library, each distinct pre-token encoded once.

A BPE model never merges across pre-tokens, so a text's ids are its pre-tokens' ids in order. The pre-tokens are found with the file's own pattern and their ids kept in
a bounded memo, which the library fills. This holds for texts of plain Latin characters, on which the pattern, lower case and NFC mean
the same here and in the library; every other text goes to the library whole. Strings of special tokens count as ordinary text.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import numpy as np
from tokenizers import Tokenizer

#: Characters that NFC leaves alone, whose classes do not depend on the Unicode version and whose lower case is one such character.
_PLAIN = [chr(c) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)) if c != 0xAD and len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 0x250]
#: Fixed value: the pattern of byte-level pre-tokenization.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _class(kind: str) -> str:
    """The plain characters of a general category, as the inside of a character class."""
    return "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind)


def _plain_pattern(pattern: str) -> re.Pattern:
    """The same pattern for plain texts."""
    for kind in "LN":
        pattern = pattern.replace(f"[\\p{{{kind}}}]", f"\\p{{{kind}}}")
    outside = re.escape(r"[^\s\p{L}\p{N}]")
    pattern = re.sub(outside, lambda _: f"[^\\s{_class('L')}{_class('N')}]", pattern)
    for kind in "LN":
        pattern = pattern.replace(f"\\p{{{kind}}}", f"[{_class(kind)}]")
    return re.compile(pattern)


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level models use for each byte: itself if it prints, else the next free one from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_ALL_PLAIN = re.compile(f"[{re.escape(''.join(_PLAIN))}]*")

_held: dict[str, Encoder] = {}


class _Memo(dict):
    """Ids of pre-tokens. When it is full, it becomes the old generation, from which what is met again is taken over."""

    def __init__(self, tokenizer: Tokenizer, kind: str):
        super().__init__()
        self.model, self.kind, self.old = tokenizer.model, kind, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            # ASCII letters and digits are their own letters.
            letters = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(_LETTERS)
            ids = struct.pack(f"<{len(found := self.model.tokenize(letters))}{self.kind}", *[t.id for t in found])
        self[piece] = ids
        return ids

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()


class Encoder:
    """ids(text) is the little-endian array of a text's ids, as 16-bit integers if the vocabulary allows it, else 32-bit."""

    def __init__(self, path: str, limit: int = 400_000):
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.limit = limit
        self.memo = _Memo(self.tokenizer, "H" if self.dtype.itemsize == 2 else "I")
        self.pattern, self.lower = self._pattern(form)

    @staticmethod
    def _pattern(form: dict) -> tuple[re.Pattern | None, bool]:
        normalizer, pre = form.get("normalizer"), form.get("pre_tokenizer") or {}
        if normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return _plain_pattern(_BYTE_LEVEL), False
        steps = [x["type"] for x in (normalizer or {}).get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and len(parts) == 2 and parts[0].get("behavior") == "Removed" and parts[0].get("invert"):
            return _plain_pattern(parts[0]["pattern"]["Regex"]), True
        return None, False

    def ids(self, text: str) -> bytes:
        if self.pattern is None or not _ALL_PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if len(self.memo) > self.limit:
            self.memo.turn()
        return b"".join(map(self.memo.__getitem__, self.pattern.findall(text.lower() if self.lower else text)))


def encoder(path: str) -> Encoder:
    """One for each file and Python process."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]
