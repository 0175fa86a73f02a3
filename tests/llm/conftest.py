"""Small document tables of the cases that every operator must handle."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

PROSE = (
    "Ships came slowly into the old harbour while rain fell over the grey roofs of the town.",
    "Nobody on the quay had expected them before spring, and the few who looked up said little.",
    "Later the captains told how ice had held them for weeks beyond the northern islands.",
)


def documents(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", "   \n\t ", "word", "two words", "é ü ß — «x» 漢字 😀", "a" * 5000, "x\n" * 300, " ".join(PROSE) + "\n" + "\n".join(PROSE), "\x00\x01 odd\x85controls\xa0here", "<|endoftext|> ordinary"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, a repeated row."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else "s", None) for i, t in enumerate([*ODD, "long " * 30_000])]
    rows += [rows[8], rows[8], (None, PROSE[0] + " " + PROSE[1], None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
