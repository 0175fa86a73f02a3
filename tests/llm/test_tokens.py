"""Encoding, packing and token files against the library."""

from __future__ import annotations

import random
import zlib
from itertools import islice, product
from string import ascii_lowercase

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalboard.llm import tokenfile as T
from evalboard.llm.encoding import Encoder, encoder
from evalboard.llm.packing import PackingPlan, pack_documents, pack_round
from evalboard.llm.tokenfile import pack_blocks, read_segment, read_tokens, token_files, unpack_blocks, write_segment, write_tokens

from .conftest import ODD, PROSE, documents

FILES = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json")]


@pytest.mark.parametrize("path", FILES)
@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FF), st.sampled_from("'stremvdl \n\t!ABÉßİΣς1²漢😀́")), max_size=60))
def test_memo_gives_the_library_s_ids(path, text):
    e = encoder(path)
    assert np.frombuffer(e.ids(text), e.dtype).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_memo_turns_over():
    e = encoder(FILES[0])
    limit, e.limit = e.limit, 5
    try:
        for t in PROSE * 3:
            assert np.frombuffer(e.ids(t), e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
    finally:
        e.limit = limit


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60))
def test_windows_are_full_and_tokens_lie_in_one_piece(lengths):
    seen = [np.zeros(n, int) for n in lengths]
    for w in pack_round(lengths, 1024):
        size = sum(n for _, _, n in w)
        assert size <= 1024 and size & (size - 1) == 0
        for doc, start, n in w:
            seen[doc][start : start + n] += 1
    assert all((s == 1).all() for s in seen)


def test_packing(spark):
    e = encoder(FILES[0])
    texts = [*ODD, *[" ".join(random.Random(i).choices(" ".join(PROSE).split(), k=i * 7 % 900)) for i in range(80)]]
    docs = documents(spark, texts)
    for plan in (PackingPlan(), PackingPlan(round_documents=7)):
        rows = pack_documents(docs, FILES[0], plan=plan, with_ids=True).collect()
        found: dict[int, dict[int, bytes]] = {}
        sequences: dict[int, list] = {}
        for r in rows:
            found.setdefault(r["doc_id"], {})[r["start"]] = bytes(r["ids"])
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["context"]))
            assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        for i, t in enumerate(texts):
            want = np.array([*np.frombuffer(e.ids(t or ""), e.dtype), 0], "<u4")
            assert b"".join(found[i][k] for k in sorted(found[i])) == want.tobytes()
        for pieces in sequences.values():
            at = 0
            for offset, n, context in sorted(pieces):
                assert offset == at
                at += n
            assert at == context
        steps: dict[int, dict[int, int]] = {}
        for r in rows:
            steps.setdefault(r["step"], {})[r["sequence_id"]] = r["context"]
        assert all(sum(s.values()) <= 8192 for s in steps.values())


def test_steps_are_balanced_over_all_tasks(spark):
    texts = [" ".join(random.Random(i).choices(" ".join(PROSE).split(), k=i * 37 % 1500)) for i in range(300)]
    plan = PackingPlan(round_documents=20, step_tokens=4096)
    rows = pack_documents(documents(spark, texts).repartition(7, "doc_id"), FILES[0], plan=plan).select("sequence_id", "context", "step").distinct().collect()
    n = max(r["step"] for r in rows) + 1
    of = [[r["context"] for r in rows if r["step"] == k] for k in range(n)]
    loads = [sum(x) for x in of]
    assert n > 20 and max(loads) <= 4096 and max(loads) - min(loads) <= 1024
    for context in {r["context"] for r in rows}:
        counts = [x.count(context) for x in of]
        assert max(counts) - min(counts) <= 1
    with pytest.raises(ValueError):
        pack_documents(documents(spark, texts), FILES[0], plan=PackingPlan(step_tokens=1024))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, (1 << 32) - 1)), max_size=1500), st.sampled_from([0.5, 0.9, 0.98, 1.0]))
def test_blocks_round_trip(values, percentile):
    ids = np.array(values, np.uint32)
    starts, body = pack_blocks(ids, percentile)
    assert np.array_equal(unpack_blocks(starts, body, len(ids)), ids)
    docs, lengths, back = read_segment(write_segment([None, 7], [0, len(ids)], ids, percentile))
    assert docs == [None, 7] and lengths.tolist() == [0, len(ids)] and np.array_equal(back, ids)


def test_outliers_do_not_widen_a_block():
    ids = np.full(512, 9, np.uint32)
    ids[5] = 1 << 30
    assert len(pack_blocks(ids, 0.98)[1]) < 32
    with pytest.raises(ValueError):
        read_segment(b"something else altogether.......")


def test_token_files(spark, tmp_path):
    e = encoder(FILES[1])
    texts = [*ODD, *(" ".join(PROSE[: i % 4]) for i in range(300))]
    docs = documents(spark, texts).repartition(5, "source")
    write_tokens(docs, str(tmp_path / "t"), FILES[1], segment_ids=500)
    start = 0
    got = {r["doc_id"]: r for r in read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect()}
    for i, t in enumerate(texts):
        want = np.array([*np.frombuffer(e.ids(t or ""), e.dtype), 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"], bytes(got[i]["ids"])) == (start, len(want), zlib.crc32(want.tobytes()), want.tobytes())
        start += len(want)


def test_odd_rows(odd, empty):
    assert pack_documents(odd, FILES[0]).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count() and pack_documents(empty, FILES[0]).count() == 0
    rows = token_files(odd, FILES[1]).orderBy("start").collect()
    assert len(rows) == odd.count() and rows[0]["doc_id"] is None and token_files(empty, FILES[1]).count() == 0


def test_one_id_of_many_rows_spans_parts(spark, tmp_path):
    rows = [(None, f"text {i % 7} of no id") for i in range(300)] + [(5, "same") for _ in range(300)] + [(i, f"row {i}") for i in range(10, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_tokens(docs, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = {r["part"]: r["n"] for r in spark.read.parquet(str(tmp_path / "t")).groupBy("part").agg({"n_ids": "sum"}).withColumnRenamed("sum(n_ids)", "n").collect()}
    assert len(parts) >= 3 and max(parts.values()) < 0.6 * sum(parts.values())
    got = read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]


def test_pieces_of_a_worker_are_tokenized_once():
    encode = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    model, calls = encode.memo.model, []

    class Counted:
        def tokenize(self, piece):
            calls.append(piece)
            return model.tokenize(piece)

    encode.memo.model = Counted()
    words = ["".join(w) for w in islice(product(ascii_lowercase, repeat=4), 300_000)]
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    assert [encode.ids(t) for t in texts] == [encode.ids(t) for t in texts]
    assert len(calls) == len(set(calls))


def test_blocks_of_whole_bytes_are_those_of_any_width():
    values = np.random.default_rng(3).integers(0, 256, (5, T.BLOCK)).astype(np.uint32)
    for width in (8, 16, 32):
        fast, whole = T._pack(values, width), T._WHOLE
        try:
            T._WHOLE = ()
            assert (T._pack(values, width) == fast).all() and (T._unpack(fast, width) == values).all()
        finally:
            T._WHOLE = whole
        assert (T._unpack(fast, width) == values).all()
