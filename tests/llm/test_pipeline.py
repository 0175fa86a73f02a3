"""Each stage of the pipeline on its predecessor's rows, against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from evalboard.llm.encoding import encoder
from evalboard.llm.queries import LINES, tokenizer

from .conftest import SCHEMA
from .test_langid import prose
from .test_linededup import plain as plain_lines
from .test_minhash import plain as plain_groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(7)
    texts = ["\n".join(prose(lang, r, r.randint(8, 40)) for _ in range(r.randint(1, 4))) for lang in ("en", "fr") * 40]
    texts += [texts[0], texts[1].replace(" ", "  "), texts[2] + " more", "1234 !!", None, "", texts[3].split("\n")[0] + "\n" + texts[4]]
    rows = [(i, t, "fr" if i % 2 else "en", f"src{i % 10}", len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs.orderBy("doc_id").collect()
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.orderBy("doc_id").collect()
        texts = [r["text"] for r in before]
        ids = [r["doc_id"] for r in before]
        if name != "packing":
            assert docs.columns == columns
        if name == "language":
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in rows}
            assert gone == {r["doc_id"] for r in before if not any(c.isalpha() for c in r["text"] or "")}
        elif name == "lines":
            drop = plain_lines(texts, LINES)
            want = {ids[i]: "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in drop) for i, t in enumerate(texts)}
            assert {r["doc_id"]: r["text"] for r in rows} == {k: v for k, v in want.items() if v.strip()}
        elif name == "near_duplicates":
            assert [r["doc_id"] for r in rows] == [ids[i] for i, (_, _, kept) in plain_groups(texts, 5, 80).items() if kept]
        elif name == "mix":
            assert {r["doc_id"] for r in rows} <= set(ids) and sum(len(r["text"].split()) for r in rows) <= 0.9 * sum(len(t.split()) for t in texts) + 20 * 200
        else:
            e = encoder(tokenizer("byte_bpe_50k.json"))
            assert sum(r["length"] for r in rows) == sum(len(np.frombuffer(e.ids(t), e.dtype)) + 1 for t in texts)


def test_odd_tables(spark, odd, empty, tmp_path):
    """Nulls in any column, repeated rows, a very long text, names that operators use themselves; and no row at all."""
    extra = [F.lit(i).alias(n) for i, n in enumerate(["drop", "score", "lang_pred", "kept", "key", "n0", "cut", "component", "text_hash"])]
    for k, docs in enumerate((odd.select("*", *extra), empty.select("*", *extra))):
        columns, n = docs.columns, docs.count()
        for name, stage in P.STAGES:
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
            if name != "packing":
                assert sorted(docs.columns) == sorted(columns) and docs.count() <= 2 * n
                assert docs.filter("text is null").count() == 0
            if name == "near_duplicates" and k == 0:
                assert docs.filter("doc_id is null").count() == 1
        assert (docs.count() > 0) == (k == 0)


def test_run(spark, folder):
    assert P.run(spark, folder).count() > 0 and [n for n, _ in P.STAGES] == ["language", "lines", "near_duplicates", "mix", "packing"] and P.ORACLE_SQL is None
