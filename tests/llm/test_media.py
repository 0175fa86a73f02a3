"""Payloads to images and back, and sequences of pages."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalboard.llm import media as M

from .conftest import ODD, documents


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000))
def test_images_are_lossless(body):
    payload = M.padded(body)
    image = M.png(payload)
    assert len(payload) % 192 == 0 and payload and M.samples(image).tobytes() == payload and payload.rstrip(b" ").startswith(body.rstrip(b" "))
    assert len(M.brightness_hash(M.samples(image))) == 16


def test_damage_is_seen():
    image = bytearray(M.png(M.padded(b"x" * 500)))
    image[60] ^= 1
    with pytest.raises(ValueError):
        M.samples(bytes(image))
    with pytest.raises(ValueError):
        M.samples(b"GIF89a")


def test_texts(spark):
    texts = [*ODD, "same text", "same text"]
    got = {x["doc_id"]: x for x in M.text_media(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        body = (t or "").encode()
        payload = body + b" " * (-len(body) % 192 or (192 if not body else 0))
        x = got[i]
        image = M.png(payload)
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (x["media_bytes"], x["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        assert (x["position"], x["caption"], x["texts"], x["n_items"]) == (1, f"{len(body)} bytes of text", ["A text", "and, below, its columns", "end"], 5)
        small = M.overview(payload)
        assert (x["overview_position"], x["overview_caption"], x["overview_sha256"]) == (3, "mean of each column", hashlib.sha256(small).hexdigest()) and len(small) == 192
    assert got[len(texts) - 1]["feature"] == got[len(texts) - 2]["feature"]


def test_sequences_keep_order_positions_and_captions(spark):
    html = '<h1>Title &amp; more</h1><p>one <b>two</b></p><figure><img src="sha256:aa"><img src="sha256:bb" alt="b"><figcaption>both</figcaption></figure>three<img src="u" alt="alone"><script>no</script><video src="sha256:zz">'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>unclosed <img src='sha256:aa'")], "page long, html string")
    sequences = M.parse_sequences(pages, "page")
    got = {r["page"]: [(x["position"], x["kind"], x["text"], x["digest"], x["caption"]) for x in r["items"]] for r in sequences.collect()}
    assert [x[1:3] for x in got[1]] == [("text", "Title & more"), ("text", "one two"), ("media", None), ("media", None), ("text", "three"), ("media", None), ("media", None)]
    assert [x[0] for x in got[1]] == list(range(7)) and [x[4] for x in got[1] if x[1] == "media"] == ["both", "both", "alone", None] and got[2] == []
    payloads = spark.createDataFrame([("aa", 7), ("bb", 8)], "digest string, size int")
    resolved = M.resolve(sequences, "page", payloads)
    assert {(r["page"], r["position"]): r["size"] for r in resolved.collect()} == {(1, 2): 7, (1, 3): 8, (1, 5): None, (1, 6): None}
    whole = {r["page"]: [(x["position"], x["text"], x["payload"] and x["payload"]["size"], x["caption"]) for x in r["items"]] for r in M.sequences_of(resolved, sequences, "page").collect()}
    assert whole[1] == [(0, "Title & more", None, None), (1, "one two", None, None), (2, None, 7, "both"), (3, None, 8, "both"), (4, "three", None, None), (5, None, None, "alone"), (6, None, None, None)] and whole[2] == []


@pytest.mark.parametrize(
    ("html", "items"),
    [
        ("<figure><figcaption>first <b>the</b> words</figcaption><img src=a></figure>after", [("a", "first the words"), "after"]),
        ("<figure><img src=a alt=x><figcaption>never closed</figure><p>after</p>", [("a", "never closed"), "after"]),
        ("<figure><img src=a alt=x><figcaption>never closed<p>more text</p><img src=b>end", [("a", "x"), "never closed", "more text", ("b", None), "end"]),
        ("<figure><img src=a><figure><img src=b><figcaption>in</figcaption></figure><figure><img src=c></figure><figcaption>out</figcaption></figure>", [("a", "out"), ("b", "in"), ("c", "out")]),
        ("<figure><p>no media</p><figcaption>but a caption</figcaption></figure>", ["no media", "but a caption"]),
        ("<figcaption>alone</figcaption></figure>x</figure>", ["alone", "x"]),
        ("<img srcset='s1.png 1x, s2.png 2x'><picture><source srcset='w.webp 1x'><img src=p></picture><picture><source srcset='v.webp 1x'><img alt=q></picture>", [("s1.png", None), ("p", None), ("v.webp", "q")]),
        ("<video><source src=m><source src=n></video><audio src=o>text", [("m", None), ("n", None), ("o", None), "text"]),
        ("<img>here", [(None, None), "here"]),
        ("<p>a<script>no</script>b<style>no", ["ab"]),
    ],
)
def test_markup_loses_nothing(html, items):
    digest = lambda u: u and hashlib.sha256(u.encode()).hexdigest()
    assert [x["text"] if x["kind"] == "text" else (x["digest"], x["caption"]) for x in M.interleave(html)] == [x if isinstance(x, str) else (digest(x[0]), x[1]) for x in items]


def test_odd_rows(odd, empty):
    assert M.text_media(odd).count() == odd.count() and M.text_media(empty).count() == 0
    assert np.array_equal(M.samples(M.png(b" " * 192)), np.full((1, 192), 32))


def test_unclosed_script_swallows_nothing():
    page = "<p>one</p><script>var a = '<script>';</script><p>two</p><style>p {}<p>three</p><img src=x><script>4</script><!-- <script> --> five"
    items = M.interleave(page)
    assert [x["text"] for x in items if x["kind"] == "text"] == ["one", "two", "three", "five"] and sum(x["kind"] == "media" for x in items) == 1
    assert [x["text"] for x in M.interleave("<SCRIPT src=a>x<b>y")] == ["y"] and M.interleave("<script>x</script >") == []


def test_pages_against_plain_text(spark):
    """All words outside of tags, scripts and comments, in order, and all images."""
    from html import unescape
    from pathlib import Path

    table = "/root/testdata/sf0.001/pages.parquet"
    if not Path(table).exists():
        pytest.skip("no test tables")
    import re

    for page in spark.read.parquet(table).collect():
        bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", " ", page["html"] or "")
        items = M.interleave(page["html"])
        assert sum(x["kind"] == "media" for x in items) == len(re.findall(r"(?i)<(?:img|audio|video)\b", bare))
        plain = unescape(re.sub(r"<[^>]*>", "", re.sub(r"(?i)</?(?:p|div|h\d|ul|ol|li|br|hr|article|section|main|header|footer|nav|aside|table|tr|td|th|title|body|blockquote|pre|figure|figcaption)\b[^>]*>", " ", bare)))
        said = " ".join(x["text"] for x in items if x["kind"] == "text")
        assert said.split() == plain.split()


def test_stored_images_go_once_read_back(spark, monkeypatch):
    kept = []
    make = M.store_texts
    monkeypatch.setattr(M, "store_texts", lambda docs: kept.append(make(docs)) or kept[-1])
    from evalboard.llm import runtime

    rows = M.text_media(documents(spark, ["a text", None, "a text"])).collect()
    assert len(rows) == 3 and all(r["payload_bytes"] == 192 for r in rows)
    assert kept[0]._evalboard_path not in runtime._written
