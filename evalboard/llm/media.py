"""Media columns as interleaved document sequences.

HTML is parsed to an ordered array of text and media-reference structs; references name a payload by digest ("sha256:<hex>"),
and a join on the digest resolves them, so that position, reference and caption stay in one struct throughout.
Payload bytes never pass a shuffle: what is wanted of a payload is computed where its stored bytes are read, once for each digest,
and only that row is joined. The join is a plain equi-join of two written tables, which adaptive execution splits at a hot digest.

Payloads are stored as 8-bit greyscale PNG images, 192 samples wide, in a Parquet column.

Defined cases: null HTML has an empty sequence; a reference without an address has a null digest; broken markup loses no text; null or empty text has a payload of 192 spaces; a reference without a stored payload keeps
its place with null results; repeated rows each get their own, equal result; an empty table gives an empty result;
columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import chunks
from .runtime import free, lean, sweep, workers_find_package, written

WIDTH = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"


def padded(payload: bytes) -> bytes:
    """With spaces up to a positive multiple of 192 bytes."""
    return payload + b" " * (max(1, -(-len(payload) // WIDTH)) * WIDTH - len(payload))


def _part(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(payload: bytes) -> bytes:
    """A lossless 8-bit greyscale image of a payload whose length is a positive multiple of 192."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # a filter byte 0 leads each row
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return _SIGNATURE + _part(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _part(b"IEND", b"")


def samples(image: bytes) -> np.ndarray:
    """The rows of an image written by png(); raises ValueError for any other or a damaged one."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, packed, shape = 8, [], (0, 0)
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a part of the image is damaged")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit greyscale")
            shape = (height, width)
        elif kind == b"IDAT":
            packed.append(body)
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return rows[:, 1:]


def brightness_hash(rows: np.ndarray) -> str:
    """64 bits in hex: which cells of an 8 x 8 grid are brighter than the grid's mean."""
    columns = rows.reshape(len(rows), 8, -1).sum(2, dtype=np.int64)
    edges = np.arange(8) * len(rows) // 8
    sizes = np.maximum(np.diff(np.append(edges, len(rows))), 1)
    grid = np.add.reduceat(columns, edges, axis=0) / sizes[:, None]
    return np.packbits(grid > grid.mean()).tobytes().hex()


BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd br hr blockquote pre article section main header footer nav aside table tr td th title body".split())
MEDIA = frozenset(("img", "audio", "video", "source"))


@dataclass
class _Figure:
    """An open figure: its media, and its caption's text items (open: whether the caption goes on)."""

    media: list[dict] = field(default_factory=list)
    caption: list[dict] = field(default_factory=list)
    open: bool = False


class _Sequence(HTMLParser):
    """Text runs and media references in document order.

    A figure's caption, wherever in the figure it stands, goes to its references, and to those of figures within that have none. Its text is an ordinary item until the figure
    ends, and stays one if the figure never does or holds no media, so broken markup loses no text.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.buffer: list[str] = []
        self.figures: list[_Figure] = []
        self.hidden: list[str] = []
        self.alternatives: list[str] | None = None  # of an open picture

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})
            if self.figures and self.figures[-1].open:
                self.figures[-1].caption.append(self.items[-1])

    def media(self, url: str, alt: str | None) -> None:
        digest = url.removeprefix("sha256:") if url.startswith("sha256:") else hashlib.sha256(url.encode("utf-8", "replace")).hexdigest() if url else None
        self.items.append({"kind": "media", "text": None, "digest": digest, "caption": alt})
        if self.figures:
            self.figures[-1].media.append(self.items[-1])

    def end_figure(self) -> None:
        self.flush()
        figure = self.figures.pop()
        caption = " ".join(x["text"] for x in figure.caption)
        if caption and figure.media:
            gone = {id(x) for x in figure.caption}
            self.items = [x for x in self.items if id(x) not in gone]
            for x in figure.media:
                x["caption"] = caption
        elif self.figures:  # an outer caption may stand for these
            self.figures[-1].media += figure.media

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden.append(tag)
        elif tag == "figure":
            self.flush()
            self.figures.append(_Figure())
        elif tag == "figcaption":
            self.flush()
            if self.figures:
                self.figures[-1].open = True
        elif tag == "picture":
            self.alternatives = []
        elif tag in MEDIA:
            self.flush()
            a = dict(attrs)
            url = (a.get("src") or (a.get("srcset") or "").strip().split(",")[0].split(" ")[0]).strip()
            if tag == "source" and self.alternatives is not None:
                self.alternatives.append(url)  # the same image in another form: the picture's img is the reference
            elif tag == "img":
                self.media(url or next(filter(None, self.alternatives or ()), ""), a.get("alt"))
            elif url:  # without one, a player's sources are the references
                self.media(url, None)
        elif tag in BLOCKS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            if self.hidden:
                self.hidden.pop()
        elif tag == "figcaption":
            self.flush()
            if self.figures:
                self.figures[-1].open = False
        elif tag == "figure":
            if self.figures:
                self.end_figure()
        elif tag == "picture":
            self.alternatives = None
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.buffer.append(data)


_HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b[^>]*>", re.IGNORECASE | re.DOTALL)


def closed(html: str) -> str:
    """Without the script and style tags that are never closed, which would swallow the rest of the page; only what stands before the next tag goes with one."""
    at = 0
    while tag := _HIDDEN.search(html, at):
        end = re.compile(rf"</{tag[1]}\b", re.IGNORECASE).search(html, tag.end()) if tag[1] else tag  # comments are skipped
        if end:
            at = end.end()
        else:
            rest = html.find("<", tag.end())
            html, at = html[: tag.start()] + (html[rest:] if rest >= 0 else ""), tag.start()
    return html


def interleave(html: str | None) -> list[dict]:
    """The ordered items of one page."""
    p = _Sequence()
    p.feed(closed(html or ""))
    p.close()
    p.flush()
    return [{"position": i} | x for i, x in enumerate(p.items)]


def parse_sequences(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """id and items, an ordered array of text and media-reference structs."""
    workers_find_package(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    out = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([interleave(x) for x in batch.column(1).to_pylist()], out)], names=[id_col, "items"])

    return pages.select(id_col, html_col).mapInArrow(lean(run), f"{id_col} {kind}, items array<{ITEM}>")


def resolve(sequences: DataFrame, id_col: str, payloads: DataFrame) -> DataFrame:
    """A row for each media reference with its position and caption, and the columns of payloads (unique by digest) that its digest names."""
    refs = sequences.select(id_col, F.explode("items").alias("item")).filter("item.kind = 'media'").select(id_col, "item.position", "item.caption", "item.digest")
    return refs.join(payloads, "digest", "left")


def sequences_of(resolved: DataFrame, sequences: DataFrame, id_col: str) -> DataFrame:
    """id and items, whole sequences again: `payload` of each media item has what resolve() found for its reference, by position. A task holds one page's references. Ids must differ."""
    facts = [c for c in resolved.columns if c not in (id_col, "position", "caption", "digest")]
    found = resolved.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct(*facts)))).alias("_found"))
    items = F.transform("items", lambda x: x.withField("payload", F.element_at("_found", x["position"])))
    return sequences.join(found, id_col, "left").select(id_col, items.alias("items"))


def per_payload(store: DataFrame, columns: dict[str, str], of: Callable[[bytes], dict]) -> DataFrame:
    """digest and what of() computes from the stored bytes, a row for each digest; store: digest, image."""
    workers_find_package(store.sparkSession)
    schema = "digest string, " + ", ".join(f"{k} {v}" for k, v in columns.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [of(x.as_buffer().to_pybytes()) for x in part.column(1)]
                yield pa.RecordBatch.from_pydict({"digest": part.column(0)} | {k: pa.array([r[k] for r in rows]) for k in columns})

    return store.select("digest", "image").mapInArrow(lean(run), schema).dropDuplicates(["digest"])


def facts(image: bytes) -> dict:
    """What op8 returns of a stored payload."""
    rows = samples(image)
    payload = rows.tobytes()
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
        "media_bytes": len(image), "media_sha256": hashlib.sha256(image).hexdigest(), "feature": brightness_hash(rows),
    }


FACTS = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}


def overview(payload: bytes) -> bytes:
    """A small image of a payload: one row of 192 samples, each the mean of its column."""
    return np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).mean(0).astype(np.uint8).tobytes()


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts as stored images, and a page for each document that shows its image and a small overview of it between lines of text: written as row, doc_id, n_bytes, html, media (digest, image).

    An image is null where an earlier row of the same batch stored the digest already. row numbers the rows.
    """
    workers_find_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            seen: set[str] = set()
            for c in chunks(batch.column(1)):
                sizes, pages, stored = [], [], []
                for i in range(c.n):
                    body = padded(c.text(i))
                    sizes.append(int(c.ends[i] - c.starts[i]))
                    media = []
                    for payload in (body, overview(body)):
                        digest = hashlib.sha256(payload).hexdigest()
                        media.append({"digest": digest, "image": None if digest in seen else png(payload)})
                        seen.add(digest)
                    main, small = (f'<img src="sha256:{m["digest"]}"' for m in media)
                    pages.append(f'<article><h1>A text</h1><figure>{main}><figcaption>{escape(f"{sizes[-1]} bytes of text")}</figcaption></figure><p>and, below, its columns</p>{small} alt="mean of each column"><p>end</p></article>')
                    stored.append(media)
                kind = pa.list_(pa.struct([("digest", pa.string()), ("image", pa.binary())]))
                yield pa.RecordBatch.from_pydict({"row": pa.array(np.arange(number, number + c.n)), "doc_id": batch.column(0).slice(c.row, c.n), "n_bytes": pa.array(sizes, pa.int64()), "html": pa.array(pages, pa.string()), "media": pa.array(stored, kind)})
                number += c.n

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(texts.mapInArrow(lean(run), "row long, doc_id long, n_bytes long, html string, media array<struct<digest:string,image:binary>>"), "media", "zstd")


def text_media(docs: DataFrame) -> DataFrame:
    """A row for each document: the facts of its payload as read back from the store, its place in the page and its caption, and the page's texts and the facts of its other image in order."""
    store = store_texts(docs)
    images = store.select(F.explode("media").alias("m")).select("m.digest", "m.image").filter("image is not null")
    payloads = written(per_payload(images, FACTS, facts), "payloads", "zstd")
    sweep(docs.sparkSession)  # the shuffle files of the facts go
    pages = store.select(F.struct("row", "doc_id", "n_bytes").alias("id"), "html")
    sequences = written(parse_sequences(pages, "id"), "sequences", "zstd")
    free(store)  # its images have been read back and its pages parsed
    sweep(docs.sparkSession)
    bare = sequences.withColumn("items", F.transform("items", lambda x: x.dropFields("digest")))  # payloads stand for their digests
    items = sequences_of(resolve(sequences, "id", payloads), bare, "id")
    shown = F.filter("items", lambda x: x["kind"] == "media")
    texts = F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"])
    rows = items.select("id", shown[0].alias("main"), shown[1].alias("small"), F.size("items").alias("n_items"), texts.alias("texts"))
    return rows.select("id.doc_id", "id.n_bytes", *[F.col("main.payload")[k].alias(k) for k in FACTS], "main.position", "main.caption", "n_items", "texts", F.col("small.position").alias("overview_position"), F.col("small.caption").alias("overview_caption"), F.col("small.payload.payload_sha256").alias("overview_sha256"))
