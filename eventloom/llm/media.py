"""Interleaved document sequences with content-addressed media.

HTML is parsed into ordered text and media-reference items; payloads live in a media store keyed by digest, written
as PNG images; joins on the digest resolve references, positions and captions stay with their items.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import mapped, stored

#: 64 RGB pixels a row.
ROW_BYTES = 192
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
ZLIB_LEVEL = 3
ITEM = "pos int, kind string, text string, media_ref string, caption string"


# --- payload and PNG -------------------------------------------------------------------------------------------
def payload_of(text: str | None) -> bytes:
    """UTF-8, filled with spaces up to a positive multiple of ROW_BYTES."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // ROW_BYTES)) * ROW_BYTES, b" ")


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_of(payload: bytes) -> bytes:
    """8-bit RGB, 64 pixels wide, a row per 192 bytes, no row filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    raw = np.zeros((len(rows), ROW_BYTES + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW_BYTES // 3, len(rows), 8, 2, 0, 0, 0)
    return PNG_HEAD + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), ZLIB_LEVEL)) + chunk(b"IEND", b"")


def samples_of(png: bytes) -> bytes:
    """The samples of a PNG as `png_of` writes them; checks signature, chunk sums and geometry."""
    if png[:8] != PNG_HEAD:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(png):
        (n,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's sum doesn't match")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] * 3 + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows aren't written here")
    return rows[:, 1:].tobytes()


def feature_of(samples: bytes) -> str:
    """Mean and deviation of the samples, then shares of 16 equal ranges, to 6 places."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x >> 4, minlength=16)
    return ",".join(f"{v:.6f}" for v in (x.mean(), x.std(), *(counts / len(x))))


# --- HTML to ordered items -------------------------------------------------------------------------------------
class Interleaver(HTMLParser):
    """Collects items in document order. An <img>, <audio> or <video> with a src is a media item; the <figcaption> of
    its <figure>, or else its alt text, is its caption."""

    BLOCKS = frozenset("p div article section h1 h2 h3 h4 h5 h6 li ul ol table tr td th blockquote pre figure figcaption br body html".split())
    HIDDEN = frozenset(("script", "style", "template", "noscript"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[dict] = []
        self.hidden = 0
        self.in_figure = False

    def flush(self) -> None:
        text = "".join(self.words).strip(" \t\n\r\f\v")
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "media_ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.HIDDEN:
            self.hidden += 1
        if tag in self.BLOCKS and self.caption is None:
            self.flush()
        given = dict(attrs)
        if tag == "figure":
            self.in_figure, self.figure = True, []
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "audio", "video") and given.get("src"):
            self.flush()
            item = {"kind": "media", "text": None, "media_ref": given["src"], "caption": given.get("alt")}
            self.items.append(item)
            if self.in_figure:
                self.figure.append(item)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.figure:
                item["caption"] = text
        elif tag == "figure":
            self.in_figure = False
        if tag in self.BLOCKS and self.caption is None:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def items_of(page: str | None) -> list[dict]:
    parser = Interleaver()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return [{"pos": i, **x} for i, x in enumerate(parser.items)]


def interleaved(pages: DataFrame, html: str = "html") -> DataFrame:
    """The other columns of `pages`, and items: array of (pos, kind text or media, text, media_ref, caption) in document order.

    A null or empty page gives an empty array; repeated rows each get theirs; a column named items is replaced. A map
    stage, no shuffle.
    """
    kept = [c for c in pages.columns if c not in (html, "items")]

    kind = pa.list_(pa.struct([("pos", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "media_ref", "caption"))]))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            items = pa.array([items_of(p) for p in part.column(html).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), items], [*kept, "items"])

    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField("items", T.ArrayType(T.StructType.fromDDL(ITEM)))])
    return mapped(pages, parsed, schema)


# --- store and resolution --------------------------------------------------------------------------------------
def stored_media(payload_texts: DataFrame, text: str = "text") -> DataFrame:
    """A media store (digest, media) of the payloads of all texts, written to the shared folder and read back.

    A slice of a batch writes equal payloads once; others may recur between slices with equal bytes, which costs space but no
    shuffle of payloads. `media_features` drops repeats when only small rows are left.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            new = {hashlib.sha256(p).hexdigest(): p for p in map(payload_of, part.column("_text").to_pylist())}
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.string()), pa.array([png_of(p) for p in new.values()], pa.binary())], ["digest", "media"])

    return stored(mapped(payload_texts.select(F.col(text).alias("_text")), made, "digest string, media binary"), "media")


def media_features(store: DataFrame) -> DataFrame:
    """One row per digest, all from the stored bytes; written, so that joins on a digest that many share can be split."""

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = []
            for media in part.column("media").to_pylist():
                x = samples_of(media)
                rows.append((len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(x)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("digest"), *columns], ["digest", *names])

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored(mapped(store, read, schema).dropDuplicates(["digest"]), "media-features")


def resolved(sequences: DataFrame, features: DataFrame) -> DataFrame:
    """One row per media item of `sequences` (as `interleaved` gives), joined by digest to its media.

    References are `cas:` and a digest; one that the store lacks keeps null columns. Only small rows are shuffled; a
    digest that many documents share is a skewed key of narrow rows, which adaptive execution splits. Columns of
    `sequences` with the names of the added ones are replaced.
    """
    item = F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("_item")
    kept = [c for c in sequences.columns if c not in ("items", "pos", "caption", *features.columns)]
    wanted = sequences.select(*kept, item).select(
        *kept, F.col("_item.pos").alias("pos"), F.col("_item.caption").alias("caption"), F.regexp_replace("_item.media_ref", "^cas:", "").alias("digest")
    )
    return wanted.join(features, "digest", "left")


def pages_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, html: every text as a page, a paragraph followed by a figure that refers to its payload."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sizes, pages = [], []
            for text in part.column("text").to_pylist():
                payload = payload_of(text)
                sizes.append(len((text or "").encode("utf-8", "surrogatepass")))
                ref = hashlib.sha256(payload).hexdigest()
                pages.append(f'<article><p>{html.escape(text or "", quote=False)}</p><figure><img src="cas:{ref}"><figcaption>{sizes[-1]} bytes</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(pages, pa.string())], ["doc_id", "n_bytes", "html"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), written, "doc_id long, n_bytes long, html string")
