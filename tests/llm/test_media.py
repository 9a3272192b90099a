from __future__ import annotations

import hashlib
import zlib

import edges
import numpy as np
import pytest

from eventloom.llm import media, queries


def test_png_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 191, 192, 193, 5_000):
        payload = media.payload_of("x" * n)
        assert len(payload) % 192 == 0 and payload
        assert media.samples_of(media.png_of(payload)) == payload
    noise = rng.integers(0, 256, 192 * 7, dtype=np.uint8).tobytes()
    png = bytearray(media.png_of(noise))
    assert media.samples_of(bytes(png)) == noise
    png[60] ^= 1
    with pytest.raises(ValueError):
        media.samples_of(bytes(png))


def test_items_of_pages():
    page = '<article><h1>Head</h1><p>One <b>two</b></p><figure><img src="cas:1" alt="x"><figcaption>A <i>caption</i></figcaption></figure><p>Three</p><img src="u" alt="alone"><script>no</script>'
    got = [(x["pos"], x["kind"], x["text"] or x["media_ref"], x["caption"]) for x in media.items_of(page)]
    assert got == [(0, "text", "Head", None), (1, "text", "One two", None), (2, "media", "cas:1", "A caption"), (3, "text", "Three", None), (4, "media", "u", "alone")]
    assert media.items_of(None) == media.items_of("") == []


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        assert r["n_bytes"] == len(data) and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        png = media.png_of(payload)
        assert r["media_bytes"] == len(png) and r["media_sha256"] == hashlib.sha256(png).hexdigest() and r["feature"] == media.feature_of(payload)
        assert r["caption"] == f"{len(data)} bytes"


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(queries.op8_media_columns(spark, sf).collect(), texts)


def test_awkward_rows(spark, tmp_path):
    docs = edges.awkward(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op8_media_columns(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count() and len({r["media_sha256"] for r in rows if r["doc_id"] in (0, 1, 10)}) == 1
    pages = spark.createDataFrame([(1, '<img src="cas:none">'), (2, None)], "page_id long, html string")
    found = media.resolved(media.interleaved(pages), media.media_features(media.stored_media(docs))).collect()
    assert len(found) == 1 and found[0]["media_sha256"] is None
    edges.empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op8_media_columns(spark, f"{tmp_path}/none").count() == 0
