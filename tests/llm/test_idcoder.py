from __future__ import annotations

import time
import zlib

import edges
import numpy as np
import pytest
from tokenizers import Tokenizer

from eventloom.llm import idcoder, tokenfile
from eventloom.llm.tokens import tokenizer_path


def segment(lengths, ids, first=0, before=0):
    return idcoder.Segment(np.arange(first, first + len(lengths)), np.asarray(lengths), before, np.asarray(ids, "<u4"))


@pytest.mark.parametrize("kind", ["one", "same", "uniform", "zipf", "all", "repeats"])
def test_round_trip(kind):
    rng = np.random.default_rng(4)
    ids = {
        "one": np.array([7]), "same": np.full(20_000, 50_256), "uniform": rng.integers(0, 50_257, 20_000), "zipf": np.minimum(rng.zipf(1.3, 30_000), 50_256),
        "all": np.arange(8_192), "repeats": np.tile(rng.integers(0, 50_257, 300), 90),
    }[kind]
    cut = [len(ids) // 3, len(ids) - len(ids) // 3]
    rows = idcoder.packed_segments([segment(cut, ids, 5, 11), segment([1, 0], [3])])
    back = idcoder.unpacked_segments(rows)
    assert back[0].ids.tolist() == ids.tolist() and back[0].lengths.tolist() == cut and back[0].before == 11
    assert back[0].doc_ids.tolist() == [5, 6] and back[1].ids.tolist() == [3]
    if kind in ("same", "repeats"):
        assert len(rows[0]) < len(ids) / 2


def test_broken_bytes_are_found():
    ids = np.random.default_rng(1).integers(0, 900, 5_000)
    row = bytearray(idcoder.packed_segments([segment([5_000], ids)])[0])
    row[len(row) // 2] ^= 4
    with pytest.raises(ValueError):
        idcoder.unpacked_segments([bytes(row)])
    with pytest.raises(ValueError):
        idcoder.unpacked_segments([b"XXXX" + bytes(row[4:])])


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    file = tokenfile.written_segments(docs)
    rows = sorted(tokenfile.read_documents(file).collect(), key=lambda r: r["doc_id"])
    tok, start = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), 0
    texts = sorted((d["doc_id"], d["text"]) for d in docs.collect())
    assert len(rows) == len(texts)
    for r, (doc, text) in zip(rows, texts, strict=True):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        start += len(ids)
    stored = sum(len(r["segment"]) for r in file.select("segment").collect())
    assert stored < 2 * start  # under 16 bits an id


def test_awkward_rows(spark):
    docs = edges.awkward(spark)
    rows = tokenfile.read_documents(tokenfile.written_segments(docs)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows) == sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in docs.collect())
    ordered = sorted(rows, key=lambda r: r["start"])
    assert ordered[0]["doc_id"] is None and ordered[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ordered, ordered[1:], strict=False))
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (0, 1)} == {1}
    assert tokenfile.read_documents(tokenfile.written_segments(edges.empty(spark))).count() == 0


def test_strips_of_uneven_frames():
    rng = np.random.default_rng(7)
    lengths = [1, 1_023, 1_024, 1_025, 8_191, 8_192, 8_193, 30_000, 0, 3]
    made = [segment([n], np.minimum(rng.zipf(1.2, n), 70_000) if k % 2 else rng.integers(0, 1 << 22, n), k, 10 * k) for k, n in enumerate(lengths)]
    back = idcoder.unpacked_segments(idcoder.packed_segments(made))
    for s, b in zip(made, back, strict=True):
        assert b.ids.tolist() == s.ids.tolist() and b.before == s.before and b.doc_ids.tolist() == s.doc_ids.tolist()


def test_carries_run_through_words():
    # Slots at the upper end settle words of ones, which later carries turn.
    slots = np.random.default_rng(3).choice([0, 1, 65_534, 65_535], (2_000, 60), p=[0.01, 0.01, 0.49, 0.49])
    w, every = idcoder.Writer(60, len(slots)), np.arange(60)
    for row in slots:
        size = w.range >> 16
        w.put(60, row * size, size)
    assert (w.out > 0xFFFF).any()
    counts, words = w.words(every)
    r = idcoder.Reader(words, counts, every)
    for row in slots:
        size = r.range >> 16
        assert (np.minimum(r.above // size, 65_535) == row).all()
        r.taken(60, r.above - row * size, size)


def test_side_by_side_is_cheap():
    # Against sorting the same ids: 246 times as long before frames were cut into strips, 22 times since.
    ids = np.minimum(np.random.default_rng(5).zipf(1.2, 128 * idcoder.FRAME), 50_256)
    made = [segment([len(ids)], ids)]

    def seconds(f):
        start = time.process_time()
        f()
        return time.process_time() - start

    sort = min(seconds(lambda: [np.unique(ids[a : a + idcoder.FRAME], return_inverse=True) for a in range(0, len(ids), idcoder.FRAME)]) for _ in range(3))
    coder = min(seconds(lambda: idcoder.unpacked_segments(idcoder.packed_segments(made))) for _ in range(2))
    assert coder < 100 * sort
