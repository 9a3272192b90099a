from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import edges
import numpy as np
from tokenizers import Tokenizer

from eventloom.llm import packing
from eventloom.llm.tokens import tokenizer_path


def naive(lengths, capacity):
    """Best fit decreasing, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms), Counter(rooms)




def test_runs_are_best_fit_decreasing():
    rng = random.Random(3)
    for trial in range(200):
        capacity = rng.choice([1, 5, 16, 64, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        counts = Counter(lengths)
        runs, made = packing.best_fit(counts, capacity)
        bins, rooms = naive(lengths, capacity)
        assert made == bins
        ranked = defaultdict(list)
        for run in runs:
            ranked[run[0]].append(run)
        used = defaultdict(list)
        for length, n in counts.items():
            for rank in range(n):
                _, start, first, each, offset = [r for r in ranked[length] if r[1] <= rank][-1]
                behind = rank - start
                used[first + behind // each].append((offset + behind % each * length, length))
        left = Counter()
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            left[capacity - at] += 1
        assert left == rooms, trial


def check_layout(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    made = check_layout(rows, 2048)
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces, lengths = {}, []
    for d in docs.collect():
        ids = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            pieces[d["doc_id"], k] = (at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))
            lengths.append(len(part))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == pieces
    assert len(rows) == len(pieces) and made == naive(lengths, 2048)[0]


def test_awkward_rows(spark):
    docs = edges.awkward(spark)
    rows = packing.pack_documents(docs).collect()
    check_layout(rows, 2048)
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in docs.collect())
    assert {r["length"] for r in rows if r["doc_id"] in (0, 1, 10)} == {1}
    assert packing.pack_documents(edges.empty(spark)).count() == 0
