from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest

from eventloom.llm import ann


def brute(ids, vectors, queries, k=5):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(queries):
        cosines = unit @ unit[q]
        order = np.lexsort((ids, -np.round(cosines, 12)))
        out[int(ids[q])] = [(int(ids[i]), float(cosines[i])) for i in order if ids[i] != ids[q]][:k]
    return out


def found_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("block", [4096, 100])
def test_recall_on_the_table(spark, block):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    table = pq.read_table(path)
    ids, vectors = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), dtype=float)
    want = brute(ids, vectors, ids % 50 == 0)
    got = found_of(ann.nearest(spark.read.parquet(path), lambda v: v % 50 == 0, block=block).collect())
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values())), hits / sum(map(len, want.values()))
    for q, rows in got.items():
        assert len(rows) == 5 and all(x[1] >= y[1] for x, y in zip(rows, rows[1:], strict=False)) and q not in {i for i, _ in rows}


def test_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    some = rng.standard_normal((40, 6))
    rows = [(i, some[i % 40].tolist(), 1) for i in range(120)] + [(1_000, None, 1), (1_050, [0.0] * 6, 1), (1_100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1_150, [float("nan")] * 6, 1), (1_200, [float("inf")] + [0.0] * 5, 1), (None, [1.0] * 6, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int")
    got = found_of(ann.nearest(frame, lambda v: v % 50 == 0).collect())
    ids, vectors = np.arange(120), np.array([some[i % 40] for i in range(120)])
    want = brute(ids, vectors, ids % 50 == 0)
    assert set(got) == {0, 50, 100}
    for q in got:
        # The two copies first, by id.
        assert [i for i, _ in got[q]][:2] == [i for i, _ in want[q]][:2] and len(got[q]) == 5


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert ann.nearest(spark.createDataFrame([], schema), lambda v: v % 50 == 0).count() == 0
    two = spark.createDataFrame([(50, [1.0, 0.0], 1), (3, [1.0, 1.0], 1)], schema)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(two, lambda v: v % 50 == 0).collect()] == [(50, 1, 3)]
    assert ann.nearest(two.where("vec_id = 50"), lambda v: v % 50 == 0).count() == 0


def test_extreme_lengths_and_common_factors(spark):
    rng = np.random.default_rng(5)
    some = rng.standard_normal((60, 8))
    sizes = np.array([1e200, 1e-200, 1.0, 1e300, 1e-300])
    rows = [(50 * i, (some[i] * sizes[i % 5]).tolist(), 1) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int")
    got = found_of(ann.nearest(frame, lambda v: v % 50 == 0, block=5).collect())
    want = brute(np.array([r[0] for r in rows]), some, np.ones(60, bool))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 300
    for q, found in got.items():
        for i, score in found:
            assert score == pytest.approx(some[q // 50] @ some[i // 50] / np.linalg.norm(some[q // 50]) / np.linalg.norm(some[i // 50]), abs=1e-12)
    assert len(np.unique(ann.dealt(np.arange(0, 8_000, 8), 8))) == 8


def test_queries_of_one_block_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES", 7)
    path = "/root/testdata/sf0.01/embeddings.parquet"
    table = pq.read_table(path)
    ids, vectors = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), dtype=float)
    got = found_of(ann.nearest(spark.read.parquet(path), lambda v: v % 5 == 0).collect())
    want = brute(ids, vectors, ids % 5 == 0)
    assert set(got) == set(want) and sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
