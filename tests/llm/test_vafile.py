"""Exact search by approximations against all products in plain Python integers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from eventloom.llm import vafile as V


def by_hand(rows, every=50, k=5):
    def ints(x):
        return [max(-(1 << 62), min(1 << 62, math.floor(256 * c) if math.isfinite(256 * c) else int(math.copysign(1 << 62, c)))) for c in x]

    clean = [(i, ints(x)) for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    asked = {}
    for i, x in clean:
        if i % every == 0:
            asked[i] = min(asked.get(i, x), x)
    out = []
    for q, a in asked.items():
        scores = sorted((-min(max(sum(c * d for c, d in zip(a, x, strict=False)), V.LEAST), V.MOST), i) for i, x in clean if i != q)[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    return sorted(out)


def told(found):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, x, "e", 1) for i, x in rows], "vec_id long, embedding array<double>, key string, score int").repartition(3)


def test_random_with_awkward_rows(spark):
    draw = random.Random(5)
    rows = [(i, [draw.gauss(0, 0.3) for _ in range(12)]) for i in range(600)]
    common = [0.5] * 12
    rows += [(i, common) for i in range(600, 900)]  # masses of copies, queries among them
    rows += [(None, common), (1000, None), (1001, [None, *common[1:]]), (1002, [float("nan"), *common[1:]]), (1050, [float("inf"), *common[1:]])]
    rows += [(1100, [3.0, -2.0]), (1101, []), (1150, []), (7, [0.9] * 12), (7, [0.8] * 12), (50, [0.7] * 12), ((1 << 60) + 1, [0.6] * 12), ((1 << 60), [0.6] * 12)]
    assert told(V.top_k(table(spark, rows), lambda i: i % 50 == 0, chunk=8)) == by_hand(rows)


def test_large_components(spark):
    draw = random.Random(6)
    rows = [(i, [draw.choice([1e300, -1e300, 1e17, 3e6, -0.001, 0.0]) for _ in range(4)]) for i in range(120)]
    assert told(V.top_k(table(spark, rows), lambda i: i % 50 == 0)) == by_hand(rows)


def test_fewer_than_k_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5, -2.0])]
    assert told(V.top_k(table(spark, rows), lambda i: i % 50 == 0)) == by_hand(rows)
    assert V.top_k(table(spark, rows[:1]), lambda i: i % 50 == 0).count() == 0
    assert V.top_k(table(spark, []), lambda i: i % 50 == 0).count() == 0
    assert V.top_k(table(spark, rows[1:]), lambda i: i % 50 == 0).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 6, 8])
def test_bounds_hold(bits):
    draw = np.random.default_rng(bits)
    rows, queries = draw.normal(0, 60, (500, 20)).astype(int), draw.normal(0, 60, (30, 20)).astype(int)
    grid = V.Grid(rows[:100], rows.min(0).astype(float), rows.max(0).astype(float), bits)
    low, high = grid.bounds(queries.astype(float), grid.cells(rows))
    score = queries @ rows.T
    assert (low <= score).all() and (score <= high).all()


def test_few_vectors_are_read(spark, monkeypatch):
    """On the given table the bounds rule out all but a small part of the exact vectors."""
    seen = []
    keep = V.stored
    monkeypatch.setattr(V, "stored", lambda df, name, *a: seen.append((name, made := keep(df, name, *a))) or made)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    V.top_k(vectors, lambda i: i % 50 == 0)
    kinds = dict(seen)
    read = kinds["va-first"].count() + kinds["va-unread"].count()
    print(read, kinds["va-candidates"].count())
    assert read < 0.2 * vectors.count() * kinds["va-queries"].count()
