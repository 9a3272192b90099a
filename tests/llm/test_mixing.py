from __future__ import annotations

from collections import Counter, defaultdict

import edges
import pytest

from eventloom.llm import mixing


def brute_targets(sizes, cap=3):
    """Shares by weight; those above the cap stop there and the rest is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(cap * sizes[s] for s in over)
        free -= set(over)
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1_000, None: 50}, {"a": 5}, {"a": 0, "b": 0}, {"a": 1, "b": 1, "c": 100_000, "d": 7, "e": 0, "f": 30}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    for part in by.values():
        assert sum(r["taken"] for r in part) == int(part[0]["target"])
        # Whole epochs and a cut: at most one document gives only a part of itself.
        assert sum(r["size"] > 0 and r["taken"] % r["size"] != 0 for r in part) <= 1


def test_awkward_rows(spark):
    docs = edges.awkward(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (0, 1, 5, 10)} == {0}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect())[0] == 1
    assert mixing.mix(edges.empty(spark)).count() == mixing.mixed_documents(edges.empty(spark)).count() == 0


def test_copies_of_equal_rows(spark):
    """Three equal rows of 10 words whose source takes 23 words are 2 copies of 3 rows, not one more."""
    rows = [(1, "w " * 10, "en", "a", 20)] * 3 + [(2, "x " * 16, "en", "b", 32)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = mixing.mix(docs).collect()
    halves = {s: sum((2 * r["taken"] + r["size"]) // (2 * r["size"]) for r in taken if r["source"] == s) for s in ("a", "b")}
    got = Counter(r["source"] for r in mixing.mixed_documents(docs).collect())
    assert got == Counter({s: n for s, n in halves.items() if n})


def test_null_ids_spread(spark):
    docs = spark.range(1_000).selectExpr("cast(null as long) doc_id", "concat('text ', id) text", "'a' source")
    assert mixing.sized(docs).select("key").distinct().count() == 1_000
