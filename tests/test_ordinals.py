"""Places in groups against sorting in Python, with nulls, ties, one hot group and small ranges."""

from __future__ import annotations

import random

import pytest

from eventloom.operators.ordinals import with_ordinals


@pytest.fixture
def many_ranges(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def sort_key(v):
    return (v is not None, v if v is not None else 0)


def test_places(spark, many_ranges):
    draw = random.Random(3)
    made = [(draw.choice(["a", "a", "a", "b", "c", None]), draw.choice([None, *range(50)]), i) for i in range(3_000)]
    rows = spark.createDataFrame(made, "g string, x long, i long").repartition(7)
    found = with_ordinals(rows, ["g"], ["x", "i"], "at", "n").collect()
    groups = {}
    for g, x, i in made:
        groups.setdefault(g, []).append((sort_key(x), i))
    want = {i: (at, len(v)) for v in groups.values() for at, (_, i) in enumerate(sorted(v))}
    assert {r["i"]: (r["at"], r["n"]) for r in found} == want and len(found) == 3_000


def test_ties_spread_and_stay_dense(spark, many_ranges):
    rows = spark.range(2_000).selectExpr("'a' as g", "1 as x", "id % 2 as at")
    found = with_ordinals(rows, ["g"], ["x"], "at")
    assert sorted(r["at"] for r in found.select("at").collect()) == list(range(2_000))
    # Rows alike in all keys are in several ranges, so in several files of the table behind.
    assert len(found.inputFiles()) > 3


def test_empty_and_no_group(spark):
    assert with_ordinals(spark.createDataFrame([], "g string, x long"), ["g"], ["x"], "at", "n").count() == 0
    found = with_ordinals(spark.createDataFrame([(3,), (1,), (2,)], "x long"), [], ["x"], "at", "n").collect()
    assert sorted((r["x"], r["at"], r["n"]) for r in found) == [(1, 0, 3), (2, 1, 3), (3, 2, 3)]
