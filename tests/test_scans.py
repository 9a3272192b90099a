"""Scans in small chunks against loops over sorted events."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import scans as S


@pytest.fixture(scope="module")
def made():
    draw = random.Random(11)
    rows = []
    for game, n in ((1, 200), (2, 1), (3, 64), (None, 37), (4, 8)):
        # Long runs of flips cross several chunks.
        kind = "flip"
        for i in range(n):
            kind = kind if draw.random() < 0.93 else draw.choice(["flip", "set", "none"])
            rows.append((game, i, None if draw.random() < 0.1 else draw.choice("abc"), draw.choice([None, 1, 2]), kind))
    draw.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def events(spark, made):
    return spark.createDataFrame(made, "game_id long, sequence_idx long, actor string, v int, kind string").repartition(5)


def in_order(made):
    return sorted(made, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("keys", [("game_id",), ("game_id", "actor")])
def test_sums_and_previous(events, made, keys):
    found = S.running_sum(events, F.col("v"), "upto", keys, size=7)
    found = S.running_sum(found, F.col("v"), "before", keys, inclusive=False, size=7)
    found = S.previous(found, F.col("v"), "last", keys, size=7)
    sums, lasts, want = {}, {}, []
    for r in in_order(made):
        key = (r[0], r[2])[: len(keys)]
        before = sums.get(key, 0)
        sums[key] = before + (r[3] or 0)
        want.append((r[0], r[1], before, sums[key], lasts.get(key)))
        lasts[key] = r[3]
    assert sorted(map(repr, want)) == sorted(repr((r["game_id"], r["sequence_idx"], r["before"], r["upto"], r["last"])) for r in found.collect())


@pytest.mark.parametrize("size", [1, 4, 7, 1000])
def test_alternating(events, made, size):
    found = S.alternating(events, F.col("kind") == "set", F.col("kind") == "flip", "bit", "n", size=size)
    want, state = [], {}
    for r in in_order(made):
        bit, n = state.get(r[0], (False, 0))
        new = r[4] == "set" or (r[4] == "flip" and not bit)
        want.append(repr((r[0], r[1], new, n)))
        state[r[0]] = (new, n + new)
    assert sorted(want) == sorted(repr((r["game_id"], r["sequence_idx"], r["bit"], r["n"])) for r in found.collect())
