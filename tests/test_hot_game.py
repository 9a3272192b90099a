"""One game of many chunks (HOT_EVENTS, 200,000 unless set) through plays, counts, sliding windows and possessions, against
loops in numpy."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import state as S
from eventloom.operators import windows as W
from eventloom.storage import stored

N = int(os.environ.get("HOT_EVENTS", "200000"))


@pytest.fixture(scope="module")
def events(spark):
    kind = F.pmod(F.xxhash64("id"), F.lit(10))
    made = spark.range(N).select(
        F.lit(1).alias("game_id"), F.col("id").alias("sequence_idx"), F.when(kind == 0, "goal").when(kind < 4, "idle").otherwise("act").alias("event_type"),
        F.pmod(F.xxhash64(F.col("id") + 7), F.lit(5)).cast("string").alias("actor"),
    )
    return stored(made, "hot-game")


@pytest.fixture(scope="module")
def arrays(events):
    rows = events.orderBy("sequence_idx").toPandas()
    return rows["event_type"].to_numpy(), rows["actor"].astype(int).to_numpy()


def test_plays(events, arrays):
    play = np.concatenate([[0], np.cumsum(arrays[0] == "goal")[:-1]])
    size = np.bincount(play)
    found = W.plays(events, "goal").orderBy("play").toPandas()
    assert (found["play"].to_numpy() == np.flatnonzero(size >= 2)).all() and (found["n"].to_numpy() == size[size >= 2]).all()


def test_running_counts(events, arrays):
    found = S.running_count(events, F.col("event_type") == "idle", "n").orderBy("sequence_idx").toPandas()["n"].to_numpy()
    for actor in range(5):
        own = arrays[1] == actor
        assert (found[own] == np.cumsum(arrays[0][own] == "idle")).all()


def test_sliding(events, arrays):
    upto = np.concatenate([[0], np.cumsum(arrays[0] == "goal")])
    start = np.arange(0, N, 3)
    end = np.minimum(start + 5, N)
    kept = (upto[end] - upto[start] > 0) & (end - start >= 2)
    found = W.sliding(events, F.col("event_type") == "goal").orderBy("start").toPandas()
    assert (found["start"].to_numpy() == start[kept]).all() and (found["n_actionable"].to_numpy() == (upto[end] - upto[start])[kept]).all()
    assert (found["chain_no"].to_numpy() == np.arange(kept.sum())).all()


def test_possessions(events, arrays):
    types, teams = arrays
    turn = (types == "idle") & np.concatenate([[False], teams[1:] != teams[:-1]])
    ends, before = np.zeros(N, bool), False
    for i, (goal, flips) in enumerate(zip((types == "goal").tolist(), turn.tolist(), strict=True)):
        before = goal or (flips and not before)
        ends[i] = before
    split = S.with_possessions(events, F.col("event_type") == "goal", F.col("event_type") == "idle", F.col("actor"))
    found = split.orderBy("sequence_idx").toPandas()
    assert (found["ends"].to_numpy() == ends).all() and (found["possession"].to_numpy() == np.concatenate([[0], np.cumsum(ends)[:-1]])).all()
