from __future__ import annotations

import datetime as dt

import pytest

from eventloom.streaming import incremental as S

SCHEMA = "game_id long, cell string, ts timestamp, event_type string, actor string"


def rows(n, start=0):
    at = dt.datetime(2024, 1, 1)
    return [(i % 2, "nba", at + dt.timedelta(minutes=i + start), "zone_enter" if i % 3 else "player_idle", f"p{i % 4}") for i in range(n)]


@pytest.fixture
def ran(spark, tmp_path):
    def go(make, mode):
        for k in range(2):
            spark.createDataFrame(rows(30, 60 * k), SCHEMA).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "40").parquet(f"{tmp_path}/in")
        query = make(stream).writeStream.outputMode(mode).format("memory").queryName(f"q{abs(hash(str(tmp_path)))}").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert query.awaitTermination(180)
        return spark.table(query.name).collect()

    return go


def test_tumbling(ran):
    found = ran(S.tumbling_counts, "update")
    last = {}
    for r in found:
        last[r["start"]] = (r["n"], r["n_actionable"])
    assert sum(n for n, _ in last.values()) == 60 and sum(k for _, k in last.values()) == 40


def test_count_windows(ran):
    found = ran(S.count_windows, "append")
    assert len(found) == 12 and all(len(r["types"]) == 5 for r in found)
    assert sorted((r["game_id"], r["chain_no"]) for r in found) == [(g, c) for g in range(2) for c in range(6)]


def test_running_counts(ran):
    found = ran(lambda s: S.running_counts(s, "player_idle"), "complete")
    assert sum(r["n"] for r in found) == 20
