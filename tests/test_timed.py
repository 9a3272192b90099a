"""Streams whose events come late and out of order give the rows of the batch operators, and leave no state."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from eventloom.operators import state as B
from eventloom.operators import windows as W
from eventloom.streaming import timed as S

SCHEMA = "game_id long, ts timestamp, place long, event_type string, actor string, value double"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def made():
    draw = random.Random(4)
    rows = []
    for game in range(4):
        for i in range(60):
            rows.append((game, START + dt.timedelta(seconds=30 * (i // 2)), i, draw.choice(["zone_enter", "objective_capture", "player_idle"]), draw.choice(["a", "b", None]), draw.choice([None, 10.0, 20.0, 40.0])))
    return rows


@pytest.fixture(scope="module")
def events(spark, made):
    return spark.createDataFrame(made, SCHEMA).withColumnRenamed("place", "sequence_idx")


@pytest.fixture(autouse=True)
def few_stores(spark):
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", keep)


@pytest.fixture
def streamed(spark, made, tmp_path):
    """The rows of a fold over events that come up to four minutes late, in four batches; then a far later event of another
    game moves the watermark on."""

    def go(fold):
        draw = random.Random(5)
        order = sorted(made, key=lambda r: r[1] + dt.timedelta(seconds=draw.uniform(0, 240)))
        parts = [order[i : i + 60] for i in range(0, len(order), 60)]
        parts += [[(99, START + dt.timedelta(hours=h), 0, "player_idle", None, None)] for h in (5, 10)]
        for k, part in enumerate(parts):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
        name = f"timed{abs(hash(str(tmp_path)))}"
        query = S.in_event_order(stream, fold, 300, 1_800).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert query.awaitTermination(280)
        return spark.table(name).where("game_id <> 99"), f"{tmp_path}/cp"

    return go


def lines(df, columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


def left_games(spark, checkpoint):
    found = spark.read.format("statestore").option("stateVarName", "running").load(checkpoint)
    return {r["key"]["game_id"] for r in found.collect()}


def test_chains_and_no_state(spark, streamed, events):
    found, checkpoint = streamed(S.CountWindows(7))
    cut = W.tumbling(events, 7)
    want = cut.groupBy("game_id", "chain_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "event_type", "actor"))), lambda x: x["event_type"]).alias("types"), F.transform(F.array_sort(F.collect_list(F.struct("slot", "event_type", "actor"))), lambda x: x["actor"]).alias("actors"))
    columns = ["game_id", "chain_no", "types", "actors"]
    assert lines(found, columns) == lines(want, columns)
    # The far event is still in state, as the watermark can't pass it.
    assert left_games(spark, checkpoint) <= {99}


def test_plays(streamed, events):
    found, _ = streamed(S.Plays())
    columns = ["game_id", "play", "n", "ends_in_goal"]
    assert lines(found, columns) == lines(W.plays(events), columns)


def test_running_counts(streamed, events):
    found, _ = streamed(S.RunningCounts("player_idle"))
    want = B.running_count(events, F.col("event_type") == "player_idle", "n").withColumnRenamed("sequence_idx", "place")
    assert lines(found, ["game_id", "place", "actor", "n"]) == lines(want, ["game_id", "place", "actor", "n"])


def test_shrinks_and_drops(streamed, events):
    found, _ = streamed(S.Shrinks(1.0))
    want = B.shrinks(events, "value").withColumnRenamed("sequence_idx", "place")
    assert lines(found, ["game_id", "place", "value", "before"]) == lines(want, ["game_id", "place", "value", "before"])


def test_drops(streamed, events):
    found, _ = streamed(S.DropsBelow(25.0))
    want = B.drops_below(events, "value", 25.0, ["game_id", "actor"]).withColumnRenamed("sequence_idx", "place")
    assert lines(found, ["game_id", "place", "actor", "value"]) == lines(want, ["game_id", "place", "actor", "value"])


class Counted:
    """State of one game that counts what is written."""

    def __init__(self):
        self.rows, self.value, self.timers, self.writes = [], None, [], 0

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return Value(self)

    def appendValue(self, row):
        self.writes += 1
        self.rows.append(row)

    def appendList(self, rows):
        self.put([*self.rows, *rows])

    def put(self, rows):
        self.writes += len(rows)
        self.rows = list(rows)

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, ms):
        self.timers.append(ms)

    def getCurrentWatermarkInMs(self):
        return self.passed


class Value:
    def __init__(self, kept):
        self.kept = kept

    def exists(self):
        return self.kept.value is not None

    def get(self):
        return self.kept.value

    def update(self, row):
        self.kept.value = row

    def clear(self):
        self.kept.value = None


def test_waiting_events_share_state_rows():
    """10,000 events of a game wait in few rows of state, and those the watermark hasn't passed wait on in few."""
    kept, processor = Counted(), S.InEventOrder(S.RunningCounts("x"), ["game_id", "place", "actor", "n"], 10**12)
    processor.init(kept)
    columns = Row("game_id", "ts", "us", "place", "event_type", "actor", "value")
    made = [columns(1, None, 1_000 * (i * 7_919 % 10_000), i if i % 3 else None, "x", "a" if i % 2 else None, float("nan")) for i in range(10_000)]
    assert list(processor.handleInputRows((1,), iter(made), kept)) == []
    assert kept.writes <= 3 and kept.timers == [0]
    kept.passed = 3_999
    first = list(processor.handleExpiredTimer((1,), kept, None))
    assert len(first) == 4_000 and kept.writes <= 5 and kept.timers[1] == 4_000
    kept.passed = 10_000
    found = first + list(processor.handleExpiredTimer((1,), kept, None))
    in_order, seen, want = sorted(made, key=lambda r: r["us"]), {}, []
    for r in in_order:
        seen[r["actor"]] = seen.get(r["actor"], 0) + 1
        want.append((1, r["place"], r["actor"], seen[r["actor"]]))
    assert [tuple(r) for r in found] == want and not kept.rows
