"""Operators of one game's events in the order of event time, over streams that deliver them late and out of order.

Events wait in state until the watermark passes their time; timers then hand them, in order, to a fold. A game without
events for a while is over: its fold ends and its state goes. So the results are those of the batch operators, and state
holds what may still be overtaken, plus one small value per game that goes on.
"""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from operator import itemgetter
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from eventloom.storage import session_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Events wait in pieces of at most so many, each a pickled list: a state row per event would cost more than its fold.
WAITING, PIECE = "events binary", 4_096


class Event(NamedTuple):
    us: int
    place: int | None
    event_type: str | None
    actor: str | None
    value: float | None


#: An actor, or none, as a key that JSON can hold.
key_of = lru_cache(1 << 16)(json.dumps)


# --- folds ---------------------------------------------------------------------------------------------------------
class Fold(Protocol):
    """What runs along a game: `schema` of its rows, a first state that JSON can hold, a step and an end."""

    schema: str

    def start(self) -> dict: ...
    def step(self, state: dict, event: Event) -> Iterator[tuple]: ...
    def end(self, state: dict) -> Iterator[tuple]: ...


@dataclass(frozen=True)
class CountWindows:
    """A chain for every `size` events of a game; the incomplete tail goes, as in `windows.tumbling`."""

    size: int = 5
    schema: str = "chain_no long, types array<string>, actors array<string>"

    def start(self) -> dict:
        return {"made": 0, "types": [], "actors": []}

    def step(self, state: dict, event: Event) -> Iterator[tuple]:
        state["types"].append(event.event_type)
        state["actors"].append(event.actor)
        if len(state["types"]) == self.size:
            yield state["made"], state["types"], state["actors"]
            state |= {"made": state["made"] + 1, "types": [], "actors": []}

    def end(self, state: dict) -> Iterator[tuple]:
        yield from ()


@dataclass(frozen=True)
class Plays:
    """Segments that end with a boundary event, and the one behind the last boundary, as in `windows.plays`."""

    boundary: str = "objective_capture"
    least: int = 2
    schema: str = "play long, n long, ends_in_goal boolean"

    def start(self) -> dict:
        return {"play": 0, "n": 0}

    def step(self, state: dict, event: Event) -> Iterator[tuple]:
        state["n"] += 1
        if event.event_type == self.boundary:
            if state["n"] >= self.least:
                yield state["play"], state["n"], True
            state |= {"play": state["play"] + 1, "n": 0}

    def end(self, state: dict) -> Iterator[tuple]:
        if state["n"] >= self.least:
            yield state["play"], state["n"], False


@dataclass(frozen=True)
class RunningCounts:
    """For every event how many of a type its actor has had, this one included, as in `state.running_count`."""

    event_type: str
    schema: str = "place long, actor string, n long"

    def start(self) -> dict:
        return {}

    def step(self, state: dict, event: Event) -> Iterator[tuple]:
        key = key_of(event.actor)
        state[key] = state.get(key, 0) + (event.event_type == self.event_type)
        yield event.place, event.actor, state[key]

    def end(self, state: dict) -> Iterator[tuple]:
        yield from ()


@dataclass(frozen=True)
class Shrinks:
    """First values and such that are more than `least` below the one before, as in `state.shrinks`."""

    least: float = 1.0
    schema: str = "place long, value double, before double"

    def start(self) -> dict:
        return {"last": None}

    def step(self, state: dict, event: Event) -> Iterator[tuple]:
        if event.value is not None:
            if state["last"] is None or event.value < state["last"] - self.least:
                yield event.place, event.value, state["last"]
            state["last"] = event.value

    def end(self, state: dict) -> Iterator[tuple]:
        yield from ()


@dataclass(frozen=True)
class DropsBelow:
    """Events under the level whose actor's event before wasn't, as in `state.drops_below` by game and actor."""

    level: float
    schema: str = "place long, actor string, value double"

    def start(self) -> dict:
        return {}

    def step(self, state: dict, event: Event) -> Iterator[tuple]:
        key = key_of(event.actor)
        before = state.get(key)
        if before is not None and event.value is not None and before >= self.level > event.value:
            yield event.place, event.actor, event.value
        state[key] = event.value

    def end(self, state: dict) -> Iterator[tuple]:
        yield from ()


# --- the operator ----------------------------------------------------------------------------------------------------
class InEventOrder(StatefulProcessor):
    """Keeps a game's events until the watermark has passed them, then folds them in order of time and place."""

    def __init__(self, fold: Fold, names: list[str], idle_ms: int) -> None:
        self.fold, self.row, self.idle_ms = fold, Row(*names), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.running = handle.getValueState("running", "state string, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        least = None
        while some := list(islice(rows, PIECE)):
            fields = itemgetter(*map(some[0].__fields__.index, Event._fields))
            piece = list(map(fields, some))
            self.waiting.appendValue((pickle.dumps(piece),))
            first = min(piece, key=itemgetter(0))[0]
            least = first if least is None else min(least, first)
        if least is not None:
            self.handle.registerTimer(least // 1000)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [Event(*e) for (piece,) in self.waiting.get() for e in pickle.loads(piece)]
        ready = sorted((e for e in held if e.us // 1000 <= passed), key=lambda e: (e.us, e.place is not None, e.place))
        late = [tuple(e) for e in held if e.us // 1000 > passed]
        state, last = self.running.get() or (None, None)
        state = self.fold.start() if state is None else json.loads(state)
        for event in ready:
            last = event.us
            for out in self.fold.step(state, event):
                yield self.row(*key, *out)
        if late:
            self.waiting.put([(pickle.dumps(late[at : at + PIECE]),) for at in range(0, len(late), PIECE)])
            self.handle.registerTimer(min(late, key=itemgetter(0))[0] // 1000)
        elif held:
            self.waiting.clear()
        if last is None:
            return
        over = last // 1000 + self.idle_ms
        if late or passed < over:
            self.running.update((json.dumps(state), last))
            self.handle.registerTimer(over)
        else:
            for out in self.fold.end(state):
                yield self.row(*key, *out)
            self.running.clear()

    def close(self) -> None:
        pass


def with_rocksdb(spark: SparkSession) -> None:
    """Timers and lists need this state store; streams that run already keep theirs."""
    if "RocksDB" not in (spark.conf.get(PROVIDER, "") or ""):
        spark.conf.set(PROVIDER, ROCKSDB)


def in_event_order(stream: DataFrame, fold: Fold, late_seconds: int = 600, idle_seconds: int = 1_800) -> DataFrame:
    """game_id and the fold's columns for a stream of game_id, ts, place, event_type, actor and, if it has one, value.

    Events up to `late_seconds` behind the latest one seen count, in order of ts and place (nulls first); later ones are
    dropped. A game without events for `idle_seconds` of event time is over: what comes then is a new game. Nulls in other
    columns are values; rows without a ts are dropped. Repeated rows are events of their own.
    """
    with_rocksdb(stream.sparkSession)
    value = F.col("value").cast("double") if "value" in stream.columns else F.lit(None).cast("double")
    kept = stream.where("ts is not null").select("game_id", "ts", F.unix_micros("ts").alias("us"), F.col("place").cast("long").alias("place"), "event_type", "actor", value.alias("value"))
    # Watermarks have milliseconds: what is late is told by them, what comes first by microseconds.
    told = kept.withColumn("ts", F.date_trunc("millisecond", "ts")).withWatermark("ts", f"{late_seconds} seconds")
    schema = T.StructType([T.StructField("game_id", stream.schema["game_id"].dataType), *T.StructType.fromDDL(fold.schema)])
    return told.groupBy("game_id").transformWithState(InEventOrder(fold, schema.names, idle_seconds * 1000), schema, "Append", "EventTime")


def drained(made: DataFrame, name: str, stores: int | None = None) -> DataFrame:
    """All rows that a stream gives for what its source holds now, appended to a table in the shared folder and read back.

    `stores` is the number of its state stores, else the session's shuffle partitions; small sources need few.
    """
    spark = made.sparkSession
    path, setting = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}", "spark.sql.shuffle.partitions"
    keep = spark.conf.get(setting)
    if stores:
        spark.conf.set(setting, str(min(int(keep), stores)))
    try:
        query = made.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(setting, keep)
    return spark.read.schema(made.schema).parquet(f"{path}/rows")
