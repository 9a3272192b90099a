"""The sequence operators over unbounded event streams.

Streams have game_id, ts (event time), event_type and actor. Late rows behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(stream: DataFrame, length: str = "1 hour", late: str = "10 minutes", cell: str = "cell") -> DataFrame:
    """Events and actionable events per cell and time window."""
    from eventloom.functions.expressions import is_actionable

    flag = is_actionable(F.col("event_type"), F.col(cell))
    return (
        stream.withWatermark("ts", late).groupBy(F.window("ts", length), cell).agg(F.count("*").alias("n"), F.count_if(flag).alias("n_actionable"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), cell, "n", "n_actionable")
    )


def session_counts(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per game and session: a game without events for the gap starts a new one."""
    return (
        stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "game_id").agg(F.count("*").alias("n"))
        .select("game_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def count_windows(stream: DataFrame, size: int = 5) -> DataFrame:
    """game_id, chain_no, types, actors: a chain for every `size` events of a game, in order of arrival and, within a
    micro-batch, of time. State holds the open chain of each game, under `size` events."""

    def chains(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        made, types, actors = state.get if state.exists else (0, [], [])
        new = pd.concat(list(batches)).sort_values("ts", kind="stable")
        types, actors, out = [*types, *new["event_type"]], [*actors, *new["actor"]], []
        while len(types) >= size:
            out.append((key[0], made, types[:size], actors[:size]))
            made, types, actors = made + 1, types[size:], actors[size:]
        state.update((made, types, actors))
        yield pd.DataFrame(out, columns=["game_id", "chain_no", "types", "actors"])

    kind = stream.schema["game_id"].dataType.simpleString()
    return stream.select("game_id", "ts", "event_type", "actor").groupBy("game_id").applyInPandasWithState(
        chains, f"game_id {kind}, chain_no long, types array<string>, actors array<string>", "made long, types array<string>, actors array<string>", "append", GroupStateTimeout.NoTimeout
    )


def running_counts(stream: DataFrame, event_type: str, name: str = "n") -> DataFrame:
    """How many such events each game's actor has had so far; complete counts are given anew with every batch."""
    return stream.groupBy("game_id", "actor").agg(F.count_if(F.col("event_type") == event_type).alias(name))
