"""State along ordered events: possessions, running counts, transitions, clamped stacks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.operators.scans import alternating, previous, running_sum
from eventloom.storage import stored


def with_possessions(plays: DataFrame, hard_end: Column, rebound: Column, team: Column) -> DataFrame:
    """Adds ends (the row ends its possession) and possession (from 0).

    A rebound ends one if the row before it in the same possession has another, non-empty team: a row whose predecessor
    ended its possession doesn't end another, so runs of rebounds that each change team alternate.
    """
    told = stored(previous(plays.withColumn("_team", team), F.col("_team"), "_before"), "plays")
    known = (F.coalesce("_team", F.lit("")) != "") & (F.coalesce("_before", F.lit("")) != "")
    return alternating(told, hard_end, rebound & known & (F.col("_team") != F.col("_before")), "ends", "possession").drop("_team", "_before")


def possession_rows(split: DataFrame) -> DataFrame:
    """One row per possession: first and last index, terminal type and actor, number of plays."""
    return split.groupBy("game_id", "possession").agg(
        F.min("sequence_idx").alias("first_idx"), F.max("sequence_idx").alias("last_idx"),
        F.max_by("event_type", "sequence_idx").alias("terminal_type"), F.max_by("actor", "sequence_idx").alias("terminal_actor"),
        F.count("*").alias("n_plays"),
    )


def running_count(events: DataFrame, what: Column, name: str) -> DataFrame:
    """How many such events the row's actor has had, this one included."""
    return running_sum(events, what.cast("int"), name, ("game_id", "actor"))


def shrinks(observed: DataFrame, value: str, least: float = 1.0) -> DataFrame:
    """First observations, and those that are more than `least` below the one before; the one before is any observed
    row, emitted or not. Rows without the value don't count."""
    told = previous(observed.where(F.col(value).isNotNull()), F.col(value), "before")
    return told.where(F.col("before").isNull() | (F.col(value) < F.col("before") - least))


def drops_below(observed: DataFrame, value: str, level: float, by: list[str]) -> DataFrame:
    """Rows under the level whose predecessor wasn't."""
    return previous(observed, F.col(value), "before", tuple(by)).where((F.col("before") >= level) & (F.col(value) < level))


def folded_stacks(actions: DataFrame, starting: int, seats: int) -> DataFrame:
    """The clamped betting state behind every action of a hand.

    `actions`: hand, step, seat, move (fold, call, raise, deal), amount. A raise to an amount adds what the seat hasn't
    put in on this street, at most down to an empty stack; a call adds what is missing, at most the stack; a deal clears
    the street. Clamps make this no prefix sum, so it is a fold over the hand's ordered actions: hands are sorted within
    their partitions and one pass keeps a running state, so time is linear and memory doesn't grow with a hand.
    Gives hand, step, seat, move, stack, pot, bet.
    """
    kind = actions.schema["hand"].dataType
    out = T.StructType([T.StructField("hand", kind)]).add("step", "long").add("seat", "integer").add("move", "string").add("stack", "long").add("pot", "long").add("bet", "long")
    shape = pa.schema([("step", pa.int64()), ("seat", pa.int32()), ("move", pa.string()), ("stack", pa.int64()), ("pot", pa.int64()), ("bet", pa.int64())])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stacks, put, pot, bet = None, [], [], 0, 0
        for batch in batches:
            rows: list[tuple] = []
            for hand, step, seat, move, amount in zip(*(batch.column(c).to_pylist() for c in ("hand", "step", "seat", "move", "amount")), strict=True):
                if not stacks or hand != at:
                    at, stacks, put, pot, bet = hand, [starting] * seats, [0] * seats, 0, 0
                if seat is not None and not 0 <= seat < seats:
                    raise ValueError(f"seat {seat} of {seats}")
                # A null seat puts in nothing; what is missing of a null amount or bet is 0.
                put_in, stack = (None, 0) if seat is None else (put[seat], stacks[seat])
                asked = {"raise": amount, "call": bet}.get(move)
                added = 0 if asked is None or put_in is None else max(0, asked - put_in)
                added = min(added, stack) if move == "call" else added
                pot += added
                if seat is not None:
                    stack = stacks[seat] = max(0, stack - added)
                    if move == "raise":
                        put[seat] = amount
                    elif move == "call" and put_in is not None:
                        put[seat] += added
                if move == "deal":
                    put, bet = [0] * seats, 0
                elif move == "raise":
                    bet = amount
                rows.append((step, seat, move, stack, pot, bet))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)] if rows else [pa.array([], f.type) for f in shape]
            yield pa.RecordBatch.from_arrays([batch.column("hand"), *columns], names=["hand", *shape.names])

    ordered = actions.select("hand", F.col("step").cast("long"), F.col("seat").cast("int"), "move", F.col("amount").cast("long")).repartition("hand").sortWithinPartitions("hand", "step", "seat", "move", "amount")
    return ordered.mapInArrow(folded, out)
