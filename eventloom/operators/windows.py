"""Cutting ordered events into chains.

Events have game_id, sequence_idx (dense from 0 in a game), event_type and actor. Windows are first described by narrow
rows (game_id, start, size); `members` then joins events to them by (game_id, sequence_idx), which spreads a game of any
length over all tasks. What needs a running order within a game (plays, places in a period) is a scan over its chunks
(`scans`); sizes of games are counted and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions.expressions import chain_id
from eventloom.operators.scans import running_sum
from eventloom.storage import stored


def placed(events: DataFrame, by: list[str]) -> DataFrame:
    """Adds _row, an event's place from 0 among those of its game and `by`, and _n, their number."""
    keys = ["game_id", *by]
    counts = events.groupBy(*keys).agg(F.count("*").alias("_n")).select(F.struct(*keys).alias("_group"), "_n")
    return running_sum(events, F.lit(1), "_row", tuple(keys), inclusive=False).withColumn("_group", F.struct(*keys)).join(counts, "_group").drop("_group")


def trigger_windows(events: DataFrame, triggers: tuple[str, ...], tag: str, before: int = 4, size: int = 8) -> DataFrame:
    """game_id, start, n, trigger_idx, chain_id: a window of `size` events around each trigger, moved inside the game;
    the first trigger per start counts; windows under 2 events are dropped."""
    placed = events.where(F.col("event_type").isin(*triggers)).join(events.groupBy("game_id").agg(F.count("*").alias("_n")), "game_id")
    start = F.greatest(F.lit(0), F.least(F.greatest(F.lit(0), F.col("sequence_idx") - before), F.col("_n") - size)).cast("long")
    found = placed.groupBy("game_id", start.alias("start")).agg(F.min("sequence_idx").alias("trigger_idx"), F.least(F.lit(size), F.first("_n")).cast("long").alias("n"))
    return found.where("n >= 2").withColumn("chain_id", chain_id(F.col("game_id"), F.concat(F.lit(f"{tag}_"), F.col("start").cast("string"))))


def members(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Each window's events: the windows' columns, slot, and the events' other columns."""
    slots = windows.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("sequence_idx", F.col("start") + F.col("slot"))
    return slots.join(events, ["game_id", "sequence_idx"])


def tumbling(events: DataFrame, size: int, by: list[str] | None = None) -> DataFrame:
    """Adds chain_no and slot: consecutive chains of `size` events per game and `by`; the incomplete tail is dropped."""
    keys = ["game_id", *(by or [])]
    cut = running_sum(events, F.lit(1), "_row", tuple(keys), inclusive=False).withColumn("chain_no", F.floor(F.col("_row") / size).cast("long")).withColumn("slot", (F.col("_row") % size).cast("long"))
    return cut.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "chain_no"))).where(F.col("_n") == size).drop("_row", "_n")


def stream_chains(events: DataFrame, size: int, overlap: bool = False) -> DataFrame:
    """Members of fixed-length chains straight from streams: adds chain_no, slot and chain_id, `game_chain_0007`.

    Chains start every `size` events, or at every event with `overlap`; a tail and games shorter than `size` give none.
    An event finds its chains by its own place, so only a count per game is joined.
    """
    if size < 1:
        raise ValueError("chains have at least one event")
    step = 1 if overlap else size
    place = F.col("sequence_idx")
    first = F.greatest(F.lit(0), F.ceil((place - size + 1) / step)).cast("long")
    sized = events.join(events.groupBy("game_id").agg(F.count("*").alias("_n")), "game_id")
    cut = sized.withColumn("chain_no", F.explode(F.sequence(first, F.floor(place / step).cast("long")))).where(F.col("chain_no") * step + size <= F.col("_n")).drop("_n")
    number = F.col("chain_no").cast("string")
    name = F.concat(F.col("game_id").cast("string"), F.lit("_chain_"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))
    return cut.withColumns({"slot": place - F.col("chain_no") * step, "chain_id": name})


def rounds(events: DataFrame, number: Column, least: int = 2) -> DataFrame:
    """game_id, round, n: one chain per non-negative round number, of `least` events or more."""
    return events.withColumn("round", number).where("round >= 0").groupBy("game_id", "round").agg(F.count("*").alias("n"), F.min("sequence_idx").alias("first_idx")).where(F.col("n") >= least)


def with_plays(events: DataFrame, boundary: str = "objective_capture") -> DataFrame:
    """Adds play: how many boundary events came before; the boundary is the last event of its play."""
    return running_sum(events, (F.col("event_type") == boundary).cast("int"), "play", inclusive=False)


def plays(events: DataFrame, boundary: str = "objective_capture", least: int = 2) -> DataFrame:
    """game_id, play, n, ends_in_goal: segments between boundaries, the trailing one too; short ones are dropped but
    counted in the play numbers."""
    split = with_plays(events, boundary)
    per = split.groupBy("game_id", "play").agg(F.count("*").alias("n"), F.max(F.when(F.col("event_type") == boundary, 1).otherwise(0)).alias("_goal"))
    return per.where(F.col("n") >= least).select("game_id", "play", "n", (F.col("_goal") == 1).alias("ends_in_goal"))


def player_plays(events: DataFrame, boundary: str = "objective_capture", least: int = 2) -> DataFrame:
    """game_id, play, actor, player_slot, n: plays by actor; slots are ranks among the play's sorted actors, also of
    those whose chain is too short to stay."""
    per = with_plays(events, boundary).groupBy("game_id", "play", "actor").agg(F.count("*").alias("n"))
    slot = F.dense_rank().over(Window.partitionBy("game_id", "play").orderBy("actor")) - 1
    return per.withColumn("player_slot", slot.cast("long")).where(F.col("n") >= least)


def first_events(events: DataFrame, most: int = 8, least: int = 3) -> DataFrame:
    """The first `most` events of each game that has `least` or more, with slot. Places are dense, so a game is long enough
    if it has the place `least` - 1."""
    long_enough = events.where(F.col("sequence_idx") == least - 1).select("game_id")
    return events.where(F.col("sequence_idx") < most).join(long_enough, "game_id", "left_semi").withColumn("slot", F.col("sequence_idx"))


def subwindows(candidates: DataFrame, size: int, step: int | None = None) -> DataFrame:
    """Fixed-length chains from candidates (parent_id, n, ...): sub_no, offset, chain_id; the tail is dropped."""
    if size < 1:
        raise ValueError("chains have at least one event")
    step = step or size
    offsets = F.sequence(F.lit(0).cast("long"), F.col("n") - size, F.lit(step).cast("long"))
    cut = candidates.where(F.col("n") >= size).select("*", F.posexplode(offsets).alias("sub_no", "offset"))
    number = F.when(F.length(F.col("sub_no").cast("string")) < 3, F.lpad(F.col("sub_no").cast("string"), 3, "0")).otherwise(F.col("sub_no").cast("string"))
    return cut.withColumn("chain_id", F.concat("parent_id", F.lit("_sub"), number))


def sliding(events: DataFrame, actionable: Column, size: int = 5, step: int = 3) -> DataFrame:
    """game_id, start, n, n_actionable, chain_no: windows every `step` events; those without an actionable event are
    left out and not counted; a tail of 2 or more stays. An actionable event finds its windows by its own place."""
    if size < 1 or step < 1:
        raise ValueError("chains have at least one event, and starts differ")
    place = F.col("sequence_idx")
    first, last = F.greatest(F.lit(0), F.ceil((place - size + 1) / step)).cast("long"), F.floor(place / step).cast("long")
    # Events in no window keep a row without a start, so that one pass also tells how long games are.
    starts = F.when(actionable & (first <= last), F.sequence(first * step, last * step, F.lit(step).cast("long")))
    per = stored(events.select("game_id", place.alias("_at"), F.explode_outer(starts).alias("sequence_idx")).groupBy("game_id", "sequence_idx").agg(F.count("*").alias("n_actionable"), F.max("_at").alias("_last")), "window-starts")
    sized = per.where("sequence_idx is not null").drop("_last").join(per.groupBy("game_id").agg(F.max("_last").alias("_last")), "game_id").withColumn("n", F.least(F.lit(size), F.col("_last") + 1 - place).cast("long"))
    kept = running_sum(sized.where("n >= 2"), F.lit(1), "chain_no", inclusive=False)
    return kept.select("game_id", place.alias("start"), "n", "n_actionable", "chain_no")
