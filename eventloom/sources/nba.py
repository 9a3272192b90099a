"""Basketball play-by-play records to one event per possession."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import state
from eventloom.sources.common import enveloped, filled, lookup

RECORD = (
    "game struct<gameId:string,actions:array<struct<actionNumber:int,clock:string,period:int,teamId:long,personId:long,playerName:string,"
    "scoreHome:string,scoreAway:string,description:string,actionType:string,subType:string>>>"
)
# Event types of the action types; others aren't plays.
PLAYS = {
    "Made Shot": "engage_decision", "Missed Shot": "engage_decision", "Free Throw": "ability_use", "Rebound": "resource_gain", "Turnover": "resource_spend",
    "Foul": "risk_accept", "Violation": "disengage_decision", "Substitution": "team_coordinate", "Timeout": "team_coordinate", "Jump Ball": "timing_commit", "period": "timing_commit",
}
CLOCK = r"^PT(\d+)M(\d+(?:\.\d+)?)S"
QUARTER, OVERTIME = 720, 300


def plays(records: DataFrame) -> DataFrame:
    """game_id, sequence_idx and the columns of every mapped action; clocks become seconds since the start.

    An unreadable clock stands for the start of a period as if all before it were quarters; zero and empty ids count
    as missing.
    """
    name = F.concat(F.lit("nba_"), F.coalesce(filled(F.col("game.gameId")), F.lit("unknown")))
    acts = records.select(name.alias("game_id"), F.posexplode("game.actions").alias("sequence_idx", "a")).withColumn("event_type", lookup(PLAYS, F.coalesce("a.actionType", F.lit("")))).where("event_type is not null")
    period = F.coalesce(F.when(F.col("a.period") != 0, F.col("a.period")), F.lit(1))
    clock = F.coalesce(filled(F.col("a.clock")), F.lit("PT12M00.00S"))
    left = F.regexp_extract(clock, CLOCK, 1).try_cast("double") * 60 + F.regexp_extract(clock, CLOCK, 2).try_cast("double")
    before = F.least(period - 1, F.lit(4)) * QUARTER + F.greatest(period - 5, F.lit(0)) * OVERTIME
    length = F.when(period <= 4, QUARTER).otherwise(OVERTIME)
    at = F.when(clock.rlike(CLOCK), (before + length - left).cast("double")).otherwise(((period - 1) * QUARTER).cast("double"))
    known = lambda c: F.when(c != 0, c.cast("string"))
    return acts.select(
        "game_id", F.col("sequence_idx").cast("long").alias("sequence_idx"), "event_type", at.alias("timestamp"), period.alias("period"), clock.alias("clock"),
        F.coalesce("a.actionType", F.lit("")).alias("action"), F.coalesce("a.subType", F.lit("")).alias("sub"),
        F.coalesce(known(F.col("a.personId")), filled(F.col("a.playerName")), F.lit("unknown")).alias("actor"), F.coalesce(known(F.col("a.teamId")), F.lit("")).alias("team"),
        F.substring(F.coalesce("a.description", F.lit("")), 1, 80).alias("description"), F.coalesce("a.scoreHome", F.lit("")).alias("home"), F.coalesce("a.scoreAway", F.lit("")).alias("away"),
    )


def events(records: DataFrame) -> DataFrame:
    """One event per possession: it starts with the first play, the last one says what it was and whose."""
    counted = state.running_count(plays(records), F.col("action") == "Foul", "fouls")
    ends = F.col("action").isin("Made Shot", "Turnover") | ((F.col("action") == "period") & (F.col("sub") == "end"))
    split = state.with_possessions(counted, ends, F.col("action") == "Rebound", F.col("team"))
    last = lambda c: F.max_by(c, "sequence_idx")
    per = split.groupBy("game_id", "possession").agg(
        F.min_by("timestamp", "sequence_idx").alias("timestamp"), last("event_type").alias("event_type"), last("actor").alias("actor"), last("team").alias("team"),
        last("period").alias("period"), F.min_by("clock", "sequence_idx").alias("clock_start"), last("clock").alias("clock_end"), F.count("*").alias("n_plays"),
        F.array_sort(F.collect_list(F.struct("sequence_idx", "description"))).alias("told"), last("home").alias("score_home"), last("away").alias("score_away"),
        last("action").alias("terminal_action"), last("timestamp").alias("_end"), last("fouls").alias("actor_foul_count_after"),
    )
    context = F.struct(
        "period", "clock_start", "clock_end", "n_plays", F.transform("told", lambda x: x["description"]).alias("play_descriptions"), "score_home", "score_away", "terminal_action",
        F.round(F.greatest(F.lit(0.0), F.col("_end") - F.col("timestamp")), 1).alias("time_in_possession_s"), "actor_foul_count_after",
    )
    made = per.withColumns({"context": context, "sequence_idx": F.col("possession"), "actor_team": filled(F.col("team")), "phase": F.lit("regular_season")})
    return enveloped(made, "nba")
