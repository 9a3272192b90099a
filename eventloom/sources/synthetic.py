"""Synthetic event streams: hash-random, reproducible at any number of partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Per cell, strata of (share of games, events per game, tag).
STRATA = {
    "pubg": ((0.5, 250, "solo"), (0.5, 250, "squad")), "nba": ((0.8, 180, "regular_season"), (0.2, 200, "playoff")),
    "csgo": ((1 / 3, 300, "major"), (1 / 3, 300, "premier"), (1 / 3, 300, "open")), "rocket_league": ((0.5, 200, "champion"), (0.35, 200, "diamond"), (0.15, 200, "platinum")),
    "poker": ((0.6, 24, "cash"), (0.4, 20, "tournament")), "fortnite": ((0.7, 120, "pro"), (0.3, 120, "open")),
}
TYPES = ("engage_decision", "disengage_decision", "position_commit", "zone_enter", "zone_exit", "resource_gain", "resource_spend", "objective_capture", "ability_use", "risk_accept", "timing_commit")
#: Games that one task makes.
PER_TASK = 10_000


def uniform(*parts: Column) -> Column:
    """A number from 0 up to 1 by a 64-bit hash of its parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def games_of(spark: SparkSession, games: dict[str, int]) -> DataFrame:
    """cell, _game, _n (its events), _tag of so many games of each cell, stratum by stratum."""
    made = []
    for cell, count in games.items():
        at, first = 0.0, 0
        for k, (share, size, tag) in enumerate(STRATA[cell]):
            at += share
            end = count if k == len(STRATA[cell]) - 1 else round(at * count)
            ids = spark.range(first, end, numPartitions=max(1, -(-(end - first) // PER_TASK)))
            made.append(ids.select(F.lit(cell).alias("cell"), F.col("id").alias("_game"), F.lit(size).alias("_n"), F.lit(tag).alias("_tag")))
            first = end
    return reduce(DataFrame.unionByName, made)


def streams_of(spark: SparkSession, games: dict[str, int], seed: int = 0, types: tuple[str, ...] = TYPES, actors: int = 10) -> DataFrame:
    """The envelope of synthetic games of several cells, in one plan: gaps of 0.5 to 10 seconds, random types, actors and
    places; periods, rounds and streets by the place in the game."""
    rows = games_of(spark, games).select("*", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_n") - 1).cast("long"))).alias("sequence_idx"))
    draw = lambda name: uniform(F.lit(seed), "cell", "_game", "sequence_idx", F.lit(name))
    pick = lambda name, n: F.floor(draw(name) * n).cast("int")
    until = Window.partitionBy("cell", "_game").orderBy("sequence_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = rows.withColumn("_gap", F.lit(0.5) + draw("gap") * 9.5).withColumn("timestamp", F.round(F.sum("_gap").over(until), 3))
    i, n, cell = F.col("sequence_idx"), F.col("_n"), F.col("cell")
    street = F.when(i < F.floor(n * 0.5), "preflop").when(i < F.floor(n * 0.75), "flop").when(i < F.floor(n * 0.9), "turn").otherwise("river")
    period = F.least(F.lit(4), F.floor(i / F.greatest(F.lit(1), F.floor(n / 4))) + 1).cast("int")
    number = F.least(F.lit(29), F.floor(i / F.greatest(F.lit(1), F.floor(n / 30)))).cast("int")
    phase = F.when(cell == "poker", street).when(cell == "csgo", F.concat(F.lit("round_"), number.cast("string"))).otherwise("mock_phase")
    # Fields that a cell doesn't have are null, and nulls aren't written.
    more = (F.when(cell == "nba", period).alias("period"), F.when(cell == "csgo", number).alias("round"), F.when(cell == "poker", street).alias("street"))
    context = F.struct(F.round(draw("x") * 100, 6).alias("x"), F.round(draw("y") * 100, 6).alias("y"), F.col("_tag").alias("stratum"), *more)
    name = F.col("_game").cast("string")
    return made.select(
        F.concat("cell", F.lit("_mock_"), F.when(F.length(name) < 6, F.lpad(name, 6, "0")).otherwise(name)).alias("game_id"), "cell", "sequence_idx", "timestamp",
        F.get(F.array(*map(F.lit, types)), pick("type", len(types))).alias("event_type"), F.concat(F.lit("player_"), pick("actor", actors).cast("string")).alias("actor"),
        F.lit(None).cast("string").alias("actor_team"), phase.alias("phase"), F.to_json(context).alias("context"),
    )


def streams(spark: SparkSession, cell: str, games: int, seed: int = 0, types: tuple[str, ...] = TYPES, actors: int = 10) -> DataFrame:
    """`streams_of` for one cell."""
    return streams_of(spark, {cell: games}, seed, types, actors)
