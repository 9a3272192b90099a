"""The event schema over the driver's tables: a user's events are a game."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions import vocabulary as V
from eventloom.functions.expressions import chain_id
from eventloom.operators.windows import tumbling

TYPES = {"click": "engage_decision", "view": "position_commit", "purchase": "resource_spend", "signup": "zone_enter", "error": "player_idle"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game_id, cell, sequence_idx, t_us, timestamp, event_type, k, actor, value, period."""
    raw = table(spark, sf_dir, "events")
    game = Window.partitionBy("user_id")
    index = F.row_number().over(game.orderBy("ts", "event_id")) - 1
    k = F.get_json_object("props", "$.k").cast("long")
    kinds = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    first = raw.withColumn("_first", F.min("ts").over(game))
    t_us = F.expr("timestampdiff(MICROSECOND, _first, ts)")
    return first.select(
        F.col("user_id").alias("game_id"), F.element_at(F.array(*map(F.lit, V.CELLS)), (F.col("user_id") % 5 + 1).cast("int")).alias("cell"),
        index.cast("long").alias("sequence_idx"), t_us.alias("t_us"), (t_us / 1e6).alias("timestamp"), kinds[F.col("event_type")].alias("event_type"),
        k.alias("k"), F.concat(F.lit("player_"), (k % 7).cast("string")).alias("actor"), "value", F.floor(index / 15).cast("long").alias("period"),
    )


def chains(spark: SparkSession, sf_dir: str, size: int = 5) -> DataFrame:
    """Members of consecutive chains of `size` events: the event columns, chain_no, slot, chain_id."""
    cut = tumbling(events(spark, sf_dir), size)
    return cut.withColumn("chain_id", chain_id(F.col("game_id"), F.concat(F.lit("w_"), F.col("chain_no").cast("string"))))


EVENTS_SQL = r"""
ev AS (
  SELECT user_id AS game_id, (['pubg','nba','csgo','rocket_league','poker'])[CAST(user_id % 5 + 1 AS INTEGER)] AS cell,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence_idx,
         epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS t_us,
         CASE event_type WHEN 'click' THEN 'engage_decision' WHEN 'view' THEN 'position_commit' WHEN 'purchase' THEN 'resource_spend'
                         WHEN 'signup' THEN 'zone_enter' WHEN 'error' THEN 'player_idle' END AS event_type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         'player_' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 7) AS actor, value,
         (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 15 AS period,
         count(*) OVER (PARTITION BY user_id) AS n_game
  FROM events)"""
CHAINS_SQL = (
    EVENTS_SQL
    + r""",
ch AS (
  SELECT *, sequence_idx // 5 AS chain_no, sequence_idx % 5 AS slot, substr(md5(game_id || '__w_' || (sequence_idx // 5)), 1, 16) AS chain_id
  FROM ev WHERE n_game >= (sequence_idx // 5 + 1) * 5)"""
)
