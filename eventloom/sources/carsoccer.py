"""Replay records of car soccer to events: statistics by player, replay hits, and goal lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.sources.common import enveloped, filled, lookup, record_id, spread

SIDE = (
    "struct<stats:struct<core:struct<goals:int>>,players:array<struct<id:struct<platform:string,id:string>,name:string,"
    "stats:struct<core:struct<shots:int,goals:int,saves:int,assists:int,demo:struct<inflicted:int>>,boost:struct<bcpm:double,count_collected_big:int,count_collected_small:int>>>>>"
)
RECORD = (
    f"id string, duration double, blue {SIDE}, orange {SIDE}, "
    "_hits array<struct<frame_number:double,player_id:struct<id:string>,hit_type:string,team:int,ball_data:struct<pos_x:double,pos_y:double,pos_z:double>,distance_to_goal:double>>, "
    "_players array<struct<id:struct<id:string>,boost_events:array<struct<frame:double,type:string,amount:int>>,boost_history:array<array<long>>>>, "
    "network_frames string, properties struct<Id:struct<value:string>,Goals:struct<value:array<struct<frame:long,PlayerName:struct<value:string>>>>>"
)
FRAMES, LOW_BOOST, DURATION = 30.0, 25, 300.0
# Event types of hits and boost events.
HITS = {
    "shot": "engage_decision", "save": "disengage_decision", "goal": "objective_capture", "assist": "team_coordinate", "epic_save": "disengage_decision", "hit": "objective_contest",
    "pass": "team_coordinate", "dribble": "position_commit", "aerial": "timing_commit", "clear": "disengage_decision", "demo": "risk_accept",
}
BOOST = {"pickup_big": "resource_gain", "pickup_small": "resource_gain", "use": "resource_spend", "depleted": "resource_spend", "low_boost": "resource_budget"}


def game_name() -> Column:
    return record_id("rl", F.coalesce(filled(F.col("id")), F.col("properties.Id.value")), F.struct("_hits", "properties", "blue", "orange"))


def from_statistics(records: DataFrame) -> DataFrame:
    """Goals spread evenly over the game in player order; each player's other counts spread evenly, a little later for
    each further player; boost use estimated from its rate per minute."""
    whole = F.greatest(F.coalesce("duration", F.lit(DURATION)), F.lit(1.0))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}.players").alias("players")) for s in ("blue", "orange")])
    players = F.flatten(F.transform(sides, lambda t: F.transform(F.coalesce(t["players"], F.array()), lambda p: F.struct(t["side"].alias("side"), p.alias("p")))))
    each = records.select(game_name().alias("game_id"), whole.alias("duration_s"), F.col("blue.stats.core.goals").alias("score_blue"), F.col("orange.stats.core.goals").alias("score_orange"), F.posexplode(players).alias("_player", "x"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    core, boost = "x.p.stats.core", "x.p.stats.boost"
    use = F.greatest(F.lit(0), (F.coalesce(f"{boost}.bcpm", F.lit(0.0)) * (F.col("duration_s") / 60.0) / 100.0).cast("int"))
    kinds = [
        ("objective_capture", count(f"{core}.goals"), None), ("engage_decision", count(f"{core}.shots"), "shot"), ("disengage_decision", count(f"{core}.saves"), "save"),
        ("team_coordinate", count(f"{core}.assists"), "assist"), ("risk_accept", count(f"{core}.demo.inflicted"), "demo_inflicted"),
        ("resource_gain", count(f"{boost}.count_collected_big") + count(f"{boost}.count_collected_small"), "boost_pickup"), ("resource_spend", use, None),
    ]
    counts = F.array(*[F.struct(F.lit(k).alias("event_type"), n.alias("n"), F.lit(label).alias("label")) for k, n, label in kinds])
    actor = F.concat_ws(":", F.coalesce("x.p.id.platform", F.lit("unknown")), F.coalesce("x.p.id.id", "x.p.name", F.lit("unknown")))
    rows = each.select("*", actor.alias("actor"), F.col("x.side").alias("actor_team"), F.posexplode(counts).alias("_kind", "c")).select("*", spread(F.col("c.n")).alias("_j"))
    # Goals of all players share one even spacing; a game has few of them.
    goal = F.col("_kind") == 0
    by_goal = Window.partitionBy("game_id", goal)
    nth = F.when(goal, F.row_number().over(by_goal.orderBy("_player", "_j"))).otherwise(F.col("_j"))
    of = F.when(goal, F.count("*").over(by_goal)).otherwise(F.col("c.n"))
    at = F.col("duration_s") / (of + 1) * nth + F.when(goal, 0.0).otherwise(F.col("_player") * 0.05)
    context = F.struct(F.lit(True).alias("synthetic"), F.col("actor_team").alias("team_color"), "duration_s", F.coalesce("score_blue", F.lit(0)).alias("score_blue"), F.coalesce("score_orange", F.lit(0)).alias("score_orange"), F.col("c.label").alias("action_label"))
    made = rows.withColumn("timestamp", at).select("game_id", "timestamp", "c.event_type", "actor", "actor_team", context.alias("context"), F.when(goal, 0).otherwise(1).alias("_group"), "_player", "_kind", "_j")
    return enveloped(made, "rocket_league", ["_group", "_player", "_kind", "_j"])


def from_hits(records: DataFrame) -> DataFrame:
    """Hits, boost events, and the frames at which a player's boost falls below the threshold."""
    named = records.select(game_name().alias("game_id"), "_hits", "_players")
    hits = named.select("game_id", F.posexplode("_hits").alias("_j", "h"))
    hit_kind = F.lower(F.coalesce("h.hit_type", F.lit("hit")))
    hit = F.to_json(F.struct(F.coalesce("h.ball_data.pos_x", F.lit(0.0)).alias("ball_x"), F.coalesce("h.ball_data.pos_y", F.lit(0.0)).alias("ball_y"), F.coalesce("h.ball_data.pos_z", F.lit(0.0)).alias("ball_z"), hit_kind.alias("hit_type"), F.coalesce("h.distance_to_goal", F.lit(0.0)).alias("distance_to_goal")))
    a = hits.select("game_id", F.lit(0).alias("_kind"), F.lit(0).alias("_player"), "_j", (F.coalesce("h.frame_number", F.lit(0.0)) / FRAMES).alias("timestamp"), lookup(HITS, hit_kind, "objective_contest").alias("event_type"), F.coalesce("h.player_id.id", F.lit("unknown")).alias("actor"), F.coalesce(F.col("h.team").cast("string"), F.lit("")).alias("actor_team"), hit.alias("_context"))
    players = named.select("game_id", F.posexplode("_players").alias("_player", "p"))
    who = F.coalesce("p.id.id", F.lit("unknown")).alias("actor")
    used = players.select("game_id", "_player", who, F.posexplode("p.boost_events").alias("_j", "b"))
    kind = F.coalesce("b.type", F.lit("pickup_big"))
    b = used.select("game_id", F.lit(1).alias("_kind"), "_player", "_j", (F.coalesce("b.frame", F.lit(0.0)) / FRAMES).alias("timestamp"), lookup(BOOST, kind, "resource_gain").alias("event_type"), "actor", F.lit(None).cast("string").alias("actor_team"), F.to_json(F.struct(kind.alias("boost_type"), F.coalesce("b.amount", F.lit(0)).alias("boost_amount"))).alias("_context"))
    history = players.select("game_id", "_player", who, F.posexplode("p.boost_history").alias("_j", "x"))
    levels = history.select("*", F.col("x")[0].alias("frame"), F.col("x")[1].alias("amount")).withColumn("_before", F.lag("amount").over(Window.partitionBy("game_id", "_player").orderBy("_j")))
    low = levels.where((F.col("_before") >= LOW_BOOST) & (F.col("amount") < LOW_BOOST))
    c = low.select("game_id", F.lit(2).alias("_kind"), "_player", "_j", (F.col("frame") / FRAMES).alias("timestamp"), F.lit("resource_budget").alias("event_type"), "actor", F.lit(None).cast("string").alias("actor_team"), F.to_json(F.struct(F.col("amount").alias("boost_amount"), F.lit(LOW_BOOST).alias("threshold"), F.lit("high_to_low").alias("transition"))).alias("_context"))
    every = a.unionByName(b).unionByName(c).withColumn("context", F.struct(F.col("_context").alias("json")))
    return enveloped(every, "rocket_league", ["_kind", "_player", "_j"]).withColumn("context", F.get_json_object("context", "$.json"))


def from_goals(records: DataFrame) -> DataFrame:
    """Goals alone, from the properties of a replay."""
    goals = records.select(game_name().alias("game_id"), F.posexplode("properties.Goals.value").alias("_j", "g"))
    made = goals.select("game_id", "_j", (F.coalesce("g.frame", F.lit(0)) / FRAMES).alias("timestamp"), F.lit("objective_capture").alias("event_type"), F.coalesce("g.PlayerName.value", F.lit("unknown")).alias("actor"), F.struct("g.frame").alias("context"))
    return enveloped(made, "rocket_league", ["_j"])


def events(records: DataFrame) -> DataFrame:
    """Each record in the way of its format; unknown formats give none."""
    hits = F.col("_hits").isNotNull()
    form = F.when(F.col("blue").isNotNull() & F.col("orange").isNotNull() & ~hits, "statistics").when(hits, "hits").when(F.col("network_frames").isNotNull(), "goals")
    named = records.withColumn("_form", form)
    made = [f(named.where(F.col("_form") == k)) for k, f in (("statistics", from_statistics), ("hits", from_hits), ("goals", from_goals))]
    return made[0].unionByName(made[1]).unionByName(made[2])
