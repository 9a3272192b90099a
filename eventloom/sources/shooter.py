"""Round-based shooter records to events: match statistics by player, and demo records by tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.sources.common import enveloped, lookup, record_id, spread

RECORD = (
    "matchID string, mapName string, rounds array<struct<match_id:string,round_stats:map<string,string>,"
    "teams:array<struct<team_id:string,nickname:string,players:array<struct<player_id:string,nickname:string,player_stats:map<string,string>>>>>,"
    "roundNum:int,startTick:double,ctEqVal:int,tEqVal:int,ctBuyType:string,tBuyType:string,"
    "kills:array<struct<tick:double,weapon:string,weaponClass:string,attackerSteamID:string,victimSteamID:string,isHeadshot:boolean,attackerSide:string,attackerX:double,attackerY:double>>,"
    "grenades:array<struct<throwTick:double,grenadeType:string,throwerSteamID:string,grenadeX:double,grenadeY:double>>,"
    "bombEvents:array<struct<tick:double,bombAction:string,playerSteamID:string,bombSite:string>>>>"
)
ROUND_SECONDS, TICKS, ROUNDS = 115.0, 128.0, 30
# Event types of statistics, weapon classes and bomb actions. Grenades are all ability_use.
STATISTICS = (("Kills", "engage_decision", "kill"), ("Assists", "team_coordinate", "assist"), ("Flash Count", "ability_use", "flash"), ("Entry Count", "zone_enter", "entry"), ("MVPs", "objective_capture", "mvp"))
WEAPONS = {
    "rifle": "engage_decision", "pistol": "engage_decision", "sniper": "engage_decision", "smg": "engage_decision", "heavy": "engage_decision",
    "knife": "risk_accept", "grenade": "ability_use", "molotov": "ability_use", "c4": "objective_contest",
}
BOMB = {"plant_begin": "objective_contest", "plant": "objective_capture", "defuse_begin": "objective_contest", "defuse": "objective_capture", "explode": "objective_capture"}


def has_statistics() -> Column:
    """Whether a record is match statistics and not a demo: its first round has both statistics and teams."""
    first = F.get("rounds", F.lit(0))
    return F.coalesce(first["round_stats"].isNotNull() & first["teams"].isNotNull(), F.lit(False))


def from_statistics(records: DataFrame) -> DataFrame:
    """Counts of each player spread evenly over a map's rounds."""
    name = record_id("csgo", F.get("rounds", F.lit(0))["match_id"], F.struct("rounds"))
    maps = records.select(name.alias("game_id"), F.posexplode("rounds").alias("_map", "m"))
    teams = maps.select("game_id", "_map", F.col("m.round_stats").alias("stats"), F.posexplode("m.teams").alias("_team", "t"))
    players = teams.select("game_id", "_map", "_team", "stats", "t.team_id", "t.nickname", F.posexplode("t.players").alias("_player", "p"))
    counts = F.array(*[F.struct(F.col("p.player_stats")[k].try_cast("int").alias("n"), F.lit(kind).alias("event_type"), F.lit(label).alias("label")) for k, kind, label in STATISTICS])
    kinds = players.select("*", F.posexplode(counts).alias("_kind", "c"))
    rounds = F.greatest(F.lit(1), F.coalesce(F.col("stats")["Rounds"].try_cast("int"), F.lit(ROUNDS)))
    each = kinds.withColumn("_rounds", rounds).select("*", spread(F.col("c.n")).alias("_j"))
    number = F.least(F.col("_rounds") - 1, F.floor(F.col("_rounds") / (F.col("c.n") + 1) * F.col("_j")).cast("int"))
    placed = each.withColumn("round", number)
    context = F.struct(
        "round", F.coalesce(F.col("stats")["Map"], F.lit("unknown")).alias("map"), "team_id", F.coalesce("nickname", F.lit("team")).alias("team_name"),
        F.coalesce(F.col("stats")["Winner"], F.lit("")).alias("winner_faction"), F.coalesce(F.col("stats")["Score"], F.lit("")).alias("match_score"), F.col("c.label").alias("action_label"),
    )
    made = placed.select(
        "game_id", "_map", "_team", "_player", "_kind", "_j", (F.col("round") * ROUND_SECONDS + F.col("_j") * 0.5).alias("timestamp"), "c.event_type",
        F.coalesce("p.player_id", "p.nickname", F.lit("unknown")).alias("actor"), F.concat(F.lit("round_"), F.col("round").cast("string")).alias("phase"), context.alias("context"),
    )
    return enveloped(made, "csgo", ["_map", "_team", "_player", "_kind", "_j"])


def from_demos(records: DataFrame) -> DataFrame:
    """Kills, grenades, bomb actions and the purchases of every round."""
    name = record_id("csgo", F.col("matchID"), F.struct("rounds"))
    rounds = records.select(name.alias("game_id"), F.posexplode("rounds").alias("_round", "r"))
    start = F.coalesce("r.startTick", F.lit(0.0)) / TICKS
    number = F.coalesce("r.roundNum", F.lit(0))
    held = rounds.select("game_id", "_round", start.alias("_start"), number.alias("round"), "r")
    after = lambda tick: (F.col("_start") + F.coalesce(tick, F.lit(0.0)) / TICKS).alias("timestamp")

    def part(rank: int, items: str, tick: str, kind: Column, who: str, *context: Column) -> DataFrame:
        each = held.select("game_id", "_round", "_start", "round", F.lit(rank).alias("_kind"), F.posexplode(f"r.{items}").alias("_j", "x"))
        return each.select("game_id", "_round", "_kind", "_j", after(F.col(f"x.{tick}")), kind.alias("event_type"), F.coalesce(f"x.{who}", F.lit("unknown")).alias("actor"), "round", F.to_json(F.struct("round", *context)).alias("_context"))

    kills = part(0, "kills", "tick", lookup(WEAPONS, F.lower(F.coalesce("x.weaponClass", F.lit("rifle"))), "engage_decision"), "attackerSteamID", F.coalesce("x.weapon", F.lit("unknown")).alias("weapon"), F.coalesce("x.victimSteamID", F.lit("unknown")).alias("victim"), F.coalesce("x.isHeadshot", F.lit(False)).alias("headshot"), F.coalesce("x.attackerSide", F.lit("")).alias("attacker_side"))
    grenades = part(1, "grenades", "throwTick", F.lit("ability_use"), "throwerSteamID", F.lower(F.coalesce("x.grenadeType", F.lit("flashbang"))).alias("grenade_type"))
    bombs = part(2, "bombEvents", "tick", lookup(BOMB, F.coalesce("x.bombAction", F.lit("plant")), "objective_contest"), "playerSteamID", F.coalesce("x.bombSite", F.lit("")).alias("bomb_site"), F.coalesce("x.bombAction", F.lit("plant")).alias("bomb_action"))
    spent = F.to_json(F.struct("round", F.coalesce("r.ctEqVal", F.lit(0)).alias("ct_equipment_value"), F.coalesce("r.tEqVal", F.lit(0)).alias("t_equipment_value"), F.coalesce("r.ctBuyType", F.lit("")).alias("ct_spend_type"), F.coalesce("r.tBuyType", F.lit("")).alias("t_spend_type")))
    buys = held.select("game_id", "_round", F.lit(3).alias("_kind"), F.lit(0).alias("_j"), F.col("_start").alias("timestamp"), F.lit("resource_budget").alias("event_type"), F.lit("round_start").alias("actor"), "round", spent.alias("_context"))
    every = kills.unionByName(grenades).unionByName(bombs).unionByName(buys).withColumn("phase", F.concat(F.lit("round_"), F.col("round").cast("string")))
    done = enveloped(every.withColumnRenamed("_context", "context").withColumn("context", F.struct(F.col("context").alias("json"))), "csgo", ["_round", "_kind", "_j"])
    return done.withColumn("context", F.get_json_object("context", "$.json"))


def events(records: DataFrame) -> DataFrame:
    """Each record in the way of its format."""
    named = records.withColumn("_statistics", has_statistics())
    return from_statistics(named.where("_statistics")).unionByName(from_demos(named.where("not _statistics")))


def finished(matches: DataFrame) -> DataFrame:
    """Finished matches (status, teams array of rosters) with five players or more on both sides."""
    return matches.where((F.upper("status") == "FINISHED") & (F.size(F.filter("teams", lambda t: F.size(t["roster"]) >= 5)) >= 2))


