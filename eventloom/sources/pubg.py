"""Battle-royale telemetry to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.sources.common import enveloped

PLAYER = "struct<accountId:string,name:string,type:string,teamId:string,location:struct<x:double,y:double,z:double>>"
RECORD = (
    "match_id string, match_attrs struct<createdAt:string,gameMode:string,mapName:string,duration:int,matchType:string>, "
    f"telemetry array<struct<_T:string,_D:string,killer:{PLAYER},finisher:{PLAYER},attacker:{PLAYER},victim:{PLAYER},character:{PLAYER},damage:double,damageCauserName:string,"
    "damageTypeCategory:string,damageReason:string,distance:double,dBNOId:long,item:struct<itemId:string,category:string,subCategory:string,stackCount:int>,"
    "vehicle:struct<vehicleType:string,vehicleId:string,fuelPercent:double>,"
    "gameState:struct<elapsedTime:double,numAlivePlayers:int,numAliveTeams:int,safetyZoneRadius:double,poisonGasWarningRadius:double>>>"
)
#: Damage below it isn't a decision; a zone shrinks if its radius falls by more than the step.
LEAST_DAMAGE, ZONE_STEP = 30.0, 1.0
# Event type and sub type of each log type.
KINDS = {
    "LogPlayerKillV2": ("engage_decision", "kill"), "LogPlayerKill": ("engage_decision", "kill"), "LogPlayerMakeGroggy": ("engage_decision", "groggy"),
    "LogPlayerTakeDamage": ("risk_accept", None), "LogGameStatePeriodic": ("zone_enter", None), "LogParachuteLanding": ("position_commit", "parachute_land"),
    "LogVehicleRide": ("position_commit", "vehicle_ride"), "LogVehicleLeave": ("position_commit", "vehicle_leave"),
    "LogItemPickup": ("resource_gain", None), "LogItemUse": ("resource_spend", None),
}


def histogram(records: DataFrame) -> DataFrame:
    """How often each log type occurs."""
    return records.select(F.explode("telemetry._T").alias("log_type")).groupBy("log_type").agg(F.count("*").alias("n"))


def seconds(when: Column, since: Column) -> Column:
    """From one ISO time text to another, never negative; 0 if either can't be read."""
    micros = lambda c: F.unix_micros(F.try_to_timestamp(c))
    return F.coalesce(F.greatest(F.lit(0.0), (micros(when) - micros(since)) / 1e6), F.lit(0.0))


def events(records: DataFrame) -> DataFrame:
    """Kills, knocks, hard hits, landings, rides and items of human players (other player types are bots), and every
    shrinking of the zone; ordered by time and then as logged."""
    logs = records.select(F.concat(F.lit("pubg_"), F.coalesce("match_id", F.lit(""))).alias("game_id"), F.col("match_attrs.createdAt").alias("_since"), F.posexplode("telemetry").alias("_at", "e"))
    kind = F.col("e._T")
    known = logs.where(kind.isin(*KINDS))
    is_zone = kind == "LogGameStatePeriodic"
    who = (
        F.when(kind.isin("LogPlayerKillV2", "LogPlayerKill"), F.coalesce("e.killer", "e.finisher")).when(kind == "LogPlayerMakeGroggy", F.col("e.attacker"))
        .when(kind == "LogPlayerTakeDamage", F.col("e.victim")).when(~is_zone, F.col("e.character"))
    )
    radius = F.col("e.gameState.safetyZoneRadius")
    # Every observed radius is what the next one is compared with, whether it made an event or not.
    seen = Window.partitionBy("game_id", F.when(is_zone & radius.isNotNull(), 1).otherwise(0)).orderBy("_at")
    placed = known.withColumns({"_who": who, "_before": F.when(is_zone, F.lag(radius).over(seen))})
    human = F.col("_who").isNotNull() & (F.coalesce("_who.type", F.lit("user")) == "user")
    shrinks = radius.isNotNull() & (F.col("_before").isNull() | (radius < F.col("_before") - ZONE_STEP))
    hard = (kind != "LogPlayerTakeDamage") | (F.coalesce("e.damage", F.lit(0.0)) >= LEAST_DAMAGE)
    kept = placed.where(F.when(is_zone, shrinks).otherwise(human & hard))
    first = lambda i: F.create_map(*[F.lit(x) for k, v in KINDS.items() if v[i] for x in (k, v[i])])[kind]
    victim = F.when(kind.isin("LogPlayerKillV2", "LogPlayerKill", "LogPlayerMakeGroggy"), F.col("e.victim.accountId"))
    context = F.struct(
        first(1).alias("sub_type"), F.col("_who.location").alias("loc"), victim.alias("victim_id"), F.when(victim.isNotNull(), F.col("e.damageCauserName")).alias("weapon"),
        F.when(kind == "LogPlayerTakeDamage", F.col("e.damage")).alias("damage"), F.when(kind == "LogPlayerTakeDamage", F.col("e.damageTypeCategory") == "Damage_BlueZone").alias("is_blue_zone"),
        F.col("e.item.itemId").alias("item_id"), F.col("e.item.stackCount").alias("stack_count"), F.col("e.vehicle.vehicleType").alias("vehicle_type"),
        F.when(is_zone, radius).alias("safety_zone_radius"), F.when(is_zone, F.col("e.gameState.numAlivePlayers")).alias("num_alive_players"),
    )
    phase = F.when(is_zone, F.concat(F.lit("zone_"), F.coalesce("e.gameState.elapsedTime", F.lit(0.0)).cast("int").cast("string"), F.lit("s")))
    made = kept.select(
        "game_id", "_at", seconds(F.col("e._D"), F.col("_since")).alias("timestamp"), first(0).alias("event_type"),
        F.when(is_zone, "zone").otherwise(F.coalesce("_who.accountId", F.lit("unknown"))).alias("actor"), F.when(~is_zone & (F.col("_who.teamId") != ""), F.col("_who.teamId")).alias("actor_team"),
        phase.alias("phase"), context.alias("context"),
    )
    return enveloped(made, "pubg", ["_at"])
