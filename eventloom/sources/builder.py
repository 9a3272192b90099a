"""Event chunks of a building game's replays to events, and the chunks' binary form."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.sources.common import enveloped, filled, lookup, record_id

#: Metadata values that aren't texts are read as their JSON.
RECORD = "match_id string, events array<struct<id:string,`group`:string,metadata:map<string,string>,time1_ms:long,time2_ms:long>>"
CHUNK = "id string, `group` string, metadata map<string,string>, time1_ms long, time2_ms long"
# Weapons that aren't a fight, groups that say nothing about play, and where an actor may be named.
WEAPONS = {"fall": "risk_accept", "storm": "zone_exit", "environment": "risk_accept"}
SILENT = ("AthenaMatchStats", "PlayerLogin", "AthenaMatchTeamStats")
ACTORS = ("playerId", "actorId", "accountId", "player", "actor")


def named(meta: Column, *keys: str) -> Column:
    """The first filled one of several names of a value."""
    return filled(*[meta[k] for k in keys])


def events(records: DataFrame) -> DataFrame:
    """Eliminations, phases of the storm, and other groups that name an actor; the time is the middle of the chunk's."""
    chunks = records.select(record_id("fnc", F.col("match_id"), F.struct("events")).alias("game_id"), F.posexplode("events").alias("_at", "e"))
    meta, group = F.coalesce("e.metadata", F.create_map().cast("map<string,string>")), F.coalesce("e.group", F.lit(""))
    elim, phase = group == "playerElim", group.isin("PhaseChange", "stateEvent")
    weapon = F.lower(F.coalesce(meta["weapon"], meta["gunType"], F.lit("unknown")))
    other = named(meta, *ACTORS)
    kept = chunks.where(elim | phase | (~group.isin(*SILENT) & other.isNotNull() & (other != "unknown")))
    number = F.coalesce(meta["phase"], meta["Phase"], meta["stormPhase"], F.lit("0")).try_cast("double").cast("int")
    real = lambda *keys: F.coalesce(*[meta[k].try_cast("double") for k in keys], F.lit(0.0))
    context = F.struct(
        F.when(elim, F.coalesce(named(meta, "eliminated", "EliminatedId", "victimId"), F.lit("unknown"))).alias("victim"), F.when(elim, weapon).alias("weapon"),
        F.when(elim, F.coalesce(meta["knocked"], meta["isKnocked"], F.lit("false")).try_cast("boolean")).alias("knocked"),
        F.when(phase, number).alias("storm_phase"), F.when(phase, real("circleCenterX", "X")).alias("circle_x"), F.when(phase, real("circleCenterY", "Y")).alias("circle_y"),
        F.when(phase, real("circleRadius", "radius")).alias("circle_radius"), F.when(~elim & ~phase, group).alias("group"),
    )
    made = kept.select(
        "game_id", "_at", ((F.coalesce("e.time1_ms", F.lit(0)) + F.coalesce("e.time2_ms", F.lit(0))) / 2.0 / 1000.0).alias("timestamp"),
        F.when(elim, lookup(WEAPONS, weapon, "engage_decision")).when(phase, "zone_enter").otherwise("position_commit").alias("event_type"),
        F.when(elim, F.coalesce(named(meta, "eliminator", "EliminatorId", "killerId"), F.lit("unknown"))).when(phase, "storm").otherwise(other).alias("actor"),
        F.when(phase, F.concat(F.lit("storm_phase_"), number.cast("string"))).alias("phase"), context.alias("context"),
    )
    return enveloped(made, "fortnite", ["_at"])


def text_at(data: bytes, at: int) -> tuple[str, int]:
    """A text with its length before it: positive for single bytes, negative for UTF-16; one that runs out is empty."""
    if at + 4 > len(data):
        return "", at
    (n,) = struct.unpack_from("<i", data, at)
    end = at + 4 + (n if n >= 0 else -2 * n)
    if end > len(data):
        return "", at + 4
    return data[at + 4 : end].decode("latin-1" if n >= 0 else "utf-16-le", "replace").rstrip("\0"), end


def chunk_of(data: bytes) -> tuple | None:
    """id, group, metadata, both times; None if the times are missing."""
    id, at = text_at(data, 0)
    group, at = text_at(data, at)
    told, at = text_at(data, at)
    if at + 8 > len(data):
        return None
    try:
        found = json.loads(told) if told else {}
    except ValueError:
        found = {"raw": told}
    if not isinstance(found, dict):
        found = {"raw": told}
    meta = {k: v if isinstance(v, str) else json.dumps(v) for k, v in found.items() if v is not None}
    return id, group, meta, *struct.unpack_from("<II", data, at)


def parsed_chunks(chunks: DataFrame) -> DataFrame:
    """match_id, place and the fields of binary chunks (match_id, place, data); unreadable ones give none."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(m, p, *found) for m, p, d in zip(part["match_id"], part["place"], part["data"], strict=True) if d is not None and (found := chunk_of(d))]
            yield pd.DataFrame(rows, columns=["match_id", "place", "id", "group", "metadata", "time1_ms", "time2_ms"])

    return chunks.select("match_id", "place", "data").mapInPandas(made, f"match_id string, place int, {CHUNK}")


def records(parsed: DataFrame) -> DataFrame:
    """Chunks of a match gathered to a record, as `events` reads them; a match has few hundred."""
    per = parsed.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("place", "id", "group", F.to_json("metadata").alias("m"), "time1_ms", "time2_ms"))).alias("x"))
    return per.select("match_id", F.transform("x", lambda c: F.struct(c["id"].alias("id"), c["group"].alias("group"), F.from_json(c["m"], "map<string,string>").alias("metadata"), c["time1_ms"].alias("time1_ms"), c["time2_ms"].alias("time2_ms"))).alias("events"))
