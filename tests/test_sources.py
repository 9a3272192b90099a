"""Raw records of every source to events, on small hand-made records."""

from __future__ import annotations

import json
import struct

import pytest
from pyspark.sql import functions as F

from eventloom.sources import builder, carsoccer, common, files, nba, poker, pubg, shooter, synthetic


def records(spark, schema, *made):
    lines = spark.createDataFrame([(json.dumps(m),) for m in made], "value string")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def got(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("game_id", "sequence_idx").collect()]


def play(clock, kind, sub="", who=0, team=0, text=""):
    return {"clock": clock, "period": 1, "teamId": team, "personId": who, "playerName": "", "actionType": kind, "subType": sub, "description": text, "scoreHome": "0", "scoreAway": "2"}


def test_possessions(spark):
    a, b = 11, 22
    game = {"game": {"gameId": "7", "actions": [
        play("PT12M00.00S", "period", "start"), play("PT12M00.00S", "Jump Ball", who=1, team=a), play("PT11M32.00S", "Made Shot", who=2, team=b),
        play("PT11M25.00S", "Rebound", who=1, team=a), play("PT11M00.00S", "Missed Shot", who=1, team=a), play("PT10M58.00S", "Rebound", who=2, team=b),
        play("PT10M30.00S", "Made Shot", who=2, team=b, text="x" * 90), play("PT10M10.00S", "Turnover", who=1, team=a), play("PT10M00.00S", "Foul", who=2, team=b),
        play("PT00M00.00S", "period", "end"), play("broken", "unmapped kind"),
    ]}}
    found = nba.events(records(spark, nba.RECORD, game, {"game": {"gameId": "8", "actions": []}}))
    rows = got(found, "sequence_idx", "timestamp", "event_type", "actor", "actor_team")
    assert rows == [(0, 0.0, "engage_decision", "2", "22"), (1, 35.0, "resource_gain", "2", "22"), (2, 90.0, "engage_decision", "2", "22"), (3, 110.0, "resource_spend", "1", "11"), (4, 120.0, "timing_commit", "unknown", None)]
    context = [json.loads(r["context"]) for r in found.orderBy("sequence_idx").collect()]
    assert [(c["terminal_action"], c["n_plays"], c["time_in_possession_s"]) for c in context] == [("Made Shot", 3, 28.0), ("Rebound", 3, 27.0), ("Made Shot", 1, 0.0), ("Turnover", 1, 0.0), ("period", 2, 600.0)]
    assert max(map(len, context[2]["play_descriptions"])) == 80 and found.columns == list(common.ENVELOPE)


def test_clocks(spark):
    made = [{"game": {"gameId": str(p), "actions": [dict(play(c, "Foul"), period=p)]}} for p, c in ((1, "PT12M00.00S"), (4, "PT00M30.50S"), (5, "PT05M00.00S"), (7, "PT04M00.00S"), (3, "no"), (2, ""))]
    rows = {r["period"]: r["timestamp"] for r in nba.plays(records(spark, nba.RECORD, *made)).collect()}
    assert rows == {1: 0.0, 4: 2849.5, 5: 2880.0, 7: 2880 + 600 + 60.0, 3: 1440.0, 2: 720.0}


def test_telemetry(spark):
    human, bot = {"accountId": "h", "teamId": "3"}, {"accountId": "b", "type": "user_ai"}
    at = lambda s: f"2024-01-01T00:00:{s:02d}.500Z"
    log = [
        {"_T": "LogParachuteLanding", "_D": at(3), "character": human}, {"_T": "LogParachuteLanding", "_D": at(4), "character": bot},
        {"_T": "LogGameStatePeriodic", "_D": at(5), "gameState": {"safetyZoneRadius": 100.0, "elapsedTime": 5}}, {"_T": "LogGameStatePeriodic", "_D": at(6), "gameState": {"safetyZoneRadius": 99.5}},
        {"_T": "LogGameStatePeriodic", "_D": at(7), "gameState": {}}, {"_T": "LogGameStatePeriodic", "_D": at(8), "gameState": {"safetyZoneRadius": 98.4}},
        {"_T": "LogPlayerTakeDamage", "_D": at(9), "victim": human, "damage": 29.9}, {"_T": "LogPlayerTakeDamage", "_D": at(2), "victim": human, "damage": 30},
        {"_T": "LogPlayerKillV2", "_D": "bad", "finisher": human, "victim": bot, "damageCauserName": "gun"}, {"_T": "LogItemUse", "_D": at(10), "character": human}, {"_T": "LogOther", "_D": at(1)},
    ]
    raw = records(spark, pubg.RECORD, {"match_id": "m", "match_attrs": {"createdAt": "2024-01-01T00:00:00Z"}, "telemetry": log})
    rows = got(pubg.events(raw), "sequence_idx", "timestamp", "event_type", "actor", "phase")
    assert rows == [
        (0, 0.0, "engage_decision", "h", None), (1, 2.5, "risk_accept", "h", None), (2, 3.5, "position_commit", "h", None), (3, 5.5, "zone_enter", "zone", "zone_5s"),
        (4, 8.5, "zone_enter", "zone", "zone_0s"), (5, 10.5, "resource_spend", "h", None),
    ]
    assert {r["log_type"]: r["n"] for r in pubg.histogram(raw).collect()}["LogGameStatePeriodic"] == 4


def test_match_statistics(spark):
    players = [{"player_id": f"p{i}", "player_stats": {"Kills": "3", "Assists": "0", "MVPs": "1"}} for i in range(2)]
    raw = records(spark, shooter.RECORD, {"rounds": [{"match_id": "x", "round_stats": {"Map": "m", "Rounds": "4"}, "teams": [{"team_id": "t", "players": players}]}]})
    rows = got(shooter.events(raw), "timestamp", "event_type", "actor", "phase")
    want = [(r * 115.0 + j * 0.5, k, f"p{i}", f"round_{r}") for i in range(2) for k, js in (("engage_decision", ((1, 1), (2, 2), (3, 3))), ("objective_capture", ((1, 2),))) for j, r in js]
    assert sorted(rows) == sorted(want) and [r[0] for r in rows] == sorted(r[0] for r in rows)


def test_demos(spark):
    rounds = [
        {"roundNum": 1, "startTick": 0, "ctEqVal": 5, "kills": [{"tick": 1280, "weaponClass": "Pistol", "attackerSteamID": "1"}, {"tick": 6400, "weaponClass": "knife"}], "grenades": [{"throwTick": 2000}], "bombEvents": [{"tick": 9600, "bombAction": "plant", "playerSteamID": "1"}]},
        {"roundNum": 2, "startTick": 13_000, "kills": [{"tick": 14_000}], "grenades": [], "bombEvents": []},
    ]
    rows = got(shooter.events(records(spark, shooter.RECORD, {"matchID": "d", "rounds": rounds})), "timestamp", "event_type", "actor")
    assert rows == [
        (0.0, "resource_budget", "round_start"), (10.0, "engage_decision", "1"), (15.625, "ability_use", "unknown"), (50.0, "risk_accept", "unknown"),
        (75.0, "objective_capture", "1"), (101.5625, "resource_budget", "round_start"), (210.9375, "engage_decision", "unknown"),
    ]


def test_car_soccer(spark):
    core = lambda **k: {"id": {"platform": "s", "id": k.pop("id")}, "stats": {"core": {x: y for x, y in k.items() if x != "demo"} | {"demo": {"inflicted": k.get("demo", 0)}}, "boost": {"bcpm": 200.0, "count_collected_big": 1, "count_collected_small": 1}}}
    team = lambda n, *players: {"stats": {"core": {"goals": n}}, "players": list(players)}
    a = {"id": "a", "duration": 300, "blue": team(1, core(id="1", goals=1, shots=2)), "orange": team(1, core(id="2", goals=1, saves=1, demo=1))}
    hits = {"id": "b", "_hits": [{"frame_number": 30, "player_id": {"id": "q"}, "hit_type": "Shot", "team": 0}], "_players": [{"id": {"id": "q"}, "boost_events": [{"frame": 15, "type": "use"}], "boost_history": [[0, 50], [50, 20], [60, 10], [70, 30], [80, 24]]}]}
    goals = {"network_frames": "x", "properties": {"Id": {"value": "c"}, "Goals": {"value": [{"frame": 90, "PlayerName": {"value": "z"}}]}}}
    found = carsoccer.events(records(spark, carsoccer.RECORD, a, hits, goals, {"id": "unknown"}))
    rows = got(found, "game_id", "timestamp", "event_type", "actor")
    assert [r for r in rows if r[2] == "objective_capture"] == [("rl_a", 100.0, "objective_capture", "s:1"), ("rl_a", 200.0, "objective_capture", "s:2"), ("rl_c", 3.0, "objective_capture", "z")]
    assert [r[1:] for r in rows if r[0] == "rl_b"] == [(0.5, "resource_spend", "q"), (1.0, "engage_decision", "q"), (50 / 30, "resource_budget", "q"), (80 / 30, "resource_budget", "q")]
    kinds = [r[2] for r in rows if r[0] == "rl_a"]
    assert {k: kinds.count(k) for k in set(kinds)} == {"objective_capture": 2, "engage_decision": 2, "disengage_decision": 1, "risk_accept": 1, "resource_gain": 4, "resource_spend": 20}
    assert (150.05, "disengage_decision") in {(round(r[1], 6), r[2]) for r in rows}


HAND = 'players = ["x", "y", "z"]\nstarting_stacks = [10000, inf, 10000]\nblinds_or_straddles = [50, 100, 0]\nactions = ["d dh p1 2c3d", "p2 f", "p0 cbr 300", "p1 cc", "d db 2s3h4d", "p0 cbr 600", "p1 f", "p9 f", "p0 sm"]\n'


def test_hands(spark, tmp_path):
    folder = tmp_path / "data" / "wsop" / "2023"
    folder.mkdir(parents=True)
    (folder / "one.phh").write_text(HAND)
    (folder / "bad.phh").write_text("= no")
    six = HAND.replace('["x", "y", "z"]', '["a","b","c","d","e","f"]')
    for stake, text in (("200", six), ("25", six), ("600", HAND)):
        cash = tmp_path / "data" / "handhq" / f"S_{stake}NLH_O"
        cash.mkdir(parents=True)
        body = "".join(f"[{k}]\n{text}\n" for k in (1, 2, 3))
        (cash / f"s{stake}.phhs").write_text(body)
    found = poker.hands(poker.read_files(spark, str(tmp_path))).cache()
    assert sorted(r["game_id"] for r in found.collect()) == ["pk_one", "pk_s200_1", "pk_s200_2", "pk_s200_3"]
    assert {r["subset"] for r in found.collect()} == {"wsop", "handhq"}
    assert sorted(r["game_id"] for r in poker.stratified(found, 83 + 8).collect()) == ["pk_one", "pk_s200_1", "pk_s200_2"]
    rows = poker.events(found.where("game_id = 'pk_one'")).orderBy("sequence_idx").collect()
    told = [(r["actor"], r["timestamp"], json.loads(r["context"])) for r in rows]
    assert [(a, c["action"], c["street"], t, c["bet_size_bb"], c["pot_size_bb"], c["position"]) for a, t, c in told] == [
        ("actor_2", "f", "preflop", 0.0, 0.0, 1.5, "BB"), ("actor_0", "cbr", "preflop", 3.0, 3.0, 4.0, "BTN"), ("actor_1", "cc", "preflop", 6.0, 2.0, 6.0, "SB"),
        ("actor_0", "cbr", "flop", 11.0, 6.0, 12.0, "BTN"), ("actor_1", "f", "flop", 14.0, 0.0, 12.0, "SB"),
    ]
    assert [c["stack_bb"] for _, _, c in told] == [100.0, 97.0, 9997.0, 91.0, 9997.0]
    assert [r["event_type"] for r in rows][0] == "disengage_decision"


def test_chunks(spark):
    text = lambda s: struct.pack("<i", len(s) + 1) + s.encode() + b"\0" if s.isascii() else struct.pack("<i", -len(s) - 1) + s.encode("utf-16-le") + b"\0\0"
    chunk = lambda group, meta, a, b: text("id") + text(group) + text(meta if isinstance(meta, str) else json.dumps(meta)) + struct.pack("<II", a, b)
    made = [
        chunk("PhaseChange", {"phase": 2, "circleRadius": 10}, 240_000, 240_000), chunk("playerElim", {"eliminator": "p1", "EliminatedId": "p2", "weapon": "Storm", "knocked": True}, 120_000, 121_000),
        chunk("AthenaMatchStats", {"playerId": "x"}, 1, 1), chunk("other", {"player": "wér"}, 5_000, 5_000), chunk("other", "not json", 6_000, 6_000), b"\x01",
    ]
    frame = spark.createDataFrame([("m", i, c) for i, c in enumerate(made)], "match_id string, place int, data binary")
    parsed = builder.parsed_chunks(frame)
    assert parsed.count() == 5
    rows = got(builder.events(builder.records(parsed)), "timestamp", "event_type", "actor", "phase")
    assert rows == [(5.0, "position_commit", "wér", None), (120.5, "zone_exit", "p1", None), (240.0, "zone_enter", "storm", "storm_phase_2")]


@pytest.mark.parametrize("cell", list(synthetic.STRATA))
def test_synthetic_streams(spark, cell):
    made = synthetic.streams(spark, cell, 10)
    sizes = [r["count"] for r in made.groupBy("game_id").count().collect()]
    assert len(sizes) == 10 and set(sizes) == {n for _, n, _ in synthetic.STRATA[cell]}
    assert cell != "nba" or sum(sizes) == 8 * 180 + 2 * 200
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, synthetic.streams(spark, cell, 10).repartition(3).collect()))
    assert made.columns == list(common.ENVELOPE)


def test_event_logs(spark, tmp_path):
    made = synthetic.streams(spark, "nba", 3).where("sequence_idx < 4")
    files.write_event_lines(made, f"{tmp_path}/logs")
    back = files.read_event_lines(spark, f"{tmp_path}/logs")
    assert sorted(back.select("game_id", "sequence_idx", "event_type").collect()) == sorted(made.select("game_id", "sequence_idx", "event_type").collect())
    assert sorted({r["game_ord"] for r in back.collect()}) == [0, 1, 2]
    (tmp_path / "logs" / "bad.json").write_text('{"sequence_idx": 1}\n')
    assert files.read_event_lines(spark, f"{tmp_path}/logs", strict=False).count() == 12
    with pytest.raises(Exception, match="not an event log"):
        files.read_event_lines(spark, f"{tmp_path}/logs").collect()
    files.write_events(made, f"{tmp_path}/table")
    files.write_events(made.where("false"), f"{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").count() == 12


def test_archives(spark, tmp_path):
    lines = [{"custom_id": f"{i:06d}__c__baseline", "type": "succeeded" if i else "errored", "text": "yes", "usage": {"input_tokens": 5, "output_tokens": 1}} for i in range(3)]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert files.read_responses(spark, f"{tmp_path}/r.jsonl").count() == 2
    every = files.read_responses(spark, f"{tmp_path}/r.jsonl", succeeded=False).withColumn("label", F.lit("a"))
    assert tuple(files.archive_manifest(every).first()) == ("a", 3, 2, 15, 3)
    requests = spark.range(7).withColumn("cell", F.lit("x"))
    assert sorted(r["batch"] for r in files.request_batches(requests, ["id"], 3).collect()) == [0, 0, 0, 1, 1, 1, 2]
    log = spark.createDataFrame([("nba", 1, "at msgbatch_aa ok"), ("nba", 2, "msgbatch_aa"), ("nba", 3, "msgbatch_bb"), ("nba", 4, "none")], "cell string, place int, value string")
    assert {(r["arm"], r["batch"]) for r in files.batch_ids(log, F.col("cell")).collect()} == {("clean", "msgbatch_aa"), ("adversarial", "msgbatch_bb")}
    vectors = spark.createDataFrame([("a", [True] * 12, [False] * 12), ("b", [True], [True])], "cell string, baseline array<boolean>, intervention array<boolean>")
    assert files.paired_vectors(vectors).count() == 12
    ids = spark.createDataFrame([("AB-c", 0), ("d", 1)], "match_id string, place int")
    assert {r["match_id"] for r in files.merged_ids(ids, spark.createDataFrame([("abc", 0), ("e", 1)], "match_id string, place int")).collect()} == {"abc", "d", "e"}
    assert json.loads(files.report_json(requests).first()[0])[0]["cell"] == "x" and files.report_markdown(requests.limit(1)).count("|") == 9
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.json").write_text('{"match_id": "m"}')
    (tmp_path / "raw" / "b.json").write_text("{broken")
    assert [r["match_id"] for r in files.read_records(spark, f"{tmp_path}/raw", builder.RECORD).collect()] == ["m"]
    with pytest.raises(Exception, match="bad event"):
        files.checked(spark.createDataFrame([("chess", 0, "g")], "cell string, sequence_idx long, game_id string")).collect()
