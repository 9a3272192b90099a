from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from eventloom.operators import pairing as P
from eventloom.plans import harness as H
from eventloom.plans.queries import synthetic_pilot

SCHEMA = "game_id string, cell string, sequence_idx long, timestamp double, event_type string, actor string, actor_team string, phase string, context string, period long, round long"


def frame(spark, cell, contexts, types=None):
    types = types or ["engage_decision"] * len(contexts)
    rows = [("g", cell, i, 1.5 * i, types[i], f"a{i % 2}", "tm", None, json.dumps(c), 1, None) for i, c in enumerate(contexts)]
    return spark.createDataFrame(rows, SCHEMA)


def lines(spark, cell, *contexts):
    made = frame(spark, cell, contexts).withColumns({"slot": F.col("sequence_idx"), "chain_id": F.lit("c")})
    return H.rendered(made).first()["text"].split("\n")


HEAD = "  0. t=    0.0s | engage_decision        | actor=Player_0     | "


@pytest.mark.parametrize(
    ("cell", "context", "want"),
    [
        ("poker", {"street": "flop", "position": "BB", "action": "f", "bet_size_bb": 0.0, "pot_size_bb": 1.5}, "street=flop, position=BB, action=f, bet_size_bb=0.0, pot_size_bb=1.5, stack_bb=?"),
        ("poker", {"already_folded": True, "street": "turn"}, "NOTE=Player_0_already_folded, street=turn, position=?, action=?, bet_size_bb=?, pot_size_bb=?, stack_bb=?"),
        ("nba", {"terminal_action": "Foul", "time_in_possession_s": 3.5, "actor_foul_count_after": 2, "period": 1, "clock_end": "PT1M", "score_home": "1", "score_away": "2"}, "action=Foul, time_in_possession_s=3.5, actor_total_fouls=2, period=1, clock=PT1M, score=1-2"),
        ("nba", {}, "action=?, period=?, score=?-?"),
        ("csgo", {"team_id": "", "round": 3, "map": "m", "eliminates_player": "a0"}, "ELIMINATES=Player_0, action=?, team=?, round=3, map=m"),
        ("rocket_league", {"goal_marker": True, "duration_s": 300.0, "score_blue": 1}, "GOAL_SCORED, action=?, team=tm, final_score=blue:1–orange:?, match_duration_s=300"),
        ("pubg", {"eliminates_player": "x", "safety_zone_radius": 5.5, "weapon": "gun", "damage": 1.234}, "ELIMINATES=x zone_radius=5.5, weapon=gun, damage=1.23"),
        ("fortnite", {"a": "x" * 40, "b": 1, "c": True, "d": 2.0, "e": 5, "f": 6, "g": 7}, "a=" + "x" * 29 + "..., b=1, c=true, d=2.00, e=5, f=6"),
    ],
)
def test_lines(spark, cell, context, want):
    assert lines(spark, cell, context)[0] == HEAD + want


def test_cuts(spark):
    made = frame(spark, "csgo", [{}] * 25).withColumn("round", F.when(F.col("sequence_idx") < 23, 1).otherwise(-1).cast("long"))
    chains = H.fixed_chains(H.candidates(made, ("csgo",)))
    assert sorted((r["sub_no"], r["count"]) for r in chains.groupBy("sub_no").count().collect()) == [(0, 10), (1, 10)]
    named = made.withColumns({"round": F.lit(None).cast("long"), "phase": F.lit("round_7")})
    assert H.candidates(named, ("csgo",)).count() == 25
    poker = frame(spark, "poker", [{}] * 24)
    assert H.fixed_chains(H.candidates(poker, ("poker",))).count() == 8
    assert H.candidates(frame(spark, "poker", [{}] * 2), ("poker",)).count() == 0
    players = H.candidates(frame(spark, "rocket_league", [{}] * 6), ("rocket_league",), {"rocket_league": H.MORE_CUTS["rocket_league_players"]})
    assert players.select("parent").distinct().count() == 2
    with pytest.raises(NotImplementedError):
        H.candidates(poker, ("poker",), {"poker": H.MORE_CUTS["poker_sessions"]})
    with pytest.raises(ValueError):
        H.fixed_chains(poker, {"poker": 0})


def test_gate_and_controls(spark):
    mixed = frame(spark, "poker", [{}] * 8, ["engage_decision"] * 4 + ["player_idle"] * 4)
    chains = H.fixed_chains(H.candidates(mixed, ("poker",)))
    assert H.passing(chains).count() == 8 and H.passing(chains, 0.51).count() == 0
    moved = H.shuffled(chains).orderBy("slot").collect()
    assert [r["timestamp"] for r in moved] == [1.5 * i for i in range(8)] and sorted(r["sequence_idx"] for r in moved) == list(range(8))
    assert [r["slot"] for r in moved] == list(range(8)) and moved[0]["chain_id"].endswith("_shuf00")
    report = H.pilot(mixed, ("poker",)).first()
    assert (report["n_streams"], report["n_events"], report["n_chains_raw"], report["n_chains_post_gate"], report["length_mean"], report["passed"]) == (1, 8, 1, 1, 8.0, True)
    assert report["event_types"] == {"engage_decision": 4, "player_idle": 4} and len(report["warnings"]) == 1


# Published contingency counts: cell, n, b, c, chi square, corrected p.
PUBLISHED = [("pubg", 1200, 0, 289, 287.0, 1.1e-63), ("nba", 1200, 0, 511, 509.0, 5.2e-112), ("csgo", 1199, 0, 395, 393.0, 9.2e-87), ("rocket_league", 1200, 0, 71, 69.0, 4.9e-16), ("poker", 1200, 1, 0, 0.0, 1.0)]


def test_published_tests(spark):
    tables = spark.createDataFrame([(cell, n, b, c) for cell, n, b, c, _, _ in PUBLISHED], "cell string, n long, b long, c long")
    rows = {r["cell"]: r for r in H.resampled(P.corrected(P.with_p(tables.withColumn("statistic", P.statistic())))).collect()}
    for cell, n, b, c, chi, p in PUBLISHED:
        assert round(rows[cell]["statistic"], 0) == chi and rows[cell]["p_corrected"] == pytest.approx(p, rel=0.06)
        assert rows[cell]["lo"] <= (c - b) / n <= rows[cell]["hi"] and rows[cell]["significant"] == (cell != "poker")
    # Published bounds in points: +21.75 to +26.58 for a difference of 24.08.
    assert rows["pubg"]["lo"] == pytest.approx(0.2175, abs=0.003) and rows["pubg"]["hi"] == pytest.approx(0.2658, abs=0.003)


def test_scores(spark):
    raw = spark.createDataFrame([("YES", "no."), ("unknown", "maybe"), ("", "Yes")], "baseline_raw string, intervention_raw string")
    rows = H.scored(raw, F.lit("yes")).withColumn("label", H.score_label(F.col("baseline_ok"))).collect()
    assert [(r["baseline_ok"], r["intervention_ok"], r["label"]) for r in rows] == [(True, False, 1), (None, None, -1), (None, True, -1)]
    lights = H.readiness(spark.createDataFrame([("a", True, True), ("b", False, True), ("c", False, False)], "cell string, has_access boolean, has_synthetic boolean"))
    assert [r["light"] for r in lights.orderBy("cell").collect()] == ["green", "yellow", "red"]


def test_synthetic_pilot(spark):
    """The published sizes of a pilot over as many games."""
    rows = {r["cell"]: (r["n_streams"], r["n_events"], r["n_chains"]) for r in synthetic_pilot(spark, "").collect()}
    assert rows == {"fortnite": (200, 24_000, 8_000), "nba": (300, 55_200, 18_420), "csgo": (150, 45_000, 15_000), "rocket_league": (250, 50_000, 16_750)}


def test_lines_name_actors_in_one_pass(spark, monkeypatch):
    """Actors are named without a join of the members with themselves, in the order of their first events."""
    rows = [("poker", 1, "c", i, float(i), "zone_enter", a, None, "{}") for i, a in enumerate("bab")]
    members = spark.createDataFrame(rows, "cell string, game_id long, chain_id string, slot long, timestamp double, event_type string, actor string, actor_team string, context string")
    held, plans = H.stored, []
    monkeypatch.setattr(H, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), held(df, name))[1])
    text = H.rendered(members).first()["text"].split("\n")
    assert [line.split("actor=")[1].split()[0] for line in text] == ["Player_0", "Player_1", "Player_0"]
    assert plans and "Join" not in plans[0]
