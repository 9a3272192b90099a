"""Lists by place, chains of streams, planted folds, bounds, settings, acquisition and commands."""

from __future__ import annotations

import math

import numpy as np
import pytest
from comparing import SF_DIR
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from eventloom import __main__ as command
from eventloom import storage
from eventloom.functions import vocabulary as V
from eventloom.operators import chains as C
from eventloom.operators import inject as I
from eventloom.operators import pairing as P
from eventloom.operators import windows as W
from eventloom.plans import config
from eventloom.plans import harness as H
from eventloom.plans.record_queries import QUERIES
from eventloom.sources import acquire, synthetic


def lists(spark, ids=("a", "b", "c"), truths=3, baseline=("a", "b", "c"), intervention=("a", "b", "c")):
    chain = spark.createDataFrame([("nba", i, x) for i, x in enumerate(ids)], "cell string, place long, chain_id string")
    truth = spark.createDataFrame([("nba", i, "yes") for i in range(truths)], "cell string, place long, text string")
    told = lambda names: spark.createDataFrame([("nba", i, x, f"{x}!") for i, x in enumerate(names)], "cell string, place long, chain_id string, text string")
    return P.positional(chain, truth, told(baseline), told(intervention))


def test_lists_by_place(spark):
    assert sorted((r["place"], r["chain_id"], r["truth"], r["baseline_raw"]) for r in lists(spark).collect()) == [(0, "a", "yes", "a!"), (1, "b", "yes", "b!"), (2, "c", "yes", "c!")]
    for wrong in ({"truths": 2}, {"baseline": ("a", "b")}, {"intervention": ("a", "b", "c", "d")}, {"ids": ("a", "b")}):
        with pytest.raises(PySparkException, match="different length"):
            lists(spark, **wrong).collect()
    with pytest.raises(PySparkException, match="another chain"):
        lists(spark, intervention=("b", "a", "c")).collect()


def test_chains_of_streams(spark):
    events = spark.createDataFrame([("g", i) for i in range(23)] + [("short", i) for i in range(4)], "game_id string, sequence_idx long")
    made = W.stream_chains(events, 5).collect()
    assert sorted({r["chain_id"] for r in made}) == [f"g_chain_{i:04d}" for i in range(4)] and len(made) == 20
    over = W.stream_chains(events, 5, overlap=True).collect()
    assert len({r["chain_no"] for r in over}) == 19 and len(over) == 95 and all(r["sequence_idx"] == r["chain_no"] + r["slot"] for r in over)
    with pytest.raises(ValueError):
        W.stream_chains(events, 0)


def test_folds(spark):
    rows = [("c", 0, "x", "a", "cc", 2.0), ("c", 1, "x", "b", "f", 1.0), ("c", 2, "x", "a", None, None), ("c", 3, "x", "a", "cc", None), ("two", 0, "x", "a", "f", 0.0), ("two", 1, "x", "a", "f", 0.0)]
    members = spark.createDataFrame(rows, "chain_id string, slot long, event_type string, actor string, action string, bet double")
    marked = I.folds_then_acts(members).orderBy("slot").collect()
    assert [(r["event_type"], r["action"], r["bet"], r["already_folded"]) for r in marked] == [("disengage_decision", "f", 0.0, False), ("x", "f", 1.0, False), ("engage_decision", "cbr", 5.0, True), ("engage_decision", "cc", None, True)]
    silent = I.folds_then_acts(members, marked=False).orderBy("slot").collect()
    assert [(r["event_type"], r["action"], r["bet"]) for r in silent] == [("disengage_decision", "f", 0.0), ("x", "f", 1.0), ("x", None, None), ("engage_decision", "cbr", 5.0)]
    assert "already_folded" not in silent[0].asDict()


def member_rows(spark, cell="csgo", n=5):
    rows = [("c", cell, i, "x", f"a{i % 2}", f"t{i % 2}", i, float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "chain_id string, cell string, slot long, event_type string, actor string, actor_team string, round long, stack double")


def test_other_violations(spark):
    flipped = I.team_flips(member_rows(spark)).orderBy("slot").collect()
    assert [r["actor_team"] for r in flipped] == ["t0", "t1", "t0", "t1", "t0_FLIPPED"]
    fourth = I.fourth_player(member_rows(spark)).orderBy("slot").collect()
    assert fourth[2]["actor"] == "extra_t0" and fourth[2]["actor_team"] == "t0"
    out = I.injected(member_rows(spark), "csgo").orderBy("slot").collect()
    assert [r["already_eliminated"] for r in out] == [False, False, True, False, True] and {r["event_type"] for r in out} == {"x"}
    grown = I.stack_grows(member_rows(spark)).orderBy("slot").collect()
    assert grown[4]["stack"] == 50.0 and I.impossible_round(member_rows(spark)).where("slot = 4").first()["round"] == 99
    assert I.injected(member_rows(spark), "chess") is None
    clauses = {r["cell"]: r["clauses"] for r in I.violation_clauses(member_rows(spark)).collect()}
    assert clauses == {"csgo": [V.CLAUSES["csgo"]]}


def test_questions(spark):
    texts = spark.createDataFrame([("nba", "lines"), ("chess", "lines")], "cell string, text string")
    made = {r["cell"]: r for r in C.prompts(texts, "diagnostic", ignore_times=True).collect()}
    assert made["nba"]["baseline"] == "lines\n\n" + V.IGNORE_TIMES + V.DIAGNOSTIC % "NBA basketball"
    assert made["chess"]["baseline"].endswith(V.NO_QUESTION) and made["chess"]["intervention"].startswith("[CONSTRAINT CONTEXT FOR CHESS")
    assert C.prompts(texts, "citation").first()["baseline"].endswith("EVENTS: <comma-separated event numbers>")


def test_proportion_bounds(spark):
    tables = spark.createDataFrame([("none", 0, 0), ("some", 200, 130), ("all", 50, 50)], "cell string, n long, k long")
    got = {r["cell"]: (r["lo"], r["hi"]) for r in H.proportion_bounds(tables).collect()}
    values = np.r_[np.ones(130), np.zeros(70)]
    rng = np.random.default_rng(3)
    drawn = [rng.choice(values, 200).mean() for _ in range(10_000)]
    assert got["none"] == (0.0, 0.0) and got["all"] == (1.0, 1.0)
    assert got["some"] == pytest.approx(tuple(np.quantile(drawn, [0.025, 0.975])), abs=0.0101)
    assert {r["cell"] for r in QUERIES["proportion_interval"](spark, SF_DIR).collect()}


def test_summary_line(spark):
    row = spark.createDataFrame([("nba", 100, 10, 30, 9.025, 0.00266, 0.0133, True, 0.5, 0.08, 0.32)], "cell string, n long, b long, c long, statistic double, p double, p_corrected double, significant boolean, h double, lo double, hi double")
    assert row.select(P.summary().alias("x")).first()["x"] == "[nba] McNemar n=100 b=10 c=30 χ²=9.0250 p=0.0027 p_corr=0.0133 (SIGNIFICANT) h=0.5000 95%CI=[0.0800,0.3200]"


def test_settings(tmp_path):
    assert config.cells()["poker"].sample_target == 3_500 and config.cells(tmp_path / "none.yaml").keys() == config.DEFAULTS.keys()
    assert config.tests().bootstrap_iterations == 10_000 and config.tests().chain_length["nba"] == 5
    assert config.missing_credentials(config.cells(), {"PUBG_API_KEY": "x", "FACEIT_API_KEY": ""}) == {"pubg": [], "nba": [], "csgo": ["FACEIT_API_KEY"], "rocket_league": ["BALLCHASING_TOKEN"], "poker": [], "fortnite": ["EPIC_ACCOUNT_ID", "EPIC_ACCESS_TOKEN"]}


def test_settings_from_files(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("cells:\n  nba:\n    sample_target_games: 7\n    env_vars: [A]\n  new: {}\n")
    (tmp_path / "h.yaml").write_text("harness:\n  mcnemar: {alpha: 0.01}\n  variance: {bootstrap_iterations: 9}\n  gate2: {retention_floor: 0.4}\n")
    found = config.cells(tmp_path / "c.yaml")
    assert (found["nba"].sample_target, found["nba"].credentials, found["new"].sample_target) == (7, ("A",), 200)
    tests = config.tests(tmp_path / "h.yaml")
    assert (tests.alpha, tests.bootstrap_iterations, tests.gate2_retention_floor, tests.two_sided) == (0.01, 9, 0.4, True)


def test_acquisition(spark):
    cell = config.Cell("poker", "Poker", 3, credentials=("KEY",))
    assert acquire.acquired(spark, cell, None, {}).select("game_id").distinct().count() == 3
    with pytest.raises(PermissionError):
        acquire.acquired(spark, config.Cell("poker", "Poker", 3, credentials=("KEY",), mock_fallback=False), None, {})
    with pytest.raises(ValueError):
        acquire.acquired(spark, cell, None, {"KEY": "x"})
    empty = acquire.Source(lambda spark, path: spark.range(0), lambda records: records)
    assert acquire.acquired(spark, cell, "there", {"KEY": "x"}, sources={"poker": empty}).count() == 0


def test_synthetic_streams(spark):
    made = synthetic.streams_of(spark, {"nba": 3, "csgo": 2})
    again = synthetic.streams(spark, "nba", 3)
    assert sorted(map(tuple, made.where("cell = 'nba'").collect())) == sorted(map(tuple, again.collect()))
    rows = made.orderBy("game_id", "sequence_idx").collect()
    gaps = [b["timestamp"] - a["timestamp"] for a, b in zip(rows, rows[1:], strict=False) if a["game_id"] == b["game_id"]]
    assert 0.49 < min(gaps) and max(gaps) < 10.01 and sum(gaps) / len(gaps) == pytest.approx(5.25, abs=0.5)
    assert '"period":1' in rows[-1]["context"] or any('"period":4' in r["context"] for r in rows if r["cell"] == "nba")
    assert not any('"street"' in r["context"] for r in rows) and any(r["phase"] == "round_3" for r in rows if r["cell"] == "csgo")
    long = synthetic.games_of(spark, {"poker": 1_000_002}).where("_game >= 999999").select(F.col("_game").cast("string")).count()
    assert long == 3


def test_commands(spark, capsys):
    assert command.main(["cost"]) == 0 and "1.95 USD for 12000 calls" in capsys.readouterr().out
    assert command.main(["config", "--cells", "nba", "poker"]) == 0 and "nba: ready" in capsys.readouterr().out
    assert math.isclose(command.cost(1_200, 5), 1.95)


def test_forget(spark):
    kept = storage.stored(spark.range(5), "some")
    assert kept.count() == 5 and kept.inputFiles()[0].startswith(storage.session_dir(spark))
