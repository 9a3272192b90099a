"""Reports over all cells of a run."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from eventloom.__main__ import cost, cost_report
from eventloom.operators import pairing as P
from eventloom.plans import harness as H

TABLE = "cell string, n long, b long, c long, statistic double, p double, p_corrected double, significant boolean, h double, lo double, hi double"


def test_aggregate(spark):
    rows = [("nba", 100, 10, 30, 9.025, 0.0026, 0.0133, True, 0.5, 0.08, 0.32), ("csgo", 50, 3, 2, 0.0, 1.0, 1.0, False, -0.25, -0.1, 0.05)]
    found = P.aggregate(spark.createDataFrame(rows, TABLE)).first()
    assert (found["n_cells"], found["n_cells_significant"], found["total_chains"], found["total_discordant"]) == (2, 1, 150, 45)
    chi = (abs(13 - 32) - 1) ** 2 / 45
    assert math.isclose(found["pooled_chi2"], chi) and math.isclose(found["pooled_p"], math.erfc(math.sqrt(chi / 2)))
    assert [x[:6] for x in found["cell_summaries"]] == ["[csgo]", "[nba] "] and found["cell_summaries"][0].endswith("h=-0.2500 95%CI=[-0.1000,0.0500]")
    none = P.aggregate(spark.createDataFrame([], TABLE)).first()
    assert (none["n_cells"], none["pooled_chi2"], none["pooled_p"], none["cell_summaries"]) == (0, 0.0, 1.0, [])


def test_cells_that_fail(spark):
    events = spark.createDataFrame([(1, "nba", i, "zone_enter", "a") for i in range(3)] + [(2, "csgo", 0, "zone_enter", "a"), (3, None, 0, "x", "a")], "game_id long, cell string, sequence_idx long, event_type string, actor string")

    def good(e):
        return e.withColumns({"parent": F.lit("p"), "slot": F.col("sequence_idx")})

    def late_fault(e):
        return good(e).withColumn("slot", F.when(F.col("slot") >= 0, F.raise_error(F.lit("broken here")).cast("long")))

    made, told = H.run_cells(events, {"nba": good, "csgo": late_fault, "poker": None, "pubg": good})
    rows = {r["cell"]: r for r in told.collect()}
    assert made.count() == 3 and set(rows) == {"nba", "csgo", "poker", "pubg", None}
    assert rows["nba"]["errors"] == [] and (rows["nba"]["n_streams"], rows["nba"]["n_events"], rows["nba"]["n_candidates"]) == (1, 3, 1)
    assert "broken here" in rows["csgo"]["errors"][0] and rows["csgo"]["registered"] and rows["csgo"]["n_candidates"] == 0
    assert rows["poker"]["errors"] == ["no streams", "its cut isn't there yet"] and rows["pubg"]["errors"] == ["no streams"]
    assert rows[None]["errors"] == ["no cut is registered"] and not rows[None]["registered"]


def test_cost_report():
    told = cost_report(1_200, 5)
    assert "Calls:           12,000" in told and f"Cost:            {cost(1_200, 5):.4f} USD" in told and "2,400 calls" in told
