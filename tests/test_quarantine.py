"""Rejected records: all rows that were read are in one of both outputs, with cause and file."""

from __future__ import annotations

import json

import pytest

from eventloom.sources import quarantine as Q


def test_records(spark, tmp_path):
    for name, text in {"a": json.dumps({"id": "g1", "n": 1}), "b": "{broken", "c": "{}", "d": json.dumps({"n": 2}), "e": json.dumps({"id": "g2", "n": None})}.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = Q.read_records(spark, str(tmp_path), "id string, n long", game_id="id")
    assert sorted((r["id"], r["n"]) for r in found.good.collect()) == [("g1", 1), ("g2", None)]
    rejected = {r["file"].rsplit("/", 1)[1]: r["cause"] for r in found.rejected.collect()}
    assert rejected == {"b.json": Q.NOT_JSON, "c.json": Q.EMPTY, "d.json": Q.NO_GAME}
    assert found.counts == {"read": 5, "good": 2, Q.NOT_JSON: 1, Q.EMPTY: 1, Q.NO_GAME: 1}
    assert [r["_corrupt_record"] for r in found.rejected.where("cause = 'not JSON'").collect()] == ["{broken"]


def test_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "g1", "n": 1}\nnope\n{"id": "g2", "n": "two"}\n{"id": "g3", "n": 3}\n')
    found = Q.read_records(spark, str(tmp_path), "id string, n long", lines=True)
    assert found.counts["read"] == 4 and found.good.count() == 2 and found.rejected.count() == 2


EVENTS = "game_id string, cell string, sequence_idx long, cause string"


def test_events_of_a_forgiving_cell(spark):
    rows = [("g", "poker", 0, "mine"), ("g", "poker", -1, None), (None, "poker", 0, None), ("h", "nba", 3, None)]
    found = Q.checked_events(spark.createDataFrame(rows, EVENTS))
    assert {r["game_id"] for r in found.good.collect()} == {"g", "h"} and found.good.count() == 2
    assert {r["cause"] for r in found.rejected.collect()} == {Q.BAD_PLACE, Q.NO_GAME}
    assert found.counts["read"] == 4 == found.good.count() + found.rejected.count()


@pytest.mark.parametrize("row", [("g", "nba", -1, None), ("g", "chess", 0, None), ("g", None, 0, None)])
def test_other_cells_raise(spark, row):
    with pytest.raises(Exception, match="bad event of game g"):
        Q.checked_events(spark.createDataFrame([row], EVENTS))


def test_empty(spark):
    found = Q.checked_events(spark.createDataFrame([], EVENTS))
    assert found.good.count() == 0 and found.rejected.count() == 0 and found.counts["read"] == 0
