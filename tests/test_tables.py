"""Quantiles, bucketed event lines and files that many tasks read."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators.quantiles import exact_quantiles
from eventloom.sources import buckets, files, poker


def test_quantiles(spark):
    draw = random.Random(9)
    rows = [(draw.choice(["a", "a", "b", None]), draw.choice([None, draw.randrange(30), draw.randrange(2_000)])) for _ in range(2_000)] + [("c", None), ("d", 5)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(5)
    shares = {"low": 0.025, "median": 0.5, "high": 0.975, "least": 0.0, "most": 1.0}
    found = exact_quantiles(df, ["g"], "v", shares).collect()
    want = df.groupBy("g").agg(*[F.percentile("v", s).alias(n) for n, s in shares.items()]).collect()
    key = lambda r: (str(r["g"]), *[None if r[n] is None else round(r[n], 9) for n in shares])
    assert sorted(map(str, map(key, found))) == sorted(map(str, map(key, want)))
    assert exact_quantiles(df.limit(0), ["g"], "v", shares).count() == 0


EVENT = "game_id string, cell string, sequence_idx long, event_type string, actor string"


def test_buckets(spark, tmp_path):
    rows = [(f"g{g}", "nba", i, "zone_enter", f"actör {i}") for g in range(40) for i in range(5 + 60 * (g == 3))]
    events = spark.createDataFrame(rows, EVENT)
    manifest = buckets.write_bucketed(events, f"{tmp_path}/log", 4_000, 20).collect()
    made = {r["file"] for r in manifest}
    assert 3 < len(made) < 20 and {r["part"] for r in manifest if r["game_id"] == "g3"} == {0, 1, 2, 3}
    for r in manifest:
        data = (tmp_path / "log" / "lines" / r["file"]).read_bytes()[r["offset"] : r["offset"] + r["bytes"]]
        assert data.count(b"\n") == r["lines"] and f'"game_id":"{r["game_id"]}"' in data.decode().split("\n")[0]
    want = {g: [x["line"] for x in files.event_lines(events.where(F.col("game_id") == g)).orderBy("place").collect()] for g in ("g3", "g7")}
    found = buckets.read_games(spark, f"{tmp_path}/log", ["g3", "g7"]).collect()
    assert {g: [r["line"] for r in found if r["game_id"] == g] for g in want} == want
    with pytest.raises(ValueError, match="no such games"):
        buckets.read_games(spark, f"{tmp_path}/log", ["g99"])
    spoiled = tmp_path / "log" / "lines" / next(r["file"] for r in manifest if r["game_id"] == "g7")
    spoiled.write_text(spoiled.read_text().replace("actör 2", "actör 9"))
    (spoiled.parent / f".{spoiled.name}.crc").unlink()
    with pytest.raises(ValueError, match="don't match"):
        buckets.read_games(spark, f"{tmp_path}/log", ["g7"])


def test_buckets_of_nothing(spark, tmp_path):
    assert buckets.write_bucketed(spark.createDataFrame([], EVENT), f"{tmp_path}/log").count() == 0


def test_hands_of_one_file_by_many_tasks(spark, tmp_path):
    hand = "[{0}]\nvariant = 'NT'\nplayers = ['a', 'b{0}']\nactions = [\n  'd dh p1 ????',\n  'p1 f',\n]\nstarting_stacks = [100, {0}]\nblinds_or_straddles = [1, 2]\n"
    (tmp_path / "many.phhs").write_text("\n".join(hand.format(i) if i != 500 else "[500]\nbroken = = 1\n" for i in range(1, 1_001)))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found = poker.read_files(spark, str(tmp_path))
        rows = sorted(found.collect(), key=lambda r: r["place"])
        assert spark.read.option("lineSep", "\n[").text(str(tmp_path / "many.phhs")).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert [r["players"][1] for r in rows] == [f"b{i}" for i in range(1, 1_001) if i != 500] and [r["place"] for r in rows] == list(range(999))
    assert rows[0]["starting_stacks"] == [100.0, 1.0] and len(rows[0]["actions"]) == 2


def test_long_reports_raise(spark):
    assert files.report_markdown(spark.range(3), 3).count("|") == 10
    with pytest.raises(ValueError):
        files.report_markdown(spark.range(4), 3)
