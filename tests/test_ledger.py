"""Runs that break off and go on give the pairs of one whole run."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from eventloom.plans.ledger import Ledger, requests_of


def prompts(spark):
    rows = [(c, f"chain{i % 7}", i, f"b{c}{i}", f"i{c}{i}") for c in ("nba", "csgo") for i in range(25)]
    return spark.createDataFrame(rows, "cell string, chain_id string, n long, baseline string, intervention string")


def echo(part):
    return part.select("cell", "custom_id", F.lit("succeeded").alias("type"), F.concat(F.lit("re "), "prompt").alias("text"))


def pairs(ledger):
    return sorted(tuple(r) for r in ledger.pairs().collect())


@pytest.fixture
def whole(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/whole")
    ledger.register(requests_of(prompts(spark), ["n"], 10))
    ledger.run(echo)
    return pairs(ledger)


def test_requests(spark):
    rows = requests_of(prompts(spark), ["n"], 10).collect()
    assert len(rows) == 100 == len({(r["cell"], r["custom_id"]) for r in rows})
    assert {(r["batch"], sum(x["batch"] == r["batch"] and x["cell"] == "nba" for x in rows)) for r in rows} == {(b, 10) for b in range(5)}
    one = next(r for r in rows if r["prompt"] == "inba8")
    assert (one["custom_id"], one["batch"], one["index"]) == ("000008__chain1__intervention", 1, 8)


def test_interrupted_runs(spark, tmp_path, whole):
    ledger, calls = Ledger(spark, f"{tmp_path}/ledger"), []

    def breaks(part):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("the service is gone")
        return echo(part)

    for _ in range(2):  # registering again adds nothing
        ledger.register(requests_of(prompts(spark), ["n"], 10))
    with pytest.raises(RuntimeError):
        ledger.run(breaks, batches=1)
    counts = {(r["cell"], r["batch"]): (r["requests"], r["succeeded"], r["open"]) for r in ledger.counts().collect()}
    assert counts[("nba", 0)] == (10, 10, 0) and counts[("csgo", 1)] == (10, 10, 0) and counts[("nba", 2)] == (10, 0, 10)
    assert sum(r[5] for r in pairs(ledger)) == 30
    ledger.run(breaks, batches=2)
    assert pairs(ledger) == whole and ledger.pending().count() == 0
    assert ledger.rows().where("kind = 'request'").count() == 100


def test_failures_are_asked_again(spark, tmp_path, whole):
    ledger, seen = Ledger(spark, f"{tmp_path}/ledger"), []
    ledger.register(requests_of(prompts(spark), ["n"], 10))

    def sometimes(part):
        seen.append(part.count())
        odd = F.substring("custom_id", 6, 1).isin("1", "4") if len(seen) < 3 else F.lit(False)
        gone = F.substring("custom_id", 6, 1) == "7" if len(seen) == 1 else F.lit(False)
        return echo(part).where(~gone).withColumn("type", F.when(odd, "errored").otherwise(F.col("type")))

    ledger.run(sometimes)
    assert pairs(ledger) == whole and seen == [100, 32, 24]  # places ending in 1, 4 or 7, then in 1 or 4


def test_later_answers_change_nothing(spark, tmp_path, whole):
    ledger = Ledger(spark, f"{tmp_path}/ledger")
    ledger.register(requests_of(prompts(spark), ["n"], 10))
    asked = ledger.pending()
    ledger.run(echo)
    # A part appended twice, and an answer of a later attempt.
    ledger.record(asked.withColumn("tried", F.lit(4)), echo(asked).withColumn("text", F.lit("other")))
    ledger.register(requests_of(prompts(spark), ["n"], 10))
    assert pairs(ledger) == whole


def test_gives_up_and_empty(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger")
    ledger.register(requests_of(prompts(spark), ["n"], 10))
    ledger.run(lambda part: echo(part).withColumn("type", F.lit("expired")), attempts=2)
    assert ledger.pending(2).count() == 0 and ledger.pending(3).count() == 100
    assert all(r[5] and r[3] == "" for r in pairs(ledger))
    assert {r["failed"] for r in ledger.counts().collect()} == {10}
    none = Ledger(spark, f"{tmp_path}/none")
    none.register(requests_of(prompts(spark).limit(0), ["n"], 10))
    none.run(echo)
    assert none.pairs().count() == 0
