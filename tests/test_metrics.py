from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.plans.metrics import Metrics


def test_counts_and_reports(spark, tmp_path):
    rows = spark.range(30).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("cell"), "id")
    run = Metrics(spark)
    kept = run.measured("all", rows)
    run.measured("some", kept.where("id < 10"))
    run.measured("none", kept.where("id < 0"))
    found = {(r["place"], r["stage"], r["cell"]): r["rows"] for r in run.table().collect()}
    assert found == {(0, "all", "c1"): 10, (0, "all", "c2"): 10, (0, "all", None): 10, (1, "some", "c1"): 3, (1, "some", "c2"): 3, (1, "some", None): 4}
    assert all(r["seconds"] > 0 and r["python_mb"] > 1 and r["driver_mb"] > 1 for r in run.table().collect())
    run.write(str(tmp_path / "out"))
    assert spark.read.json(f"{tmp_path}/out/metrics").count() == 6
    told = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/out/report").collect())
    assert "| some | c1 | 3 |" in told and "for 40 rows in 2 stages" in told
