"""What a run did: rows per stage and cell, time and memory, as a table, JSON and Markdown."""

from __future__ import annotations

import resource
import sys
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.storage import stored

SCHEMA = "stage string, place int, cell string, rows long, seconds double, rows_per_second double, python_mb double, driver_mb double"


def own_mb() -> float:
    """The most memory that this process has held."""
    most = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    return most / (1 << 20 if sys.platform == "darwin" else 1 << 10)


def jvm_mb(spark: SparkSession) -> float | None:
    """The JVM heap in use on the driver; none where the session has no JVM of its own."""
    try:
        java = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    except Exception:  # a remote session
        return None
    return (java.totalMemory() - java.freeMemory()) / (1 << 20)


@dataclass
class Metrics:
    """Measures the stages of a run, one after another. `cell` is the column whose values are told apart (null is one)."""

    spark: SparkSession
    cell: str = "cell"
    found: list[tuple] = field(default_factory=list)

    def measured(self, stage: str, df: DataFrame) -> DataFrame:
        """Runs `df`, notes its rows per cell, time and memory, and returns its stored rows. Cells are few: their counts come to
        the driver, whose memory this is."""
        began = time.perf_counter()
        kept = stored(df, "measured")
        seconds = time.perf_counter() - began
        memory = own_mb(), jvm_mb(self.spark)
        for r in kept.groupBy(self.cell).agg(F.count("*").alias("rows")).collect():
            self.found.append((stage, len({x[0] for x in self.found} | {stage}) - 1, r[self.cell], r["rows"], seconds, r["rows"] / seconds, *memory))
        return kept

    def table(self) -> DataFrame:
        """stage, place (of the stage in the run), cell, rows, seconds (of the whole stage), rows_per_second, python_mb, driver_mb. A
        stage without rows has none."""
        return self.spark.createDataFrame(self.found, SCHEMA)

    def markdown(self) -> str:
        """The table and its sums as Markdown."""
        head = "| Stage | Cell | Rows | Seconds | Rows/s | Python MB | JVM MB |\n|-|-|-|-|-|-|-|\n"
        number = lambda x, form: "" if x is None else format(x, form)
        rows = [f"| {s} | {'' if c is None else c} | {n:,} | {t:.3f} | {v:,.0f} | {number(p, '.1f')} | {number(d, '.1f')} |" for s, _, c, n, t, v, p, d in self.found]
        stages = {s: t for s, _, _, _, t, *_ in self.found}
        return head + "\n".join(rows) + f"\n\nTotal: {sum(stages.values()):.2f} s for {sum(r[3] for r in self.found):,} rows in {len(stages)} stages.\n"

    def write(self, path: str) -> None:
        """The table as JSON and the report as text below `path`."""
        self.table().coalesce(1).orderBy("place", "cell").write.mode("overwrite").json(f"{path}/metrics")
        self.spark.createDataFrame([(self.markdown(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
