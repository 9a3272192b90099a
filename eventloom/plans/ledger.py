"""A ledger of requests to a classifier: an append-only table of states from which a run goes on after any failure.

Every request and every response is a row; nothing is changed or deleted. What is open, answered or failed follows from
the rows, so a part that was appended twice, or only in part, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.expressions import custom_id
from eventloom.operators.ordinals import with_ordinals
from eventloom.sources.files import BATCH
from eventloom.storage import stored

VARIANTS = ("baseline", "intervention")
SUCCEEDED, FAILED = "succeeded", ("errored", "expired", "canceled")
ROW = "kind string, cell string, custom_id string, index long, chain_id string, variant string, batch long, prompt string, attempt long, type string, text string"


def requests_of(prompts: DataFrame, order: list[str], size: int = BATCH) -> DataFrame:
    """cell, custom_id, index, chain_id, variant, batch, prompt: two requests for every row of `prompts` (cell, chain_id,
    baseline, intervention).

    index is the row's place in its cell by `order`, so ids differ though chain ids may repeat; a batch holds `size`
    requests of a cell, those of a row one after another. A cell of any size is dealt to many tasks.
    """
    placed = with_ordinals(prompts.select("cell", "chain_id", *[c for c in order if c not in ("cell", "chain_id")], *VARIANTS), ["cell"], order, "index")
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(v).alias("variant"), F.col(v).alias("prompt")) for i, v in enumerate(VARIANTS)]))
    each = placed.select("cell", "chain_id", "index", sides.alias("x")).select("cell", "chain_id", "index", "x.*")
    batch = F.floor((2 * F.col("index") + F.col("no")) / size).cast("long")
    return each.select("cell", custom_id(F.col("index"), F.col("chain_id"), F.col("variant")).alias("custom_id"), "index", "chain_id", "variant", batch.alias("batch"), "prompt")


@dataclass
class Ledger:
    """The ledger in a folder of Parquet files, which all executors see."""

    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROW).parquet(self.path)

    def _append(self, rows: DataFrame) -> None:
        have = set(rows.columns)
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], ROW).schema}
        rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]).write.mode("append").parquet(self.path)


    def register(self, requests: DataFrame) -> None:
        """Adds the requests that the ledger doesn't know, by cell and custom_id."""
        self._append(requests.limit(0).withColumn("kind", F.lit("request")))
        known = self.rows().where("kind = 'request'").select("cell", "custom_id")
        self._append(stored(requests.join(known, ["cell", "custom_id"], "left_anti").withColumn("kind", F.lit("request")), "ledger-new"))

    def requests(self) -> DataFrame:
        """Every request once, also if it was appended twice."""
        one = F.min(F.struct("index", "chain_id", "variant", "batch", "prompt")).alias("x")
        return self.rows().where("kind = 'request'").groupBy("cell", "custom_id").agg(one).select("cell", "custom_id", "x.*")

    def states(self) -> DataFrame:
        """cell, custom_id, attempts, type, text: of the responses so far the first that succeeded, else the last one."""
        told = F.struct((F.col("type") != SUCCEEDED).alias("failed"), F.when(F.col("type") == SUCCEEDED, F.col("attempt")).otherwise(-F.col("attempt")).alias("order"), "type", "text")
        return self.rows().where("kind = 'response'").groupBy("cell", "custom_id").agg(F.max("attempt").alias("attempts"), F.min(told).alias("x")).select("cell", "custom_id", "attempts", "x.type", "x.text")

    def pending(self, attempts: int = 5) -> DataFrame:
        """The requests that didn't succeed and have been tried fewer than `attempts` times, with tried."""
        done = self.states().select("cell", "custom_id", "attempts", "type")
        rows = self.requests().join(done, ["cell", "custom_id"], "left").where(F.coalesce(F.col("type") != SUCCEEDED, F.lit(True)))
        return rows.withColumn("tried", F.coalesce("attempts", F.lit(0))).where(F.col("tried") < attempts).drop("attempts", "type")

    def record(self, asked: DataFrame, responses: DataFrame) -> None:
        """Appends what came back for `asked`, rows of `pending`. `responses`: cell, custom_id, type, text; a request without
        one stays open, a second one for a request of the same attempt is kept but doesn't count, if it comes later in
        order, and ids that weren't asked are left out."""
        tried = asked.select("cell", "custom_id", (F.col("tried") + 1).alias("attempt"))
        self._append(responses.select("cell", "custom_id", "type", F.when(F.col("type") == SUCCEEDED, F.coalesce("text", F.lit(""))).alias("text")).join(tried, ["cell", "custom_id"]).withColumn("kind", F.lit("response")))

    def run(self, answer: Callable[[DataFrame], DataFrame], attempts: int = 5, batches: int = 1_000) -> None:
        """Asks for everything that is open, up to `batches` batches at a time, and again for what failed.

        `answer` gets cell, custom_id, batch, prompt and returns cell, custom_id, type, text. What it returned before it
        raises in a later call is recorded, and the next run asks for the rest.
        """
        for _ in range(attempts):
            asked = stored(self.pending(attempts), "ledger-asked")
            bounds = asked.agg(F.min("batch").alias("low"), F.max("batch").alias("high")).first()
            if bounds["low"] is None:
                return
            for start in range(bounds["low"], bounds["high"] + 1, batches):
                part = asked.where((F.col("batch") >= start) & (F.col("batch") < start + batches))
                self.record(part, stored(answer(part.select("cell", "custom_id", "batch", "prompt")), "ledger-answers"))

    def pairs(self) -> DataFrame:
        """cell, index, chain_id, baseline_raw, intervention_raw, missing: one row per row asked for. An answer that is missing is
        empty, which abstains; missing if neither is there."""
        good = self.states().where(F.col("type") == SUCCEEDED).select("cell", "custom_id", "text")
        rows = self.requests().join(good, ["cell", "custom_id"], "left")
        side = lambda v: F.coalesce(F.max(F.when(F.col("variant") == v, F.col("text"))), F.lit(""))
        return rows.groupBy("cell", "index", "chain_id").agg(side("baseline").alias("baseline_raw"), side("intervention").alias("intervention_raw")).withColumn("missing", (F.col("baseline_raw") == "") & (F.col("intervention_raw") == ""))

    def counts(self) -> DataFrame:
        """Per cell and batch: requests, those that succeeded, that failed, and that have no response."""
        rows = self.requests().join(self.states().select("cell", "custom_id", "type"), ["cell", "custom_id"], "left")
        return rows.groupBy("cell", "batch").agg(
            F.count("*").alias("requests"), F.count_if(F.col("type") == SUCCEEDED).alias("succeeded"),
            F.count_if(F.col("type").isin(*FAILED)).alias("failed"), F.count_if(F.col("type").isNull()).alias("open"),
        )
