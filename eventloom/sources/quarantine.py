"""Bad records as a second output: kept with their cause and file, and counted in the pass that sorts them out."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import vocabulary as V
from eventloom.storage import session_dir

#: Why a record is in quarantine.
NOT_JSON, EMPTY, NO_GAME, UNKNOWN_CELL, BAD_PLACE = "not JSON", "empty record", "no game id", "unknown cell", "bad place"


@dataclass
class Sorted:
    """good: the columns that came in; rejected: them, cause and file; counts: read, good and one number per cause."""

    good: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def sorted_out(rows: DataFrame, causes: dict[str, Column], file: Column | None = None) -> Sorted:
    """`rows` dealt to good and rejected ones by the first of `causes` that holds (null: it doesn't), in one pass.

    Both are parts of one stored table; the counts are observed while it is written, so they are those of its rows. Columns
    named cause and file are replaced.
    """
    kept = [c for c in rows.columns if c not in ("cause", "file")]
    first = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in causes.items()], F.lit(None).cast("string"))
    marked = rows.select(*kept, first.alias("cause"), (F.lit(None).cast("string") if file is None else file).alias("file")).withColumn("is_bad", F.col("cause").isNotNull())
    seen = Observation()
    numbers = [F.count("*").alias("read"), F.count_if(~F.col("is_bad")).alias("good"), *[F.count_if(F.coalesce(F.col("cause") == n, F.lit(False))).alias(n) for n in causes]]
    path = f"{session_dir(rows.sparkSession)}/sorted-{uuid.uuid4().hex}"
    marked.observe(seen, *numbers).write.partitionBy("is_bad").parquet(path)
    back = rows.sparkSession.read.schema(marked.schema).parquet(path)
    return Sorted(back.where("not is_bad").select(*kept), back.where("is_bad").drop("is_bad"), dict(seen.get))


def read_records(spark: SparkSession, path: str, schema: str, game_id: str | None = None, lines: bool = False) -> Sorted:
    """The JSON records below `path`, one a file or one a line; files that aren't JSON, empty records and, if `game_id` names a
    column, such without one are rejected with the text they had."""
    read = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", str(not lines).lower()).option("recursiveFileLookup", "true").json(path)
    fields = [c for c in read.columns if c != "_corrupt_record"]
    nothing = F.lit(True)
    for c in fields:
        nothing = nothing & F.col(f"`{c}`").isNull()
    causes = {NOT_JSON: F.col("_corrupt_record").isNotNull(), EMPTY: nothing} | ({NO_GAME: F.col(game_id).isNull() | (F.col(game_id) == "")} if game_id else {})
    found = sorted_out(read, causes, F.col("_metadata.file_path"))
    return Sorted(found.good.drop("_corrupt_record"), found.rejected, found.counts)


def checked_events(events: DataFrame, drops: tuple[str, ...] = ("poker",)) -> Sorted:
    """Events with a game, a known cell and a place of 0 or more. A bad event of a cell in `drops` goes to quarantine; one of any
    other cell, or of none, raises, as its whole game is in doubt."""
    causes = {
        NO_GAME: F.col("game_id").isNull(), UNKNOWN_CELL: ~F.coalesce(F.col("cell").isin(*V.CELLS, "fortnite"), F.lit(False)),
        BAD_PLACE: F.coalesce("sequence_idx", F.lit(-1)) < 0,
    }
    bad = causes[NO_GAME] | causes[UNKNOWN_CELL] | causes[BAD_PLACE]
    forgiving = F.coalesce(F.col("cell").isin(*drops), F.lit(False)) if drops else F.lit(False)
    told = F.raise_error(F.concat(F.lit("bad event of game "), F.coalesce(F.col("game_id").cast("string"), F.lit("?")), F.lit(" in cell "), F.coalesce("cell", F.lit("?")))).cast("boolean")
    return sorted_out(events.where(F.when(bad & ~forgiving, told).otherwise(F.lit(True))), causes)
