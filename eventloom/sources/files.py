"""Event logs, raw records, responses and reports as files.

An event log has a header line (game_id, cell, metadata, _type "header") and then one event per line.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions import vocabulary as V
from eventloom.functions.expressions import strip_phase
from eventloom.operators.ordinals import with_ordinals
from eventloom.sources import quarantine

LINE = (
    "_type string, game_id string, cell string, metadata map<string,string>, sequence_idx long, timestamp double, event_type string, actor string, "
    "actor_team string, phase string, location_context string, raw_data_blob string"
)
RESPONSE = (
    "custom_id string, type string, text string, usage struct<input_tokens:long,output_tokens:long,cache_creation_input_tokens:long,cache_read_input_tokens:long>, error string"
)
#: Requests of one batch.
BATCH = 50_000


def write_events(events: DataFrame, path: str) -> None:
    """Parquet by cell; replaces only the cells that `events` holds, and nothing at all if it is empty."""
    if not events.isEmpty():
        events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(path)


def event_lines(events: DataFrame) -> DataFrame:
    """game_id, line: a header and the events of each game as JSON, in order of (game_id, place)."""
    header = events.groupBy("game_id", "cell").agg(F.count("*").alias("_n")).select(
        "game_id", F.lit(-1).cast("long").alias("place"), F.to_json(F.struct("game_id", "cell", F.create_map().cast("map<string,string>").alias("metadata"), F.lit("header").alias("_type"))).alias("line")
    )
    lines = events.select("game_id", F.col("sequence_idx").alias("place"), F.to_json(F.struct(*[c for c in events.columns])).alias("line"))
    return header.unionByName(lines)


def write_event_lines(events: DataFrame, path: str) -> None:
    """JSON lines, one folder per game, its header first."""
    lines = event_lines(events)
    per_game = lines.repartition("game_id").sortWithinPartitions("game_id", "place").select(F.col("game_id").alias("game"), "line")
    per_game.write.mode("overwrite").partitionBy("game").text(path)


def read_event_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The events of all logs below `path`, with game_ord, the place of their file in path order.

    Every file must start with a header of a known cell. A file without one, with lines that aren't JSON or with a
    negative sequence_idx raises, or is left out if not `strict`. Unknown fields are dropped.
    """
    read = spark.read.schema(f"{LINE}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", "true").json(path)
    rows = read.withColumn("_file", F.col("_metadata.file_path"))
    is_header = F.col("_type") == "header"
    bad = F.col("_corrupt_record").isNotNull() | (~F.coalesce(is_header, F.lit(False)) & (F.coalesce("sequence_idx", F.lit(-1)) < 0))
    files = rows.groupBy("_file").agg(
        F.count_if(is_header).alias("headers"), F.count_if(bad).alias("bad"), F.max(F.when(is_header, F.col("game_id"))).alias("_game"), F.max(F.when(is_header, F.col("cell"))).alias("_cell")
    )
    known = [*V.CELLS, "fortnite"]
    good = (F.col("headers") == 1) & (F.col("bad") == 0) & F.coalesce(F.col("_cell").isin(*known), F.lit(False))
    if strict:
        files = files.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not an event log: "), F.col("_file"))).cast("boolean")))
    # One row per file.
    named = files.where(good).withColumn("game_ord", F.dense_rank().over(Window.orderBy("_file")) - 1).select("_file", "_game", "_cell", "game_ord")
    events = rows.where(~F.coalesce(is_header, F.lit(False))).join(named, "_file")
    return events.select(
        F.coalesce("game_id", "_game").alias("game_id"), F.coalesce("cell", "_cell").alias("cell"), F.col("game_ord").cast("long").alias("game_ord"), "sequence_idx", "timestamp",
        strip_phase("event_type").alias("event_type"), "actor", "actor_team", "phase", F.col("location_context").alias("context"),
    )


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One raw JSON record per file; others are left out with a warning that counts them. `quarantine.read_records` also
    gives them with their cause and file."""
    found = quarantine.read_records(spark, path, schema)
    if found.counts["read"] > found.counts["good"]:
        warnings.warn(f"{found.counts['read'] - found.counts['good']} of {found.counts['read']} records below {path} are bad", stacklevel=2)
    return found.good


def checked(events: DataFrame) -> DataFrame:
    """Events of known cells with a place of 0 or more; others raise."""
    known = F.col("cell").isin(*V.CELLS, "fortnite") & (F.col("sequence_idx") >= 0)
    return events.where(F.when(F.coalesce(known, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad event of game "), F.coalesce("game_id", F.lit("?")))).cast("boolean")))


def merged_ids(first: DataFrame, more: DataFrame, id: str = "match_id") -> DataFrame:
    """The ids of both lists (id, place), in lower case and without hyphens, each once, at its first place."""
    name = F.lower(F.regexp_replace(id, "-", ""))
    both = first.select(name.alias(id), F.lit(0).alias("_list"), "place").unionByName(more.select(name.alias(id), F.lit(1).alias("_list"), "place"))
    return both.groupBy(id).agg(F.min(F.struct("_list", "place")).alias("at")).select(id, F.col("at._list").alias("list"), F.col("at.place").alias("place"))


# --- requests and responses -------------------------------------------------------------------------------------
def request_batches(requests: DataFrame, order: list[str], size: int = BATCH) -> DataFrame:
    """Adds batch: chunks of at most `size` requests, in order, per cell."""
    return with_ordinals(requests, ["cell"], order, "batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def read_responses(spark: SparkSession, path: str, succeeded: bool = True) -> DataFrame:
    """The archive's JSON lines; by default only responses that succeeded."""
    rows = spark.read.schema(RESPONSE).json(path)
    return rows.where("type = 'succeeded'") if succeeded else rows


def archive_manifest(responses: DataFrame, label: str = "label") -> DataFrame:
    """Records and tokens per label."""
    return responses.groupBy(label).agg(
        F.count("*").alias("records"), F.count_if(F.col("type") == "succeeded").alias("succeeded"),
        F.coalesce(F.sum("usage.input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("usage.output_tokens"), F.lit(0)).alias("output_tokens"),
    )


def batch_ids(lines: DataFrame, by: Column, pattern: str = r"(msgbatch_\w+)") -> DataFrame:
    """The batches that log lines (value, place) name: the first per group is the clean arm, the second the adversarial."""
    found = lines.select(by.alias("cell"), "place", F.regexp_extract("value", pattern, 1).alias("batch")).where("batch <> ''")
    first = found.groupBy("cell", "batch").agg(F.min("place").alias("place"))
    row = F.row_number().over(Window.partitionBy("cell").orderBy("place"))
    return first.withColumn("_row", row).where("_row <= 2").select("cell", F.when(F.col("_row") == 1, "clean").otherwise("adversarial").alias("arm"), "batch")


def paired_vectors(records: DataFrame, least: int = 10) -> DataFrame:
    """cell, place, baseline, intervention from (cell, baseline array, intervention array); short cells are left out."""
    zipped = records.where(F.least(F.size("baseline"), F.size("intervention")) >= least).select("cell", F.posexplode(F.arrays_zip("baseline", "intervention")).alias("place", "x"))
    return zipped.select("cell", "place", "x.baseline", "x.intervention").where("baseline is not null and intervention is not null")


def report_json(tables: DataFrame, name: str = "report") -> DataFrame:
    """One JSON document of a small result table: its rows as an array, in the order of their text."""
    return tables.select(F.to_json(F.struct(*tables.columns)).alias("_row")).agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("_row")), ","), F.lit("]")).alias(name))


def report_markdown(table: DataFrame, most: int = 1_000) -> str:
    """A small result table as Markdown; the driver gets its rows, so it is for per-cell reports only, and more than `most` rows
    raise."""
    found = table.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    rows = [[("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)) for v in r] for r in found]
    return "\n".join("| " + " | ".join(r) + " |" for r in [table.columns, ["-"] * len(table.columns), *rows]) + "\n"
