"""The event envelope that all sources give, and order within a game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions.expressions import strip_phase

#: Columns of every source's events; `context` is a JSON object whose fields keep their order.
ENVELOPE = ("game_id", "cell", "sequence_idx", "timestamp", "event_type", "actor", "actor_team", "phase", "context")


def lookup(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    """The table's value for a key; the default, or null, for others."""
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def filled(*columns: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def record_id(prefix: str, named: Column, record: Column) -> Column:
    """`prefix_` and the source's own id, or 16 hex digits of the record if it has none."""
    return F.concat(F.lit(f"{prefix}_"), F.coalesce(filled(named), F.substring(F.md5(F.to_json(record).cast("binary")), 1, 16)))


def enveloped(rows: DataFrame, cell: str, order: list[str] | None = None) -> DataFrame:
    """The envelope from rows with game_id, timestamp, event_type, actor and maybe actor_team, phase, context (a struct).

    With `order`, events are numbered anew by timestamp and then by those columns; else sequence_idx is there already.
    """
    made = rows
    if order is not None:
        place = Window.partitionBy("game_id").orderBy("timestamp", *order)
        made = rows.withColumn("sequence_idx", (F.row_number().over(place) - 1).cast("long"))
    text = lambda name: F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")
    context = F.to_json("context") if "context" in rows.columns else F.lit("{}")
    return made.select(
        "game_id", F.lit(cell).alias("cell"), "sequence_idx", F.col("timestamp").cast("double").alias("timestamp"), strip_phase("event_type").alias("event_type"),
        F.col("actor").cast("string").alias("actor"), text("actor_team").alias("actor_team"), text("phase").alias("phase"), context.alias("context"),
    )


def spread(count: Column) -> Column:
    """One row per number from 1 to count; none for a count of 0, below or null."""
    return F.explode(F.when(count > 0, F.sequence(F.lit(1), count.cast("int"))))
