"""From a cell's landed records, or synthetic streams in their place, to events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from eventloom.plans.config import Cell
from eventloom.sources import builder, carsoccer, files, nba, poker, pubg, shooter, synthetic


@dataclass(frozen=True)
class Source:
    """How a cell's records are read (path to records) and become events; the protocol that new cells follow."""

    read: Callable[[SparkSession, str], DataFrame]
    events: Callable[[DataFrame], DataFrame]


def records(schema: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: files.read_records(spark, path, schema)


SOURCES = {
    "nba": Source(records(nba.RECORD), nba.events), "pubg": Source(records(pubg.RECORD), pubg.events), "csgo": Source(records(shooter.RECORD), shooter.events),
    "rocket_league": Source(records(carsoccer.RECORD), carsoccer.events), "fortnite": Source(records(builder.RECORD), builder.events), "poker": Source(lambda spark, path: poker.hands(poker.read_files(spark, path)), poker.events),
}


def acquired(spark: SparkSession, cell: Cell, path: str | None, credentials: dict[str, str], mock: bool = False, sources: dict[str, Source] = SOURCES) -> DataFrame:
    """The cell's events: synthetic ones if forced, or if a credential is missing and the cell allows it; else the events
    of the records at `path`. Real records without any event give none: nothing synthetic takes their place."""
    missing = [k for k in cell.credentials if not credentials.get(k)]
    if mock or (missing and cell.mock_fallback):
        return synthetic.streams(spark, cell.name, cell.sample_target)
    if missing:
        raise PermissionError(f"{cell.name} needs {', '.join(missing)}")
    if path is None:
        raise ValueError(f"{cell.name} has no records: give their path")
    source = sources[cell.name]
    return source.events(source.read(spark, path))
