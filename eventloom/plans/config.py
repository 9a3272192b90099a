"""Settings of cells and tests from YAML files, with defaults for what they don't say."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from eventloom.functions import vocabulary as V

#: Keys under which a cell's wanted number of records may stand, the first that is set counts.
TARGETS = ("sample_target_matches", "sample_target_games", "sample_target_replays", "sample_target_maps")
TARGET = 200


@dataclass(frozen=True)
class Cell:
    name: str
    display_name: str
    sample_target: int = TARGET
    data_source: str = "unknown"
    start: str = "2024-01-01"
    end: str = "2024-12-31"
    credentials: tuple[str, ...] = ()
    mock_fallback: bool = True
    stratification: tuple[str, ...] = ()


@dataclass(frozen=True)
class Tests:
    alpha: float = V.ALPHA
    bonferroni_divisor: int = V.BONFERRONI
    continuity_correction: bool = True
    two_sided: bool = True
    min_discordant_pairs: int = V.MIN_DISCORDANT
    bootstrap_iterations: int = 10_000
    bootstrap_seed: int = 42
    confidence_level: float = 0.95
    gate2_retention_floor: float = V.GATE_FLOOR
    chain_length: dict[str, int] = field(default_factory=lambda: dict(V.CHAIN_LENGTH))


# The records that a full run wants of each cell, and the names of its credentials.
DEFAULTS = {
    "pubg": (25, ("PUBG_API_KEY",)), "nba": (300, ()), "csgo": (150, ("FACEIT_API_KEY",)), "rocket_league": (250, ("BALLCHASING_TOKEN",)), "poker": (3_500, ()),
    "fortnite": (200, ("EPIC_ACCOUNT_ID", "EPIC_ACCESS_TOKEN")),
}


def _yaml(path: str | Path | None) -> dict[str, Any] | None:
    """The file's content; None without a file or without a YAML library."""
    if path is None or not Path(path).exists():
        return None
    try:
        import yaml
    except ImportError:
        return None
    return yaml.safe_load(Path(path).read_text()) or {}


def cells(path: str | Path | None = None) -> dict[str, Cell]:
    found = _yaml(path)
    if found is None:
        return {name: Cell(name, name, target, credentials=needed) for name, (target, needed) in DEFAULTS.items()}
    made = {}
    for name, given in (found.get("cells") or {}).items():
        times = given.get("time_range") or {}
        made[name] = Cell(
            name, given.get("display_name", name), next((given[k] for k in TARGETS if given.get(k)), TARGET), given.get("data_source", "unknown"), times.get("start", Cell.start), times.get("end", Cell.end),
            tuple(given.get("env_vars") or ()), given.get("mock_fallback", True), tuple(given.get("stratification") or ()),
        )
    return made


def tests(path: str | Path | None = None) -> Tests:
    found = (_yaml(path) or {}).get("harness") or {}
    parts = {**(found.get("mcnemar") or {}), **(found.get("variance") or {})}
    if "retention_floor" in (gate := found.get("gate2") or {}):
        parts["gate2_retention_floor"] = gate["retention_floor"]
    if lengths := (found.get("chain_length") or {}).get("per_cell"):
        parts["chain_length"] = {**V.CHAIN_LENGTH, **{k: v for k, v in lengths.items() if v}}
    known = {f.name for f in fields(Tests)}
    return Tests(**{k: v for k, v in parts.items() if k in known})


def missing_credentials(found: dict[str, Cell], given: dict[str, str]) -> dict[str, list[str]]:
    """Per cell the credentials that aren't given, or are empty."""
    return {name: [k for k in cell.credentials if not given.get(k)] for name, cell in found.items()}
