"""Column expressions: identifiers, hash labels, answer parsing, short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions import vocabulary as V


def strip_phase(event_type: str | Column) -> Column:
    """Without one leading `phase_`."""
    return F.regexp_replace(event_type, "^phase_", "")


def is_actionable(event_type: Column, cell: Column) -> Column:
    """Whether a type counts as a decision: of the common ones, or of the cell's own."""
    own = F.lit(False)
    for name, types in V.CELL_ACTIONABLE.items():
        if types:
            own = own | ((cell == name) & event_type.isin(*types))
    return F.coalesce(event_type.isin(*V.ACTIONABLE) | own, F.lit(False))


def chain_id(game: Column, tag: Column) -> Column:
    """16 hex digits from `game__tag`."""
    return F.substring(F.md5(F.concat(game.cast("string"), F.lit("__"), tag).cast("binary")), 1, 16)


def hash_number(text: Column, digits: int = 8) -> Column:
    """The first hex digits of a text's md5 as a number: a keyed, reproducible pseudo-random value."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def team_slot(team: Column) -> Column:
    """team_A or team_B by the lowest bit of the md5's first byte; `?` for none."""
    odd = F.conv(F.substring(F.md5(team.cast("binary")), 1, 2), 16, 10).cast("int") % 2
    return F.when(team.isNull() | (team == ""), "?").when(odd == 0, "team_A").otherwise("team_B")


def dry_label(chain: Column, variant: Column) -> Column:
    """The deterministic stand-in for a classifier: YES for 4 of 10 hashes at baseline, 8 of 10 with rules."""
    h = F.conv(F.substring(F.sha2(F.concat(chain, F.lit("_"), variant).cast("binary"), 256), 1, 2), 16, 10).cast("int") % 10
    return F.when(h < F.when(variant == "baseline", 4).otherwise(8), "YES").otherwise("NO")


def parse_strict(raw: Column, allowed: tuple[str, ...] = ()) -> Column:
    """An answer's normal form, or empty to abstain: blanks and abstaining phrases; a JSON object's answer,
    prediction, response or value; else the first line in lower case without end marks, which must be in `allowed`,
    if given, exactly."""
    s = F.trim(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    value = F.coalesce(*(F.get_json_object(s, f"$.{k}") for k in ("answer", "prediction", "response", "value")))
    wrapped = s.startswith("{") & s.endswith("}") & value.isNotNull()
    first = F.lower(F.regexp_replace(F.trim(F.split(s, r"\r\n|\n|\r").getItem(0)), r"[.!?,]+$", ""))
    plain = F.when(first.isin(*[a.lower() for a in allowed]), first).otherwise("") if allowed else first
    return F.when(raw.isNull() | (s == "") | s.rlike(V.ABSTAIN), "").when(wrapped, F.lower(F.trim(value))).otherwise(plain)


def parse_lenient(raw: Column) -> Column:
    """yes or no if the first line starts so, else null."""
    first = F.lower(F.trim(F.split(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", ""), "\n").getItem(0)))
    return F.when(first.startswith("yes"), "yes").when(first.startswith("no"), "no")


def cited(raw: Column, what: str) -> Column:
    """The rest of a line that starts with `what:`, without regard to case; empty if there is none."""
    return F.regexp_extract(raw, rf"(?im)^\s*{what}:\s*(.+)$", 1)


def custom_id(index: Column, chain: Column, variant: Column) -> Column:
    """`000042__chain__variant`."""
    return F.concat(F.when(F.length(index.cast("string")) < 6, F.lpad(index.cast("string"), 6, "0")).otherwise(index.cast("string")), F.lit("__"), chain, F.lit("__"), variant)


def custom_id_parts(custom: Column) -> Column:
    """struct(index, chain, variant): with a six-digit prefix three parts, else all before the last mark is the chain."""
    new = custom.rlike(r"^\d{6}__.*__[^_]+$")
    index = F.when(new, F.regexp_extract(custom, r"^(\d{6})__", 1).cast("long"))
    body = F.when(new, F.regexp_replace(custom, r"^\d{6}__", "")).otherwise(custom)
    return F.struct(index.alias("index"), F.regexp_replace(body, r"__[^_]*$", "").alias("chain"), F.regexp_extract(body, r"__([^_]*)$", 1).alias("variant"))


def short_value(text: Column) -> Column:
    """Over 32 characters: the first 29 and dots."""
    return F.when(F.length(text) > 32, F.concat(F.substring(text, 1, 29), F.lit("..."))).otherwise(text)
