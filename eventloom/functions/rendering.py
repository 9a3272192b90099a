"""Event lines per cell: from `context`, a JSON object whose fields keep their order, `fields`, its values by name
(`with_fields` reads them once), and `player`, the chain-local name.

Violation markers come first, so that nothing crowds them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.decimals import fixed
from eventloom.functions.expressions import short_value, team_slot

#: Fields of a context that a summary shows, and its length.
FIELDS, SUMMARY = 6, 120
HIDDEN = ("eliminates_player", "already_eliminated_player", "eliminated_at_event", "safety_zone_radius")


def with_fields(events: DataFrame) -> DataFrame:
    return events.withColumn("fields", F.from_json("context", "map<string,string>"))


def field(name: str) -> Column:
    return F.col("fields")[name]


def shown(name: str, missing: str = "?") -> Column:
    """A field's value; the sign for missing ones also stands for empty ones."""
    return F.coalesce(F.when(field(name) != "", field(name)), F.lit(missing))


def truthy(name: str) -> Column:
    return F.coalesce(~field(name).isin("", "false", "0", "null"), F.lit(False))


def part(form: str, value: Column) -> Column:
    """`form` with the value put in; null for a null value."""
    return F.when(value.isNotNull(), F.format_string(form, value))


def joined(between: str, *parts: Column) -> Column:
    return F.concat_ws(between, *[F.when(p != "", p) for p in parts])


def summary(context: str = "context", hidden: tuple[str, ...] = ()) -> Column:
    """The first fields as `k=v`, reals with two places, long texts cut, the whole cut too."""
    keys = F.filter(F.coalesce(F.json_object_keys(context), F.array().cast("array<string>")), lambda k: ~k.isin(*hidden) if hidden else F.lit(True))
    values = F.col("fields")
    real = lambda v: v.rlike(r"^-?\d+\.\d+([eE][-+]?\d+)?$")
    told = lambda v: F.when(real(v), fixed(v.try_cast("double"), 2)).otherwise(short_value(v))
    return F.coalesce(F.substring(F.array_join(F.transform(F.slice(keys, 1, FIELDS), lambda k: F.concat(k, F.lit("="), told(F.coalesce(values[k], F.lit("None"))))), ", "), 1, SUMMARY), F.lit(""))


def markers(player: Column, target: Column) -> Column:
    """What injected violations leave on an event. `target`: the chain-local name of the eliminated player."""
    return joined(
        " ", F.when(truthy("already_folded"), F.concat(F.lit("NOTE="), player, F.lit("_already_folded"))),
        F.when(truthy("already_eliminated_this_round"), F.concat(F.lit("NOTE="), player, F.lit("_eliminated_this_round"))),
        F.when(truthy("pre_goal_state_persisting"), F.lit("NOTE=pre_goal_state_persists_after_goal")),
        F.when(truthy("eliminates_player"), F.concat(F.lit("ELIMINATES="), target)), F.when(truthy("goal_marker"), F.lit("GOAL_SCORED")),
    )


def details(cell: str, player: Column, target: Column, out: Column) -> Column:
    """The last part of a cell's event line. `target` and `out`: chain-local names of the player that the event
    eliminates and of the one that was out already."""
    if cell == "pubg":
        first = joined(
            " ", F.when(truthy("eliminates_player"), F.concat(F.lit("ELIMINATES="), target)), F.when(truthy("already_eliminated_player"), F.concat(F.lit("NOTE="), out, F.lit("_already_eliminated"))),
            part("zone_radius=%s", field("safety_zone_radius")),
        )
        return joined(", ", first, summary(hidden=HIDDEN))
    if cell == "nba":
        spent = F.coalesce(F.when(~field("time_in_possession_s").isin("0", "0.0"), field("time_in_possession_s")), field("possession_elapsed_s"))
        clock = F.coalesce(F.when(field("clock_end") != "", field("clock_end")), F.when(field("clock_start") != "", field("clock_start")))
        score = F.concat_ws("-", F.coalesce(field("score_home"), F.lit("?")), F.coalesce(field("score_away"), F.lit("?")))
        return joined(
            ", ", part("action=%s", shown("terminal_action")), part("time_in_possession_s=%s", spent), part("actor_total_fouls=%s", field("actor_foul_count_after")),
            part("period=%s", F.coalesce(field("period"), F.lit("?"))), part("clock=%s", clock), part("score=%s", score),
        )
    if cell == "csgo":
        told = joined(", ", part("action=%s", shown("action_label")), part("team=%s", team_slot(F.coalesce(field("team_id"), F.lit("")))), part("round=%s", F.coalesce(field("round"), F.lit("?"))), part("map=%s", F.coalesce(field("map"), F.lit("?"))))
        return joined(", ", markers(player, target), told)
    if cell == "rocket_league":
        team = F.coalesce(F.when(field("team_color") != "", field("team_color")), F.when(F.col("actor_team") != "", F.col("actor_team")), F.lit("?"))
        score = F.concat(F.lit("blue:"), F.coalesce(field("score_blue"), F.lit("?")), F.lit("–orange:"), F.coalesce(field("score_orange"), F.lit("?")))
        lasts = part("match_duration_s=%s", fixed(field("duration_s").try_cast("double")))
        return joined(", ", markers(player, target), part("action=%s", shown("action_label")), part("team=%s", team), part("final_score=%s", score), lasts)
    if cell == "poker":
        names = ("street", "position", "action", "bet_size_bb", "pot_size_bb", "stack_bb")
        return joined(", ", markers(player, target), *[part(f"{k}=%s", F.coalesce(field(k), F.lit("?"))) for k in names])
    return summary()


def line(cell: str, target: Column | None = None, out: Column | None = None) -> Column:
    """`  3. t=   12.5s | type                   | actor=Player_0     | details`, fields padded but never cut."""
    none = F.lit("?")
    told = details(cell, F.col("player"), none if target is None else target, none if out is None else out)
    return F.format_string("%3d. t=%ss | %-22s | actor=%-12s | %s", F.col("slot").cast("int"), F.coalesce(fixed(F.col("timestamp"), 1, 7), F.lit("   null")), F.col("event_type"), F.col("player"), told)
