"""Planted rule violations: row-preserving rewrites of chains in long form.

Each takes members (chain_id, slot, event_type, actor, ...) and gives the same rows of those chains that are long enough
and have what the violation needs, rewritten, with chain_id + `_adv` and marker columns; other chains give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from eventloom.functions import vocabulary as V
from eventloom.functions.decimals import rounded
from eventloom.operators.chains import repeating_actor


def chain() -> WindowSpec:
    return Window.partitionBy("chain_id")


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chain_id", F.concat("chain_id", F.lit("_adv")))


def _last(what: str) -> Column:
    return F.max_by(what, "slot").over(chain())


def foul_out(members: DataFrame) -> DataFrame:
    """The last event's actor has 7 fouls by an earlier event of theirs, the second-to-last if there is none (which then
    is theirs), and at the last one."""
    placed = members.withColumns({"_n": F.count("*").over(chain()), "_who": _last("actor"), "_end": F.max("slot").over(chain())})
    early = F.min(F.when((F.col("actor") == F.col("_who")) & (F.col("slot") < F.col("_end")), F.col("slot"))).over(chain())
    at = F.coalesce(early, F.col("_end") - 1)
    hit = placed.where("_n >= 2").withColumn("_at", at)
    marked = F.col("slot") == F.col("_at")
    return _named(
        hit.withColumns(
            {"actor": F.when(marked, F.col("_who")).otherwise(F.col("actor")), "fouls": F.when(marked | (F.col("slot") == F.col("_end")), 7), "terminal": F.when(marked, "Foul")}
        ).drop("_n", "_who", "_end", "_at")
    )


def eliminated_acts(members: DataFrame) -> DataFrame:
    """The first event eliminates the last event's actor; all later events carry that."""
    placed = members.withColumns({"_n": F.count("*").over(chain()), "_who": _last("actor"), "_first": F.min("slot").over(chain())}).where("_n >= 2")
    first = F.col("slot") == F.col("_first")
    return _named(
        placed.withColumns(
            {"event_type": F.when(first, "engage_decision").otherwise(F.col("event_type")), "eliminates": F.when(first, F.col("_who")), "already_out": F.when(~first, F.col("_who"))}
        ).drop("_n", "_who", "_first")
    )


def repeats_after(members: DataFrame, marker: str, event_type: str | None, least: int = 3) -> DataFrame:
    """The first repeating actor is out (folded, eliminated) at their first event; their later events are tagged, and
    of the given type if there is one. Adds `<marker>` (the event that puts them out) and `already_<marker>`."""
    who = repeating_actor(members).select("chain_id", F.col("actor").alias("_who"), "first_slot")
    placed = members.withColumn("_n", F.count("*").over(chain())).where(F.col("_n") >= least).join(who, "chain_id")
    own = F.col("actor") == F.col("_who")
    first, later = own & (F.col("slot") == F.col("first_slot")), own & (F.col("slot") > F.col("first_slot"))
    kind = F.when(later, event_type).otherwise(F.col("event_type")) if event_type else F.col("event_type")
    return _named(placed.withColumns({"event_type": kind, marker: first, f"already_{marker}": later}).drop("_n", "_who", "first_slot"))


def folds_then_acts(members: DataFrame, marked: bool = True, action: str = "action", bet: str = "bet", least: int = 3) -> DataFrame:
    """The first repeating actor folds at their first event, without a bet, and acts later.

    marked: all their later events are decisions and tagged `already_folded`, and those that would be folds or nothing
    are raises, of 5 if they have no bet. Else only their last event is such a raise, and nothing tells that they folded.
    """
    who = repeating_actor(members).select("chain_id", F.col("actor").alias("_who"), "first_slot", "last_slot")
    placed = members.withColumn("_n", F.count("*").over(chain())).where(F.col("_n") >= least).join(who, "chain_id")
    own, slot = F.col("actor") == F.col("_who"), F.col("slot")
    first, later = own & (slot == F.col("first_slot")), own & (slot > F.col("first_slot") if marked else slot == F.col("last_slot"))
    raises = later & (F.coalesce(F.col(action).isin("f", ""), F.lit(True)) if marked else F.lit(True))
    made = {
        "event_type": F.when(first, "disengage_decision").when(later, "engage_decision").otherwise(F.col("event_type")),
        action: F.when(first, "f").when(raises, "cbr").otherwise(F.col(action)),
        bet: F.when(first, 0.0).when(raises, F.coalesce(F.col(bet).cast("double"), F.lit(5.0))).otherwise(F.col(bet).cast("double")),
    }
    return _named(placed.withColumns({**made, **({"already_folded": later} if marked else {})}).drop("_n", "_who", "first_slot", "last_slot"))


def goal_persists(members: DataFrame) -> DataFrame:
    """The event a third into the chain (not the first) is a goal; later ones keep the state before it."""
    placed = members.withColumns({"_n": F.count("*").over(chain()), "_first": F.min("slot").over(chain())}).where("_n >= 3")
    at = F.col("_first") + F.greatest(F.lit(1), F.floor(F.col("_n") / 3))
    goal = F.col("slot") == at
    return _named(placed.withColumns({"event_type": F.when(goal, "objective_capture").otherwise(F.col("event_type")), "goal": goal, "pre_goal_state": F.col("slot") > at}).drop("_n", "_first"))


def overbet(members: DataFrame, stack: str = "stack", bet: str = "bet") -> DataFrame:
    """The first event with a stack over 5 (else the middle one) bets twice the stack and 10."""
    placed = members.withColumns({"_n": F.count("*").over(chain()), "_first": F.min("slot").over(chain())}).where("_n >= 2")
    rich = F.min(F.when(F.col(stack) > 5, F.col("slot"))).over(chain())
    hit = placed.withColumn("_at", F.coalesce(rich, F.col("_first") + F.floor(F.col("_n") / 2)))
    return _named(hit.withColumn(bet, F.when(F.col("slot") == F.col("_at"), rounded(2 * F.col(stack) + 10, 1)).otherwise(F.col(bet))).drop("_n", "_first", "_at"))


def stack_grows(members: DataFrame, stack: str = "stack") -> DataFrame:
    """The first repeating actor's last event has 50 more than their first."""
    who = repeating_actor(members).select("chain_id", F.col("actor").alias("_who"), "first_slot", "last_slot")
    placed = members.withColumn("_n", F.count("*").over(chain())).where("_n >= 3").join(who, "chain_id")
    early = F.max(F.when(F.col("slot") == F.col("first_slot"), F.col(stack))).over(chain())
    return _named(placed.withColumn(stack, F.when(F.col("slot") == F.col("last_slot"), early + 50).otherwise(F.col(stack))).drop("_n", "_who", "first_slot", "last_slot"))


def team_flips(members: DataFrame, team: str = "actor_team") -> DataFrame:
    """The first repeating actor's last event names a flipped team, or an invalid one if they had none."""
    who = repeating_actor(members).select("chain_id", "last_slot")
    placed = members.withColumn("_n", F.count("*").over(chain())).where("_n >= 3").join(who, "chain_id")
    flipped = F.when(F.coalesce(F.col(team), F.lit("")) == "", "team_INVALID").otherwise(F.concat(team, F.lit("_FLIPPED")))
    return _named(placed.withColumn(team, F.when(F.col("slot") == F.col("last_slot"), flipped).otherwise(F.col(team))).drop("_n", "last_slot"))


def impossible_round(members: DataFrame, number: str = "round") -> DataFrame:
    """The last event is in round 99."""
    end = F.max("slot").over(chain())
    return _named(members.withColumn("_end", end).withColumn(number, F.when(F.col("slot") == F.col("_end"), 99).otherwise(F.col(number))).drop("_end"))


def fourth_player(members: DataFrame, team: str = "actor_team") -> DataFrame:
    """The middle event's actor is a new one of the team with the most actors."""
    largest = members.where(F.col(team).isNotNull()).groupBy("chain_id", team).agg(F.countDistinct("actor").alias("_k"), F.min("slot").alias("_s"))
    most = largest.withColumn("_row", F.row_number().over(chain().orderBy(F.desc("_k"), "_s"))).where("_row = 1").select("chain_id", F.col(team).alias("_team"))
    placed = members.withColumns({"_n": F.count("*").over(chain()), "_first": F.min("slot").over(chain())}).where("_n >= 4").join(most, "chain_id")
    hit = F.col("slot") == F.col("_first") + F.floor(F.col("_n") / 2)
    return _named(placed.withColumns({"actor": F.when(hit, F.concat(F.lit("extra_"), F.col("_team"))).otherwise(F.col("actor")), team: F.when(hit, F.col("_team")).otherwise(F.col(team))}).drop("_n", "_first", "_team"))


def demolished_acts(members: DataFrame) -> DataFrame:
    """The second-to-last event demolishes the last one's actor."""
    placed = members.withColumns({"_n": F.count("*").over(chain()), "_who": _last("actor"), "_end": F.max("slot").over(chain())}).where("_n >= 2")
    return _named(placed.withColumn("demolishes", F.when(F.col("slot") == F.col("_end") - 1, F.col("_who"))).drop("_n", "_who", "_end"))


#: The violation that each cell is tested with.
INJECTORS = {
    "nba": foul_out, "pubg": eliminated_acts, "rocket_league": goal_persists,
    "poker": lambda members: folds_then_acts(members) if "action" in members.columns else repeats_after(members, "folded", "engage_decision"), "csgo": lambda members: repeats_after(members, "eliminated", None),
}


def violation_clauses(members: DataFrame) -> DataFrame:
    """cell, clauses (sorted array), n_chains: the rules that the planted violations of each cell break."""
    made = None
    for cell in INJECTORS:
        one = injected(members, cell).select("cell", "chain_id", F.lit(V.CLAUSES[cell]).alias("clause"))
        made = one if made is None else made.unionByName(one)
    return made.groupBy("cell").agg(F.sort_array(F.collect_set("clause")).alias("clauses"), F.count_distinct("chain_id").alias("n_chains"))


def injected(members: DataFrame, cell: str) -> DataFrame | None:
    """The cell's violation; None for an unknown cell."""
    made = INJECTORS.get(cell)
    return made(members.where(F.col("cell") == cell)) if made else None
