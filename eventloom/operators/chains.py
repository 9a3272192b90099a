"""Chains in long form (cell, chain_id, slot, event columns): gate, caps, samples, shuffled controls, anonymous actors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions import vocabulary as V
from eventloom.functions.decimals import fixed
from eventloom.functions.expressions import hash_number, is_actionable
from eventloom.operators.ordinals import with_ordinals


def gated(members: DataFrame, keys: list[str], floor: float = V.GATE_FLOOR) -> DataFrame:
    """One row per chain: n, n_actionable, fraction, passed (the actionable share reaches the floor; none for no events)."""
    flag = is_actionable(F.col("event_type"), F.col("cell"))
    per = members.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(flag).alias("n_actionable"))
    return per.withColumn("fraction", F.col("n_actionable") / F.col("n")).withColumn("passed", F.col("fraction") >= floor)


def retention(gated_chains: DataFrame, by: str = "cell", floor: float = V.GATE_FLOOR) -> DataFrame:
    """Per cell: n_total, n_passed, retention_rate, gate_pass."""
    per = gated_chains.groupBy(by).agg(F.count("*").alias("n_total"), F.count_if("passed").alias("n_passed"))
    rate = F.coalesce(F.try_divide("n_passed", "n_total"), F.lit(0.0))
    return per.select(by, "n_total", "n_passed", rate.alias("retention_rate"), (rate >= floor).alias("gate_pass"))


def capped(chains: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """The first `most` chains of each cell."""
    return chains.withColumn("_row", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_row") <= most).drop("_row")


def evenly(chains: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """`most` chains per cell at even distances: places int(i * n / most); all, if there are no more or most <= 0."""
    if most <= 0:
        return chains
    placed = with_ordinals(chains, [by], order, "_at", "_n")
    # A place is taken if the first i with int(i * n / most) >= place hits it.
    i = F.ceil(F.col("_at") * most / F.col("_n"))
    taken = (F.col("_n") <= most) | (F.floor(i * F.col("_n") / most) == F.col("_at")) & (i < most)
    return placed.where(taken).drop("_at", "_n")


def stratified(rows: DataFrame, stratum: str, order: list[str], each: int, most: int) -> DataFrame:
    """The first `each` of every stratum, and of these the first `most` in order."""
    some = with_ordinals(rows, [stratum], order, "_at").where(F.col("_at") < each).drop("_at")
    return some.orderBy(*order).limit(most)


def first_share(rows: DataFrame, by: str, order: list[str], share: float) -> DataFrame:
    """The first int(n * share) rows of each cell, but at least one."""
    placed = with_ordinals(rows, [by], order, "_at", "_n")
    return placed.where(F.col("_at") < F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_at", "_n")


def shuffled(members: DataFrame, chain: str = "chain_id", seed: int = 42, copies: int = 1) -> DataFrame:
    """Control chains: each chain's events in a keyed pseudo-random order, while every slot keeps its timestamp.

    Slots and shuffled events meet in an equi-join on (chain, copy, slot). Adds copy and from_slot.
    """
    made = members.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    key = hash_number(F.concat_ws(":", F.lit(seed), F.col(chain), F.col("copy"), F.col("slot")))
    new = F.row_number().over(Window.partitionBy(chain, "copy").orderBy(key, "slot")) - 1
    return made.withColumn("from_slot", F.col("slot")).withColumn("slot", new.cast("long")).drop("timestamp").join(members.select(chain, "slot", "timestamp"), [chain, "slot"])


def anonymous(members: DataFrame, chain: str = "chain_id") -> DataFrame:
    """Adds player: Player_k by the order in which a chain's actors first appear."""
    first = members.groupBy(chain, "actor").agg(F.min("slot").alias("_first"))
    named = first.withColumn("player", F.concat(F.lit("Player_"), (F.row_number().over(Window.partitionBy(chain).orderBy("_first")) - 1).cast("string"))).drop("_first")
    return members.join(named, [chain, "actor"])


def repeating_actor(members: DataFrame, chain: str = "chain_id") -> DataFrame:
    """chain, actor, first_slot, last_slot of the first actor (by appearance) with several events."""
    per = members.groupBy(chain, "actor").agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count("*").alias("_n")).where("_n > 1")
    best = F.row_number().over(Window.partitionBy(chain).orderBy("first_slot"))
    return per.withColumn("_row", best).where("_row = 1").drop("_row", "_n")


def event_line(player: Column) -> Column:
    """`  3. t= 12.5s | type                   | actor=Player_0     | context`, fields padded but never cut."""
    return F.format_string("%3d. t=%ss | %-22s | actor=%-12s | %s", F.col("slot").cast("int"), F.coalesce(fixed(F.col("timestamp"), 1, 7), F.lit("   null")), F.col("event_type"), player, F.coalesce("context", F.lit("")))


def rendered(members: DataFrame, chain: str = "chain_id") -> DataFrame:
    """chain, cell, text: the chain's event lines in order. Chains are short, so a chain is one row."""
    lines = anonymous(members, chain).withColumn("_line", event_line(F.col("player")))
    per = lines.groupBy(chain, "cell").agg(F.array_sort(F.collect_list(F.struct("slot", "_line"))).alias("_lines"))
    return per.select(chain, "cell", F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n").alias("text"))


def streets_covered(members: DataFrame, street: Column, chain: str = "chain_id") -> DataFrame:
    """chain, streets: the streets of each chain in the order of play, unknown ones behind them as they first appear."""
    rank = F.array_position(F.array(*map(F.lit, V.STREETS)), F.col("_street"))
    first = members.withColumn("_street", street).where("_street <> ''").groupBy(chain, "_street").agg(F.min("slot").alias("_first"))
    ordered = F.array_sort(F.collect_list(F.struct(F.when(rank > 0, rank).otherwise(99).alias("rank"), "_first", "_street")))
    return first.groupBy(chain).agg(ordered.alias("_streets")).select(chain, F.transform("_streets", lambda x: x["_street"]).alias("streets"))


def question_of(kind: str, ignore_times: bool = False) -> Column:
    """The question of a prompt by its cell: whether a chain is consistent, whether an event breaks a rule (diagnostic),
    or which rule and event (citation); a placeholder for cells without a domain."""
    if kind == "citation":
        return F.lit(V.CITATION)
    form = {"consistent": V.QUESTION, "diagnostic": V.DIAGNOSTIC}[kind]
    known = F.create_map(*[F.lit(x) for c, d in V.DOMAIN.items() for x in (c, (V.IGNORE_TIMES if ignore_times else "") + form % d)])
    return F.coalesce(known[F.col("cell")], F.lit(V.NO_QUESTION))


def prompts(chains: DataFrame, kind: str = "consistent", ignore_times: bool = False) -> DataFrame:
    """Adds baseline (chain, question) and intervention (rules, chain, question); a placeholder where a cell has no rules."""
    rules = F.create_map(*[F.lit(x) for pair in V.RULES.items() for x in pair])[F.col("cell")]
    told = F.coalesce(rules, F.format_string(V.NO_RULES, F.upper("cell")))
    question = question_of(kind, ignore_times)
    return chains.withColumns({"baseline": F.concat_ws("\n\n", "text", question), "intervention": F.concat_ws("\n\n", told, "text", question)})
