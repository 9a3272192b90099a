"""Whole runs: events to candidate chains, fixed-length chains, gate, prompts, answers, paired tests and reports.

Everything is in long form, one row per event of a chain, so that no game or chain meets in one row before its prompt
is written. `parent` names a candidate within its game.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions import expressions as X
from eventloom.functions import rendering as R
from eventloom.functions import vocabulary as V
from eventloom.functions.decimals import fixed
from eventloom.operators import chains as C
from eventloom.operators import pairing as P
from eventloom.operators import windows as W
from eventloom.operators.quantiles import exact_quantiles
from eventloom.storage import stored

#: Chains of a cell that a full run wants, and the share of one event type from which a pilot warns.
WANTED, DOMINANT = 1_200, 0.8


# --- candidates: each cell's way to cut games ----------------------------------------------------------------------
def around_triggers(events: DataFrame) -> DataFrame:
    found = W.trigger_windows(events, V.ZONE_TRIGGERS, "zone")
    return W.members(events, found.select("game_id", "start", "n", F.col("chain_id").alias("parent"))).drop("start", "n")


def by_period(events: DataFrame) -> DataFrame:
    cut = W.tumbling(events, V.CHAIN_LENGTH["nba"], ["period"])
    return cut.withColumn("parent", X.chain_id(F.col("game_id"), F.concat(F.lit("nba_q"), F.col("period").cast("string"), F.lit("_p"), F.col("chain_no").cast("string")))).drop("chain_no")


def numbered(events: DataFrame, keys: list[str], tag: Column, least: int = 2) -> DataFrame:
    found = W.placed(events, keys).where(F.col("_n") >= least).withColumnRenamed("_row", "slot")
    return found.withColumn("parent", X.chain_id(F.col("game_id"), tag)).drop("_n")


def by_round(events: DataFrame) -> DataFrame:
    """`round`, or else what a phase `round_N` says; negative and missing ones are dropped."""
    number = F.coalesce("round", F.regexp_extract(F.coalesce("phase", F.lit("")), r"^round_(\d+)", 1).try_cast("long"))
    return numbered(events.withColumn("round", number).where("round >= 0"), ["round"], F.concat(F.lit("cs_r"), F.col("round").cast("string")))


def by_goal(events: DataFrame, boundary: str = "objective_capture") -> DataFrame:
    return numbered(W.with_plays(events, boundary), ["play"], F.concat(F.lit("rl_play"), F.col("play").cast("string"))).drop("play")


def by_goal_and_player(events: DataFrame, boundary: str = "objective_capture") -> DataFrame:
    tag = F.concat(F.lit("rl_play"), F.col("play").cast("string"), F.lit("_"), F.col("actor"))
    return numbered(W.with_plays(events, boundary), ["play", "actor"], tag).drop("play")


def by_hand(events: DataFrame) -> DataFrame:
    return W.first_events(events).withColumn("parent", X.chain_id(F.col("game_id"), F.lit("hand")))


def not_ready(events: DataFrame) -> DataFrame:
    raise NotImplementedError("this way of cutting has no definition yet")


CUTS: dict[str, Callable[[DataFrame], DataFrame]] = {"pubg": around_triggers, "fortnite": around_triggers, "nba": by_period, "csgo": by_round, "rocket_league": by_goal, "poker": by_hand}
#: Cuts of experiments, by name.
MORE_CUTS = {"rocket_league_players": by_goal_and_player, "poker_sessions": not_ready, "poker_by_skill": not_ready}


def candidates(events: DataFrame, cells: tuple[str, ...] = V.CELLS, cuts: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """The members of all candidates of the given cells: the events' columns, parent, slot. Events of other cells are
    left out; games of one cell only meet their own cell's cut."""
    made = None
    if len(cells) > 1:
        # Numbered once, not anew for every cell's cut.
        events = stored(events.where(F.col("cell").isin(*cells)), "events")
    for cell in cells:
        one = {**CUTS, **(cuts or {})}[cell](events.where(F.col("cell") == cell))
        one = one.select(*events.columns, "parent", "slot")
        made = one if made is None else made.unionByName(one)
    return made


def run_cells(events: DataFrame, cuts: dict[str, Callable[[DataFrame], DataFrame] | None]) -> tuple[DataFrame, DataFrame]:
    """The candidates' members of all cells whose cut works, and a report of all cells that are registered in `cuts`, streamed in
    `events`, or both: cell, registered, n_streams, n_events, n_candidates, errors.

    A cell whose cut raises, or that has none, is told in the report and doesn't end the run of the others: each cell's
    members are stored by themselves. A streamed null cell is a cell without a cut.
    """
    spark, errors, made = events.sparkSession, {}, None
    events = stored(events, "events")
    for cell, cut in sorted(cuts.items()):
        try:
            if cut is None:
                raise NotImplementedError
            one = stored(cut(events.where(F.col("cell") == cell)).select(*events.columns, "parent", "slot"), "cell-members")
        except NotImplementedError:
            errors[cell] = "its cut isn't there yet"
        except Exception as e:  # any fault of a cell's cut is that cell's
            errors[cell] = f"its cut raised {type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}"
        else:
            made = one if made is None else made.unionByName(one)
    if made is None:
        made = events.limit(0).withColumns({"parent": F.lit(None).cast("string"), "slot": F.lit(None).cast("long")})
    told = spark.createDataFrame([(c, errors.get(c)) for c in cuts], "cell string, error string").withColumn("registered", F.lit(True))
    streams = events.groupBy(F.col("cell").alias("_cell")).agg(F.countDistinct("game_id").alias("n_streams"), F.count("*").alias("n_events"))
    counts = made.where("slot = 0").groupBy(F.col("cell").alias("_of")).agg(F.count("*").alias("n_candidates"))
    both = told.join(streams, F.col("cell").eqNullSafe(F.col("_cell")), "full").withColumn("cell", F.coalesce("cell", "_cell")).join(counts, F.col("cell") == F.col("_of"), "left")
    known, none = F.coalesce("registered", F.lit(False)), F.coalesce("n_streams", F.lit(0)) == 0
    faults = F.array_compact(F.array(F.when(~known, "no cut is registered"), F.when(none, "no streams"), F.col("error")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return made, both.select("cell", known.alias("registered"), zero("n_streams"), zero("n_events"), zero("n_candidates"), faults.alias("errors"))


def fixed_chains(members: DataFrame, sizes: dict[str, int] = V.CHAIN_LENGTH) -> DataFrame:
    """Consecutive chains of each cell's length; tails and short candidates are dropped. Adds sub_no and chain_id."""
    if min(sizes.values()) < 1:
        raise ValueError("chains have at least one event")
    size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("cell")]
    whole = members.withColumn("_size", size).withColumn("sub_no", F.floor(F.col("slot") / F.col("_size")).cast("long"))
    # Slots are dense, so a chain is whole if it has its size; groups are chains, however long candidates are.
    cut = whole.withColumn("_n", F.count("*").over(Window.partitionBy("game_id", "parent", "sub_no"))).where(F.col("_n") == F.col("_size"))
    number = F.when(F.col("sub_no") < 1_000, F.lpad(F.col("sub_no").cast("string"), 3, "0")).otherwise(F.col("sub_no").cast("string"))
    return cut.withColumns({"chain_id": F.concat("parent", F.lit("_sub"), number), "slot": F.col("slot") % F.col("_size")}).drop("_n", "_size")


def passing(members: DataFrame, floor: float = V.GATE_FLOOR) -> DataFrame:
    """The members of the chains whose actionable share reaches the floor."""
    flag = F.when(X.is_actionable(F.col("event_type"), F.col("cell")), 1.0).otherwise(0.0)
    share = F.avg(flag).over(Window.partitionBy("game_id", "chain_id"))
    return members.withColumn("_share", share).where(F.col("_share") >= floor).drop("_share")


# --- prompts and answers -------------------------------------------------------------------------------------------
def rendered(members: DataFrame) -> DataFrame:
    """game_id, cell, chain_id, text: every event in its cell's own line."""
    key = ["game_id", "chain_id"]
    # A chain's few actors in the order of their first events, by one window that needs no second pass over the members.
    chain = F.array_sort(F.collect_list(F.struct("slot", "actor")).over(Window.partitionBy(*key)))
    listed = members.withColumn("_actors", F.array_distinct(F.transform(chain, lambda x: x["actor"])))
    name = lambda place: F.concat(F.lit("Player_"), place.cast("string"))
    named = listed.withColumns({
        "player": name(F.array_position("_actors", F.col("actor")) - 1),
        "_names": F.map_from_entries(F.transform("_actors", lambda x, i: F.struct(x.alias("actor"), name(i).alias("player")))),
    })
    lines = stored(R.with_fields(named.select("cell", *key, "slot", "timestamp", "event_type", "actor_team", "context", "player", "_names")), "event-lines")
    of_name = lambda k: F.coalesce(F.element_at("_names", R.field(k)), R.field(k))
    told = None
    # One plan per cell: all cells' lines in one expression are too much code for a generated method.
    for cell in (*V.CELLS, "fortnite"):
        line = R.line(cell, of_name("eliminates_player"), of_name("already_eliminated_player"))
        one = lines.where(F.col("cell") == cell).select("cell", *key, F.struct("slot", line.alias("_line")).alias("_at"))
        told = one if told is None else told.unionByName(one)
    per = told.groupBy("cell", *key).agg(F.array_sort(F.collect_list("_at")).alias("_lines"))
    return per.select("game_id", "cell", "chain_id", F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n").alias("text"))


def dry_answers(prompts: DataFrame) -> DataFrame:
    """Adds baseline_raw and intervention_raw of the deterministic stand-in."""
    return prompts.withColumns({f"{v}_raw": X.dry_label(F.col("chain_id"), F.lit(v)) for v in ("baseline", "intervention")})


def score_label(correct: Column) -> Column:
    """1 right, 0 wrong, -1 abstained."""
    return F.when(correct.isNull(), -1).when(correct, 1).otherwise(0)


def scored(answers: DataFrame, truth: Column) -> DataFrame:
    """Adds baseline, intervention (strictly parsed), and whether they are right; abstaining is null."""
    out = answers
    for v in ("baseline", "intervention"):
        parsed = X.parse_strict(F.col(f"{v}_raw"), ("yes", "no"))
        out = out.withColumn(v, parsed).withColumn(f"{v}_ok", F.when(F.col(v) != "", F.col(v) == truth))
    return out


def evaluated(members: DataFrame, truth: str, answer: Callable[[DataFrame], DataFrame] = dry_answers) -> DataFrame:
    """The scored answers of all chains: prompts are written, answered by `answer` (which adds baseline_raw and
    intervention_raw) and compared with the truth, yes or no."""
    return scored(answer(C.prompts(rendered(members))), F.lit(truth))


# --- reports --------------------------------------------------------------------------------------------------------
def resampled(tables: DataFrame, iterations: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Adds lo and hi, bootstrap bounds of (c - b) / n.

    Resampled pairs only matter by how many are b and c, so a multinomial draw per iteration replaces resampling: the
    cost doesn't grow with the pairs. `tables` has one row per cell.
    """

    def bounds(batches):  # noqa: ANN001, ANN202
        for part in batches:
            rows = []
            for n, b, c in zip(part["n"], part["b"], part["c"], strict=True):
                if not n:
                    rows.append((0.0, 0.0))
                    continue
                drawn = np.random.default_rng(seed).multinomial(n, [b / n, c / n, (n - b - c) / n], size=iterations)
                rows.append(tuple(np.quantile((drawn[:, 1] - drawn[:, 0]) / n, [(1 - level) / 2, (1 + level) / 2])))
            yield part.assign(lo=[r[0] for r in rows], hi=[r[1] for r in rows])

    return tables.mapInPandas(bounds, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in tables.schema)}, lo double, hi double")


def ordered_bounds(tables: DataFrame, iterations: int = 5_000, seed: int = 20260430, alpha: float = 0.05) -> DataFrame:
    """Adds delta, (c - b) / n, and lo and hi: the draws in the places int(alpha / 2 * iterations) and
    int((1 - alpha / 2) * iterations) in order, not interpolated; all 0 without pairs. Draws are `resampled`'s."""

    def bounds(batches):  # noqa: ANN001, ANN202
        for part in batches:
            rows = []
            for n, b, c in zip(part["n"], part["b"], part["c"], strict=True):
                if not n:
                    rows.append((0.0, 0.0, 0.0))
                    continue
                drawn = np.random.default_rng(seed).multinomial(n, [b / n, c / n, (n - b - c) / n], size=iterations)
                found = np.sort((drawn[:, 1] - drawn[:, 0]) / n)
                rows.append(((c - b) / n, found[int(alpha / 2 * iterations)], found[int((1 - alpha / 2) * iterations)]))
            yield part.assign(delta=[r[0] for r in rows], lo=[r[1] for r in rows], hi=[r[2] for r in rows])

    return tables.mapInPandas(bounds, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in tables.schema)}, delta double, lo double, hi double")


def proportion_bounds(tables: DataFrame, iterations: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Adds lo and hi, bootstrap bounds of the share k / n; 0 without rows. A resample of n yes-or-no values only
    matters by how many are yes, so it is one binomial draw."""

    def bounds(batches):  # noqa: ANN001, ANN202
        for part in batches:
            rows = []
            for n, k in zip(part["n"], part["k"], strict=True):
                drawn = np.random.default_rng(seed).binomial(n, k / n, size=iterations) / n if n else np.zeros(1)
                rows.append(tuple(np.quantile(drawn, [(1 - level) / 2, (1 + level) / 2])))
            yield part.assign(lo=[r[0] for r in rows], hi=[r[1] for r in rows])

    return tables.mapInPandas(bounds, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in tables.schema)}, lo double, hi double")


def partial_rates(pairs: DataFrame, cells: tuple[str, ...]) -> DataFrame:
    """cell, n, base_rate, int_rate, b, c of the given cells, those without answers too: what a run that isn't finished
    can tell. `pairs`: cell, baseline_ok, intervention_ok; a pair with a null on either side is left out."""
    made = P.contingency(pairs.where(F.col("cell").isin(*cells)), ["cell"])
    wanted = pairs.sparkSession.createDataFrame([(c,) for c in cells], "cell string")
    rate = lambda own: F.try_divide(F.col("a") + F.col(own), F.col("n"))
    return wanted.join(made, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"), rate("b").alias("base_rate"), rate("c").alias("int_rate"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("b", "c")])


def tested(pairs: DataFrame) -> DataFrame:
    """One row per cell: the table, chi square, p, corrected p, effect, bounds, power, least detectable effect, notes."""
    rows = P.contingency(pairs, ["cell"]).withColumns({"statistic": P.statistic(), "h": P.effect()})
    done = resampled(P.with_power(P.corrected(P.with_p(rows))))
    few = F.col("b") + F.col("c")
    return done.withColumn("note", F.when(few == 0, "no discordant pairs").when(few < V.MIN_DISCORDANT, "few discordant pairs"))


def consistency_run(events: DataFrame, cells: tuple[str, ...] = V.CELLS, most: int = WANTED, answer: Callable[[DataFrame], DataFrame] = dry_answers) -> DataFrame:
    """Per cell: the tests over real chains (truth yes) and, with them, the effect over shuffled controls (truth no) and
    whether that hints at a leak."""
    kept = stored(capped(passing(fixed_chains(candidates(events, cells))), most), "kept-chains")
    # Real chains and controls are written and answered in one pass.
    is_control = F.col("chain_id").endswith("_shuf00")
    asked = answer(C.prompts(rendered(kept.unionByName(shuffled(kept)))))
    pairs = stored(scored(asked, F.when(is_control, "no").otherwise("yes")).select("cell", is_control.alias("control"), "baseline_ok", "intervention_ok"), "answers")
    primary = tested(pairs.where("not control"))
    control = P.contingency(pairs.where("control"), ["cell"]).where(F.col("n") >= V.MIN_DISCORDANT)
    effects = primary.select("cell", F.col("h").alias("primary")).join(control.select("cell", P.effect().alias("control")), "cell", "left")
    return primary.join(P.leakage(effects), "cell", "left")


def capped(members: DataFrame, most: int) -> DataFrame:
    """The members of the first `most` chains per cell, by game and chain."""
    ids = members.where("slot = 0").select("cell", "game_id", "chain_id")
    first = C.capped(ids, "cell", ["game_id", "chain_id"], most)
    return members.join(first, ["cell", "game_id", "chain_id"], "left_semi")


def shuffled(members: DataFrame, seed: int = 42) -> DataFrame:
    """Each chain's events in a hash-random order; timestamps keep their slots; chain_id + `_shuf00`."""
    key = X.hash_number(F.concat_ws(":", F.lit(str(seed)), "chain_id", F.col("slot").cast("string")))
    group = Window.partitionBy("game_id", "chain_id")
    moved = members.withColumn("_to", F.row_number().over(group.orderBy(key, "slot"))).withColumn("_times", F.array_sort(F.collect_list(F.struct("slot", "timestamp")).over(group)))
    return moved.withColumns({"timestamp": F.get("_times", F.col("_to") - 1)["timestamp"], "slot": F.get("_times", F.col("_to") - 1)["slot"], "chain_id": F.concat("chain_id", F.lit("_shuf00"))}).drop("_to", "_times")


def pilot(events: DataFrame, cells: tuple[str, ...] = V.CELLS, cuts: dict[str, Callable[[DataFrame], DataFrame]] | None = None, floor: float = V.GATE_FLOOR) -> DataFrame:
    """One row per cell: streams, events, chains before and after the gate, retention, lengths and actionable shares of
    the chains kept, their event types as a map, warnings, passed."""
    members = candidates(events, cells, cuts)
    flag = X.is_actionable(F.col("event_type"), F.col("cell"))
    per = stored(members.groupBy("cell", "game_id", "parent").agg(F.count("*").alias("n"), (F.count_if(flag) / F.count("*")).alias("share")), "candidate-shares")
    good = F.col("share") >= floor
    keep = lambda f, c: F.coalesce(f(F.when(good, F.col(c))), F.lit(0))
    chains = per.groupBy("cell").agg(
        F.count("*").alias("n_chains_raw"), F.count_if(good).alias("n_chains_post_gate"), keep(F.avg, "n").alias("length_mean"), keep(F.min, "n").alias("length_min"), keep(F.max, "n").alias("length_max"),
        keep(F.avg, "share").alias("share_mean"), keep(F.min, "share").alias("share_min"), keep(F.max, "share").alias("share_max"),
    )
    kept = members.join(per.where(good).select("cell", "game_id", "parent"), ["cell", "game_id", "parent"], "left_semi")
    types = kept.groupBy("cell", "event_type").agg(F.count("*").alias("k")).groupBy("cell").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "k")))).alias("event_types"), (F.max("k") / F.sum("k")).alias("_top"), F.max_by("event_type", F.struct("k", "event_type")).alias("_most"))
    streams = events.where(F.col("cell").isin(*cells)).groupBy("cell").agg(F.countDistinct("game_id").alias("n_streams"), F.count("*").alias("n_events"))
    medians = exact_quantiles(per.where(good), ["cell"], "n", {"length_median": 0.5})
    every = streams.join(chains, "cell", "left").join(medians, "cell", "left").join(types, "cell", "left").na.fill(0)
    rate = F.coalesce(F.try_divide("n_chains_post_gate", "n_chains_raw"), F.lit(0.0))
    few = F.format_string(f"%d chains behind the gate, a full run wants {WANTED:,}", "n_chains_post_gate")
    low = F.format_string(f"%s%% of the chains stay, the floor is {floor:.0%}", fixed(rate * 100, 1))
    top = F.format_string("%s is %s%% of the events", "_most", fixed(F.col("_top") * 100, 1))
    warnings = F.array_compact(F.array(F.when(F.col("n_chains_post_gate") < WANTED, few), F.when(rate < floor, low), F.when(F.col("_top") > DOMINANT, top)))
    return every.withColumns({"retention_rate": rate, "passed": rate >= floor, "warnings": warnings}).drop("_top", "_most")


def readiness(cells: DataFrame) -> DataFrame:
    """Adds light to (cell, has_access, has_synthetic): green with access, yellow with synthetic streams only, else red."""
    return cells.withColumn("light", F.when(F.col("has_access"), "green").when(F.col("has_synthetic"), "yellow").otherwise("red"))
