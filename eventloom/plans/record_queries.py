"""All queries of the event part: those of `queries`, and those over records, lists, streams of chains and partial runs.

Records of the sources are made from the driver's tables, so that their SQL can make the events anew from the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import chains as C
from eventloom.operators import inject as I
from eventloom.operators import pairing as P
from eventloom.operators import windows as W
from eventloom.operators.ordinals import with_ordinals
from eventloom.plans import harness as H
from eventloom.plans.queries import LABELS, ORACLE_SQL, QUERIES, REPEATS, actions_of, answers, labelled_pairs, on_chains, on_events, query, tables_of
from eventloom.plans.tables import chains, events, table
from eventloom.sources import builder, carsoccer, nba, poker, pubg

__all__ = ["ORACLE_SQL", "QUERIES"]


# --- chains and lists -----------------------------------------------------------------------------------------------
STREAMED = "SELECT game_id, sequence_idx, c AS chain_no, sequence_idx - {step}c AS slot, game_id || '_chain_' || printf('%04d', c) AS chain_id FROM ({cut}) WHERE {step}c + 5 <= n_game"


@query(on_events(STREAMED.format(step="5 * ", cut="SELECT *, sequence_idx // 5 AS c FROM ev")))
def stream_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.stream_chains(events(spark, sf_dir), 5).select("game_id", "sequence_idx", "chain_no", "slot", "chain_id")


@query(on_events(STREAMED.format(step="", cut="SELECT *, unnest(range(greatest(0, sequence_idx - 4), sequence_idx + 1)) AS c FROM ev")))
def overlapping_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.stream_chains(events(spark, sf_dir), 5, overlap=True).select("game_id", "sequence_idx", "chain_no", "slot", "chain_id")


@query(on_chains("SELECT cell, row_number() OVER (PARTITION BY cell ORDER BY game_id, chain_no) - 1 AS place, chain_id, CASE WHEN chain_no % 2 = 0 THEN 'yes' ELSE 'no' END AS truth, baseline AS baseline_raw, intervention AS intervention_raw FROM ans", LABELS))
def positional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains, truths and both answers as lists by place; lists that don't fit raise."""
    made = with_ordinals(answers(spark, sf_dir), ["cell"], ["game_id", "chain_no"], "place")
    told = lambda text: made.select("cell", "place", "chain_id", text.alias("text"))
    truths = made.select("cell", "place", F.when(F.col("chain_no") % 2 == 0, "yes").otherwise("no").alias("text"))
    return P.positional(made.select("cell", "place", "chain_id"), truths, told(F.col("baseline")), told(F.col("intervention")))


# --- planted violations -------------------------------------------------------------------------------------------------
ACTED = "(SELECT *, CASE k % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'cc' END AS action, CASE WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) END AS bet FROM ch)"
FOLDED = """SELECT chain_id || '_adv' AS chain_id, slot, CASE WHEN own AND slot = first_slot THEN 'disengage_decision' WHEN later THEN 'engage_decision' ELSE event_type END AS event_type,
  CASE WHEN own AND slot = first_slot THEN 'f' WHEN {raises} THEN 'cbr' ELSE action END AS action, CASE WHEN own AND slot = first_slot THEN 0.0 WHEN {raises} THEN coalesce(bet, 5.0) ELSE bet END AS bet{more}
  FROM (SELECT *, actor = who AS own, actor = who AND slot {when} AS later FROM """ + ACTED + " JOIN rp USING (chain_id))"


def acted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return chains(spark, sf_dir).withColumns({"action": F.when(k % 3 == 0, "f").when(k % 3 == 1, "cc"), "bet": F.when(k % 2 == 0, k.cast("double"))})


@query(on_chains(FOLDED.format(raises="later AND coalesce(action = 'f', true)", when="> first_slot", more=", later AS already_folded"), REPEATS))
def inject_fold_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.folds_then_acts(acted(spark, sf_dir)).select("chain_id", "slot", "event_type", "action", "bet", "already_folded")


@query(on_chains(FOLDED.format(raises="later", when="= last_slot", more=""), REPEATS))
def inject_fold_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.folds_then_acts(acted(spark, sf_dir), marked=False).select("chain_id", "slot", "event_type", "action", "bet")


@query(
    on_chains(
        """SELECT cell, CASE cell WHEN 'nba' THEN 'A player with 6 fouls is ejected' WHEN 'pubg' THEN 'An eliminated player cannot act' WHEN 'rocket_league' THEN 'A goal resets ball and player positions for a kickoff'
          WHEN 'poker' THEN 'A folded player cannot act again' ELSE 'Eliminated players don''t respawn until next round' END AS clauses, count(DISTINCT chain_id) AS n_chains
        FROM ch WHERE cell IN ('nba', 'pubg', 'rocket_league') OR chain_id IN (SELECT chain_id FROM rp) GROUP BY ALL""",
        REPEATS,
    )
)
def violation_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.violation_clauses(chains(spark, sf_dir)).withColumn("clauses", F.array_join("clauses", "|"))


STREETS = ("preflop", "flop", "turn", "river", "showdown", "")


@query(
    on_chains(
        """SELECT chain_id, string_agg(street, ',' ORDER BY rank, first) AS streets FROM (
          SELECT chain_id, street, min(slot) AS first, CASE street WHEN 'preflop' THEN 1 WHEN 'flop' THEN 2 WHEN 'turn' THEN 3 WHEN 'river' THEN 4 ELSE 99 END AS rank
          FROM (SELECT *, (['preflop', 'flop', 'turn', 'river', 'showdown', ''])[CAST(k % 6 + 1 AS INTEGER)] AS street FROM ch) WHERE street <> '' GROUP BY ALL) GROUP BY chain_id"""
    )
)
def streets_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    street = F.element_at(F.array(*map(F.lit, STREETS)), (F.col("k") % 6 + 1).cast("int"))
    return C.streets_covered(chains(spark, sf_dir), street).withColumn("streets", F.array_join("streets", ","))


# --- partial runs and bounds -------------------------------------------------------------------------------------------------
@query(on_chains("SELECT cell, n, (a + b) / n AS base_rate, (a + c) / n AS int_rate, b, c FROM ct WHERE cell IN ('pubg', 'nba') UNION ALL SELECT 'unknown', 0, NULL, NULL, 0, 0", LABELS))
def partial_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of two cells, and of one without answers."""
    return H.partial_rates(answers(spark, sf_dir), ("pubg", "nba", "unknown"))


@query()
def proportion_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the share of good documents from 10,000 resamples; tested against resamples one by one."""
    per = labelled_pairs(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n"), F.count_if("intervention_ok").alias("k"))
    return H.proportion_bounds(per).select("cell", "lo", "hi")


@query()
def mcnemar_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per cell; its p needs erfc, which SQL lacks."""
    rows = tables_of(spark, sf_dir).withColumns({"statistic": P.statistic(), "h": P.effect()})
    return H.resampled(P.corrected(P.with_p(rows))).select("cell", P.summary().alias("line"))


# --- records to events ---------------------------------------------------------------------------------------------------------
@query(
    """SELECT 'rl_' || o_custkey AS game_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 9000 / 30.0, o_orderkey) - 1 AS sequence_idx, o_orderkey % 9000 / 30.0 AS timestamp,
      'objective_capture' AS event_type, o_orderpriority AS actor FROM orders"""
)
def goal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays with goals only: a customer's orders are the goals of a game."""
    goal = F.struct((F.col("o_orderkey") % 9000).alias("frame"), F.struct(F.col("o_orderpriority").alias("value")).alias("PlayerName"))
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", goal.alias("g")))).alias("x"))
    records = per.select(
        F.col("o_custkey").cast("string").alias("id"), F.struct(F.struct(F.lit(None).cast("string").alias("value")).alias("Id"), F.struct(F.transform("x", lambda y: y["g"]).alias("value")).alias("Goals")).alias("properties"),
        *[F.lit(None).cast("string").alias(c) for c in ("_hits", "blue", "orange")],
    )
    return carsoccer.from_goals(records).select("game_id", "sequence_idx", "timestamp", "event_type", "actor")


LOGS = {"click": "LogPlayerKillV2", "view": "LogPlayerTakeDamage", "purchase": "LogItemPickup", "signup": "LogGameStatePeriodic", "error": "LogOther"}


@query(
    """WITH e AS (SELECT user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
          (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000 AS timestamp FROM events),
      z AS (SELECT *, lag(value) OVER (PARTITION BY user_id, CASE WHEN event_type = 'signup' AND value IS NOT NULL THEN 1 ELSE 0 END ORDER BY pos) AS before FROM e WHERE event_type <> 'error'),
      s AS (SELECT * FROM z WHERE CASE WHEN event_type = 'signup' THEN value IS NOT NULL AND (before IS NULL OR value < before - 1.0)
          ELSE k % 4 <> 0 AND (event_type <> 'view' OR coalesce(value, 0) >= 30) END)
    SELECT 'pubg_' || user_id AS game_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, pos) - 1 AS sequence_idx, timestamp,
      CASE event_type WHEN 'click' THEN 'engage_decision' WHEN 'view' THEN 'risk_accept' WHEN 'purchase' THEN 'resource_gain' ELSE 'zone_enter' END AS event_type,
      CASE WHEN event_type = 'signup' THEN 'zone' ELSE 'account.' || k END AS actor FROM s"""
)
def telemetry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Battle-royale telemetry: a user's events are the logs of a match, with bots, weak hits and shrinking zones."""
    raw = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    who = F.struct(F.concat(F.lit("account."), F.col("k").cast("string")).alias("accountId"), F.lit(None).cast("string").alias("name"), F.when(F.col("k") % 4 == 0, "user_ai").otherwise("user").alias("type"))
    kind = F.create_map(*[F.lit(x) for pair in LOGS.items() for x in pair])[F.col("event_type")]
    when = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    log = F.struct(
        kind.alias("_T"), when("ts").alias("_D"), F.when(F.col("event_type") == "click", who).alias("killer"), F.when(F.col("event_type") == "view", who).alias("victim"), F.when(F.col("event_type") == "purchase", who).alias("character"),
        F.col("value").alias("damage"), F.struct(F.lit("item").alias("itemId"), F.lit(1).alias("stackCount")).alias("item"), F.struct(F.when(F.col("event_type") == "signup", F.col("value")).alias("safetyZoneRadius")).alias("gameState"),
    )
    per = raw.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", log.alias("log")))).alias("x"), F.min("ts").alias("first"))
    told = F.to_json(F.struct(F.col("user_id").cast("string").alias("match_id"), F.struct(when("first").alias("createdAt")).alias("match_attrs"), F.transform("x", lambda y: y["log"]).alias("telemetry")))
    records = per.select(F.from_json(told, pubg.RECORD).alias("r")).select("r.*")
    return pubg.events(records).select("game_id", "sequence_idx", "timestamp", "event_type", "actor")


ACTIONS = {"click": "Made Shot", "view": "Rebound", "purchase": "Turnover", "signup": "Foul", "error": "Ejection"}


@query(
    """WITH e AS (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
    SELECT 'nba_' || user_id AS game_id, pos AS sequence_idx, CASE event_type WHEN 'click' THEN 'engage_decision' WHEN 'view' THEN 'resource_gain' WHEN 'purchase' THEN 'resource_spend' ELSE 'risk_accept' END AS event_type,
      CAST(CASE WHEN k % 11 = 0 THEN k % 6 * 720 ELSE least(k % 6, 4) * 720 + greatest(k % 6 - 4, 0) * 300 + CASE WHEN k % 6 < 4 THEN 720 ELSE 300 END - (k % 5 * 60 + k % 60) END AS DOUBLE) AS timestamp,
      CASE WHEN k % 9 = 0 THEN 'unknown' ELSE CAST(k % 9 AS VARCHAR) END AS actor FROM e WHERE event_type <> 'error'"""
)
def play_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basketball play-by-play: a user's events are the plays of a game, some with clocks that can't be read."""
    raw = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k = F.col("k")
    clock = F.when(k % 11 == 0, "none").otherwise(F.format_string("PT%02dM%02d.00S", k % 5, k % 60))
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[F.col("event_type")]
    play = F.struct(clock.alias("clock"), (k % 6 + 1).cast("int").alias("period"), (k % 9).alias("personId"), action.alias("actionType"))
    per = raw.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", play.alias("p")))).alias("x"))
    told = F.to_json(F.struct(F.struct(F.col("user_id").cast("string").alias("gameId"), F.transform("x", lambda y: y["p"]).alias("actions")).alias("game")))
    records = per.select(F.from_json(told, nba.RECORD).alias("r")).select("r.*")
    return nba.plays(records).select("game_id", "sequence_idx", "event_type", "timestamp", "actor")


@query(
    """WITH e AS (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
          (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000 AS ms FROM events)
    SELECT 'fnc_' || user_id AS game_id, row_number() OVER (PARTITION BY user_id ORDER BY ms, pos) - 1 AS sequence_idx, ms / 1000.0::DOUBLE AS timestamp,
      CASE event_type WHEN 'view' THEN 'zone_enter' WHEN 'purchase' THEN 'position_commit' ELSE CASE k % 4 WHEN 0 THEN 'risk_accept' WHEN 1 THEN 'zone_exit' ELSE 'engage_decision' END END AS event_type,
      CASE event_type WHEN 'view' THEN 'storm' ELSE 'p' || k % 5 END AS actor, CASE event_type WHEN 'view' THEN 'storm_phase_' || k % 10 END AS phase
    FROM e WHERE event_type IN ('click', 'view') OR (event_type = 'purchase' AND k % 7 <> 0)"""
)
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event chunks of a building game: fights, falls and storms, phases of the storm, other groups with and without an actor."""
    raw = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k, kind = F.col("k"), F.col("event_type")
    who = F.concat(F.lit("p"), (k % 5).cast("string"))
    weapon = F.when(k % 4 == 0, "fall").when(k % 4 == 1, "Storm").otherwise("rifle")
    meta = (
        F.when(kind == "click", F.create_map(F.lit("eliminator"), who, F.lit("weapon"), weapon))
        .when(kind == "view", F.create_map(F.lit("phase"), (k % 10).cast("string")))
        .when(kind == "purchase", F.create_map(F.lit("playerId"), F.when(k % 7 == 0, "unknown").otherwise(who)))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    group = F.when(kind == "click", "playerElim").when(kind == "view", "PhaseChange").when(kind == "purchase", "Loot").when(kind == "signup", "PlayerLogin").otherwise("Other")
    first = raw.groupBy("user_id").agg(F.min("ts").alias("_first"))
    ms = F.floor(F.expr("timestampdiff(MICROSECOND, _first, ts)") / 1000)
    chunk = F.struct(F.col("event_id").cast("string").alias("id"), group.alias("group"), meta.alias("metadata"), ms.alias("time1_ms"), ms.alias("time2_ms"))
    # Maps can't be sorted: chunks are gathered by their place.
    placed = raw.join(first, "user_id").select("user_id", F.struct("ts", "event_id").alias("_at"), F.to_json(chunk).alias("_c"))
    per = placed.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("_at", "_c"))).alias("x"))
    told = F.concat(F.lit('{"match_id":"'), F.col("user_id").cast("string"), F.lit('","events":['), F.array_join(F.transform("x", lambda y: y["_c"]), ","), F.lit("]}"))
    records = per.select(F.from_json(told, builder.RECORD).alias("r")).select("r.*")
    return builder.events(records).select("game_id", "sequence_idx", "timestamp", "event_type", "actor", "phase")


HANDS = ORACLE_SQL["stack_fold"].replace("[1000::BIGINT, 1000, 1000] AS stacks, [0::BIGINT, 0, 0] AS put, 0::BIGINT AS pot, 0::BIGINT AS bet", "[999::BIGINT, 998, 1000] AS stacks, [1::BIGINT, 2, 0] AS put, 3::BIGINT AS pot, 2::BIGINT AS bet")


@query(
    f"""SELECT 'pk_' || hand AS game_id, acted AS sequence_idx, acted * 3.0::DOUBLE + deals * 2.0::DOUBLE AS timestamp, CASE move WHEN 'fold' THEN 'disengage_decision' ELSE 'engage_decision' END AS event_type,
      'a' || seat AS actor, (['preflop', 'flop', 'turn', 'river'])[least(deals, 3) + 1] AS phase, stack / 2.0::DOUBLE AS stack_bb, pot / 2.0::DOUBLE AS pot_bb
    FROM (SELECT *, CAST(count(*) FILTER (move = 'deal') OVER w AS INTEGER) AS deals, count(*) FILTER (move <> 'deal') OVER w - 1 AS acted FROM ({HANDS}) WINDOW w AS (PARTITION BY hand ORDER BY step)) WHERE move <> 'deal'"""
)
def hand_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poker hands in the words of hand histories: a user's events are the actions of a hand of three with blinds."""
    word = lambda *parts: F.concat_ws(" ", F.concat(F.lit("p"), F.col("seat").cast("string")), *parts)
    text = F.when(F.col("move") == "deal", "d db ????").when(F.col("move") == "fold", word(F.lit("f"))).when(F.col("move") == "raise", word(F.lit("cbr"), F.col("amount").cast("string"))).otherwise(word(F.lit("cc")))
    per = actions_of(spark, sf_dir).groupBy("hand").agg(F.array_sort(F.collect_list(F.struct("step", text.alias("text")))).alias("x"))
    hands = per.select(
        F.concat(F.lit("pk_"), F.col("hand").cast("string")).alias("game_id"), F.array(*map(F.lit, ("a0", "a1", "a2"))).alias("players"), F.lit(3).alias("n_players"), F.lit(2).cast("long").alias("big_blind"),
        F.array(*[F.lit(1_000).cast("long")] * 3).alias("starting_stacks"), F.array(*[F.lit(b).cast("long") for b in (1, 2, 0)]).alias("blinds"), F.transform("x", lambda y: y["text"]).alias("actions"),
    )
    number = lambda name: F.get_json_object("context", f"$.{name}").cast("double")
    return poker.events(hands).select("game_id", "sequence_idx", "timestamp", "event_type", "actor", "phase", number("stack_bb").alias("stack_bb"), number("pot_size_bb").alias("pot_bb"))
