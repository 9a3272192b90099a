"""Queries over the event tables, each with the SQL that it equals where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions import expressions as X
from eventloom.functions import vocabulary as V
from eventloom.functions.decimals import fixed
from eventloom.operators import chains as C
from eventloom.operators import inject as I
from eventloom.operators import pairing as P
from eventloom.operators import state as S
from eventloom.operators import windows as W
from eventloom.operators.quantiles import exact_quantiles
from eventloom.plans import harness as H
from eventloom.plans import ledger, metrics
from eventloom.plans.tables import CHAINS_SQL, EVENTS_SQL, TYPES, chains, events, table
from eventloom.sources import buckets, files, quarantine, synthetic
from eventloom.storage import session_dir, stored
from eventloom.streaming import timed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def on_events(sql: str) -> str:
    return f"WITH {EVENTS_SQL} {sql}"


def on_chains(sql: str, more: str = "") -> str:
    return f"WITH {CHAINS_SQL}{more} {sql}"


ACTIONABLE = "event_type IN ('resource_spend', 'position_commit', 'zone_enter', 'engage_decision')"
#: Answers of the deterministic stand-in and whether they are right: the truth of a chain is the parity of its number.
LABELS = r""", ans AS (
  SELECT DISTINCT cell, game_id, chain_no, chain_id,
         CASE WHEN CAST('0x' || substr(sha256(chain_id || '_baseline'), 1, 2) AS INTEGER) % 10 < 4 THEN 'YES' ELSE 'NO' END AS baseline,
         CASE WHEN CAST('0x' || substr(sha256(chain_id || '_intervention'), 1, 2) AS INTEGER) % 10 < 8 THEN 'YES' ELSE 'NO' END AS intervention
  FROM ch),
pr AS (SELECT *, (baseline = 'YES') = (chain_no % 2 = 0) AS baseline_ok, (intervention = 'YES') = (chain_no % 2 = 0) AS intervention_ok FROM ans),
ct AS (SELECT cell, count(*) AS n, count(*) FILTER (baseline_ok AND intervention_ok) AS a, count(*) FILTER (baseline_ok AND NOT intervention_ok) AS b,
              count(*) FILTER (NOT baseline_ok AND intervention_ok) AS c, count(*) FILTER (NOT baseline_ok AND NOT intervention_ok) AS d
       FROM pr GROUP BY cell)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = chains(spark, sf_dir).where("slot = 0").select("cell", "game_id", "chain_no", "chain_id")
    made = per.withColumns({v: X.dry_label(F.col("chain_id"), F.lit(v)) for v in ("baseline", "intervention")})
    truth = F.col("chain_no") % 2 == 0
    return made.withColumns({f"{v}_ok": (F.col(v) == "YES") == truth for v in ("baseline", "intervention")})


# --- normalised events ------------------------------------------------------------------------------------------
@query(on_events("SELECT game_id, cell, sequence_idx, t_us, event_type, k, actor, value, period FROM ev"))
def events_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).drop("timestamp")


@query(on_events("SELECT regexp_replace('phase_' || CASE WHEN k % 2 = 0 THEN 'phase_' ELSE '' END || event_type, '^phase_', '') AS event_type, count(*) AS n FROM ev GROUP BY 1"))
def phase_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("phase_"), F.when(F.col("k") % 2 == 0, "phase_").otherwise(""), F.col("event_type"))
    return events(spark, sf_dir).select(X.strip_phase(raw).alias("event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@query(on_events(f"SELECT cell, event_type, {ACTIONABLE} AS is_actionable, count(*) AS n FROM ev GROUP BY ALL"))
def actionable_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("is_actionable", X.is_actionable(F.col("event_type"), F.col("cell"))).groupBy("cell", "event_type", "is_actionable").agg(F.count("*").alias("n"))


# --- windows ------------------------------------------------------------------------------------------------------
def trigger_sql(types: str, tag: str) -> str:
    return on_events(
        f"""SELECT game_id, greatest(0, least(greatest(0, sequence_idx - 4), n_game - 8)) AS start, min(sequence_idx) AS trigger_idx,
            CAST(least(8, min(n_game)) AS BIGINT) AS n,
            substr(md5(game_id || '__{tag}_' || greatest(0, least(greatest(0, sequence_idx - 4), n_game - 8))), 1, 16) AS chain_id
        FROM ev WHERE event_type IN ({types}) GROUP BY ALL HAVING min(n_game) >= 2"""
    )


@query(trigger_sql("'zone_enter', 'position_commit'", "zone").replace("GROUP BY ALL", "GROUP BY game_id, 2, 5"))
def trigger_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.trigger_windows(events(spark, sf_dir), V.ZONE_TRIGGERS, "zone")


@query(trigger_sql("'resource_spend'", "build").replace("GROUP BY ALL", "GROUP BY game_id, 2, 5"))
def build_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.trigger_windows(events(spark, sf_dir), V.BUILD_TRIGGERS, "build")


@query(
    on_events(
        """, w AS (SELECT DISTINCT game_id, greatest(0, least(greatest(0, sequence_idx - 4), n_game - 8)) AS start, n_game
             FROM ev WHERE event_type IN ('zone_enter', 'position_commit') AND n_game >= 2)
        SELECT w.game_id, w.start, count(*) AS n_members, count(*) FILTER (ev.event_type = 'player_idle') AS n_idle
        FROM w JOIN ev ON ev.game_id = w.game_id AND ev.sequence_idx BETWEEN w.start AND w.start + 7 GROUP BY ALL"""
    ).replace("events) ,", "events),")
)
def window_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events(spark, sf_dir)
    held = W.members(found, W.trigger_windows(found, V.ZONE_TRIGGERS, "zone"))
    return held.groupBy("game_id", "start").agg(F.count("*").alias("n_members"), F.count_if(F.col("event_type") == "player_idle").alias("n_idle"))


@query(
    on_events(
        """SELECT game_id, period, chain_no, count(*) AS n, min(sequence_idx) AS first_idx FROM (
           SELECT *, (row_number() OVER (PARTITION BY game_id, period ORDER BY sequence_idx) - 1) // 5 AS chain_no FROM ev) GROUP BY ALL HAVING count(*) = 5"""
    )
)
def tumbling_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = W.tumbling(events(spark, sf_dir), V.CHAIN_LENGTH["nba"], ["period"])
    return cut.groupBy("game_id", "period", "chain_no").agg(F.count("*").alias("n"), F.min("sequence_idx").alias("first_idx"))


@query(on_events("SELECT game_id, k % 12 - 1 AS round, count(*) AS n, min(sequence_idx) AS first_idx FROM ev WHERE k % 12 - 1 >= 0 GROUP BY ALL HAVING count(*) >= 2"))
def group_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rounds(events(spark, sf_dir), F.col("k") % 12 - 1)


PLAYS = """, p AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'resource_spend' THEN 1 ELSE 0 END)
  OVER (PARTITION BY game_id ORDER BY sequence_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS play FROM ev)"""


@query(f"WITH {EVENTS_SQL}{PLAYS} SELECT game_id, play, count(*) AS n, bool_or(event_type = 'resource_spend') AS ends_in_goal FROM p GROUP BY ALL HAVING count(*) >= 2")
def goal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.plays(events(spark, sf_dir), "resource_spend")


@query(
    f"""WITH {EVENTS_SQL}{PLAYS}, a AS (SELECT game_id, play, actor, count(*) AS n FROM p GROUP BY ALL)
    SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY game_id, play ORDER BY actor) - 1 AS player_slot FROM a) WHERE n >= 2"""
)
def player_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.player_plays(events(spark, sf_dir), "resource_spend")


@query(
    on_events(
        """SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY start) - 1 AS chain_no FROM (
        SELECT game_id, sequence_idx AS start, CAST(least(5, n_game - sequence_idx) AS BIGINT) AS n,
               CAST((SELECT count(*) FROM ev e WHERE e.game_id = ev.game_id AND e.sequence_idx BETWEEN ev.sequence_idx AND ev.sequence_idx + 4
                     AND e.event_type IN ('engage_decision', 'resource_spend')) AS BIGINT) AS n_actionable
        FROM ev WHERE sequence_idx % 3 = 0) WHERE n >= 2 AND n_actionable > 0"""
    )
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sliding(events(spark, sf_dir), F.col("event_type").isin("engage_decision", "resource_spend"))


@query(on_events("SELECT game_id, sequence_idx, sequence_idx AS slot, event_type FROM ev WHERE n_game >= 3 AND sequence_idx < 8"))
def first_n_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.first_events(events(spark, sf_dir)).select("game_id", "sequence_idx", F.col("slot").cast("long").alias("slot"), "event_type")


@query(
    f"""WITH {EVENTS_SQL}{PLAYS}, c AS (SELECT game_id, play, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 3)
    SELECT game_id, play, CAST(i AS INTEGER) AS sub_no, CAST(i * 3 AS BIGINT) AS "offset", game_id || '_' || play || '_sub' || lpad(CAST(i AS VARCHAR), 3, '0') AS chain_id
    FROM (SELECT *, unnest(range(0, n // 3)) AS i FROM c)"""
)
def fixed_subwindows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = W.plays(events(spark, sf_dir), "resource_spend").withColumn("parent_id", F.concat_ws("_", "game_id", "play"))
    return W.subwindows(found, 3).select("game_id", "play", "sub_no", "offset", "chain_id")


# --- state ----------------------------------------------------------------------------------------------------------
POSSESSIONS = """, m AS (SELECT *, event_type IN ('resource_spend', 'zone_enter') AS hard,
   event_type = 'player_idle' AND coalesce(k % 2 <> lag(k % 2) OVER (PARTITION BY game_id ORDER BY sequence_idx), false) AS turn FROM ev),
steps AS (
  SELECT game_id, sequence_idx, hard, turn, hard AS ends FROM m WHERE sequence_idx = 0
  UNION ALL
  SELECT m.game_id, m.sequence_idx, m.hard, m.turn, m.hard OR (m.turn AND NOT s.ends)
  FROM steps s JOIN m ON m.game_id = s.game_id AND m.sequence_idx = s.sequence_idx + 1),
q AS (SELECT m.*, s.ends, coalesce(sum(s.ends::INT) OVER (PARTITION BY m.game_id ORDER BY m.sequence_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS possession
      FROM m JOIN steps s USING (game_id, sequence_idx))"""


def split_possessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return S.with_possessions(events(spark, sf_dir), kind.isin("resource_spend", "zone_enter"), kind == "player_idle", (F.col("k") % 2).cast("string"))


@query(f"WITH RECURSIVE {EVENTS_SQL}{POSSESSIONS} SELECT game_id, sequence_idx, ends, possession FROM q")
def possessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_possessions(spark, sf_dir).select("game_id", "sequence_idx", "ends", "possession")


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}{POSSESSIONS} SELECT game_id, possession, min(sequence_idx) AS first_idx, max(sequence_idx) AS last_idx,
    arg_max(event_type, sequence_idx) AS terminal_type, arg_max(actor, sequence_idx) AS terminal_actor, count(*) AS n_plays FROM q GROUP BY ALL"""
)
def possession_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.possession_rows(split_possessions(spark, sf_dir))


@query(on_events("SELECT game_id, sequence_idx, actor, (sum(CASE WHEN event_type = 'player_idle' THEN 1 ELSE 0 END) OVER (PARTITION BY game_id, actor ORDER BY sequence_idx))::BIGINT AS fouls FROM ev"))
def running_fouls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.running_count(events(spark, sf_dir), F.col("event_type") == "player_idle", "fouls").select("game_id", "sequence_idx", "actor", "fouls")


@query(on_events("SELECT game_id, sequence_idx, value, before FROM (SELECT *, lag(value) OVER (PARTITION BY game_id ORDER BY sequence_idx) AS before FROM ev WHERE value IS NOT NULL) WHERE before IS NULL OR value < before - 1.0"))
def zone_shrinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shrinks(events(spark, sf_dir), "value").select("game_id", "sequence_idx", "value", "before")


@query(on_events("SELECT game_id, actor, sequence_idx, value FROM (SELECT *, lag(value) OVER (PARTITION BY game_id, actor ORDER BY sequence_idx) AS before FROM ev) WHERE before >= 25 AND value < 25"))
def low_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drops_below(events(spark, sf_dir), "value", 25.0, ["game_id", "actor"]).select("game_id", "actor", "sequence_idx", "value")


def actions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    move = F.when(kind == "player_idle", "deal").when(kind == "zone_enter", "fold").when(kind == "resource_spend", "raise").otherwise("call")
    return events(spark, sf_dir).select(F.col("game_id").alias("hand"), F.col("sequence_idx").alias("step"), (F.col("k") % 3).cast("int").alias("seat"), move.alias("move"), (F.col("k") * 3 % 400).alias("amount"))


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}, x AS (SELECT game_id AS hand, sequence_idx AS step, CAST(k % 3 AS INTEGER) AS seat, k * 3 % 400 AS amount,
      CASE event_type WHEN 'player_idle' THEN 'deal' WHEN 'zone_enter' THEN 'fold' WHEN 'resource_spend' THEN 'raise' ELSE 'call' END AS move FROM ev),
    f AS (
      SELECT hand, CAST(-1 AS BIGINT) AS step, 0 AS seat, '' AS move, CAST(0 AS BIGINT) AS added, [1000::BIGINT, 1000, 1000] AS stacks, [0::BIGINT, 0, 0] AS put, 0::BIGINT AS pot, 0::BIGINT AS bet
      FROM (SELECT DISTINCT hand FROM x)
      UNION ALL
      SELECT hand, step, seat, move, added,
        [CASE WHEN seat = 0 THEN greatest(0, stacks[1] - added) ELSE stacks[1] END, CASE WHEN seat = 1 THEN greatest(0, stacks[2] - added) ELSE stacks[2] END, CASE WHEN seat = 2 THEN greatest(0, stacks[3] - added) ELSE stacks[3] END],
        CASE WHEN move = 'deal' THEN [0::BIGINT, 0, 0] ELSE
          [CASE WHEN seat <> 0 THEN put[1] WHEN move = 'raise' THEN amount ELSE put[1] + added END, CASE WHEN seat <> 1 THEN put[2] WHEN move = 'raise' THEN amount ELSE put[2] + added END, CASE WHEN seat <> 2 THEN put[3] WHEN move = 'raise' THEN amount ELSE put[3] + added END] END,
        pot + added, CASE move WHEN 'raise' THEN amount WHEN 'deal' THEN 0 ELSE bet END
      FROM (SELECT f.hand, x.step, x.seat, x.move, x.amount, f.stacks, f.put, f.pot, f.bet,
              CASE x.move WHEN 'raise' THEN greatest(0, x.amount - f.put[x.seat + 1]) WHEN 'call' THEN least(greatest(0, f.bet - f.put[x.seat + 1]), f.stacks[x.seat + 1]) ELSE 0 END AS added
            FROM f JOIN x ON x.hand = f.hand AND x.step = f.step + 1))
    SELECT hand, step, seat, move, stacks[seat + 1] AS stack, pot, bet FROM f WHERE step >= 0"""
)
def stack_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every action of every hand."""
    return S.folded_stacks(actions_of(spark, sf_dir), 1000, 3)


@query(ORACLE_SQL["stack_fold"])
def stack_fold_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`stack_fold` under its former name."""
    return stack_fold(spark, sf_dir)


# --- streams ----------------------------------------------------------------------------------------------------------
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream: game_id, ts, place, event_type, actor, value."""
    held = spark.read.parquet(f"{sf_dir}/events.parquet")
    # A stream reads a folder: the table's own, or of a table of one file the one around it.
    alone = held.inputFiles()[0].endswith("/events.parquet")
    stream = spark.readStream.schema(held.schema).option("pathGlobFilter", "events.parquet" if alone else "*.parquet")
    raw = stream.parquet(sf_dir if alone else f"{sf_dir}/events.parquet")
    kinds = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    actor = F.concat(F.lit("player_"), (F.get_json_object("props", "$.k").cast("long") % 7).cast("string"))
    return raw.select(F.col("user_id").alias("game_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("place"), kinds[F.col("event_type")].alias("event_type"), actor.alias("actor"), "value")


#: Seconds without events after which a user's game is over: never.
NEVER = 10**9
#: Events of a state store.
STORE_EVENTS = 50_000


def stores_of(spark: SparkSession, sf_dir: str) -> int:
    return 2 + table(spark, sf_dir, "events").count() // STORE_EVENTS


@query(
    on_events("SELECT game_id, event_id AS place, actor, (sum(CASE WHEN event_type = 'player_idle' THEN 1 ELSE 0 END) OVER (PARTITION BY game_id, actor ORDER BY sequence_idx))::BIGINT AS n FROM ev").replace(
        "value,\n         (row_number()", "value, event_id,\n         (row_number()"
    )
)
def streamed_fouls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`running_fouls` of a stream in event time, with state and timers, until the watermark has passed all events."""
    return timed.drained(timed.in_event_order(event_stream(spark, sf_dir), timed.RunningCounts("player_idle"), 0, NEVER), "streamed-fouls", stores_of(spark, sf_dir))


@query(on_chains("SELECT game_id, chain_no, string_agg(event_type, ',' ORDER BY slot) AS types, string_agg(actor, ',' ORDER BY slot) AS actors FROM ch GROUP BY ALL"))
def streamed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of five events of a stream in event time."""
    found = timed.drained(timed.in_event_order(event_stream(spark, sf_dir), timed.CountWindows(5), 0, NEVER), "streamed-chains", stores_of(spark, sf_dir))
    return found.select("game_id", "chain_no", F.array_join("types", ",").alias("types"), F.array_join("actors", ",").alias("actors"))


# --- gate and pilot ---------------------------------------------------------------------------------------------------
GATED = f", g AS (SELECT cell, chain_id, count(*) AS n, count(*) FILTER ({ACTIONABLE}) AS n_actionable FROM ch GROUP BY ALL)"


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.gated(chains(spark, sf_dir), ["cell", "chain_id"])


@query(on_chains("SELECT cell, chain_id, n, n_actionable, n_actionable / n AS fraction, n_actionable / n >= 0.5 AS passed FROM g", GATED))
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir)


RETENTION = "SELECT cell, count(*) AS n_total, count(*) FILTER (n_actionable / n >= 0.5) AS n_passed, count(*) FILTER (n_actionable / n >= 0.5) / count(*) AS retention_rate, count(*) FILTER (n_actionable / n >= 0.5) / count(*) >= 0.5 AS gate_pass FROM g GROUP BY cell"


@query(on_chains(RETENTION, GATED))
def gate2_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.retention(gated(spark, sf_dir))


@query(
    on_chains(
        """SELECT cell, count(*) AS n_chains, count(DISTINCT game_id) AS n_games, avg(k_) AS mean_actionable, min(k_) AS min_actionable, max(k_) AS max_actionable, median(k_) AS median_actionable
        FROM (SELECT cell, game_id, chain_id, count(*) FILTER (event_type <> 'player_idle') AS k_ FROM ch GROUP BY ALL) GROUP BY cell"""
    )
)
def pilot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = stored(chains(spark, sf_dir).groupBy("cell", "game_id", "chain_id").agg(F.count_if(X.is_actionable(F.col("event_type"), F.col("cell"))).alias("k")), "actionable")
    sums = per.groupBy("cell").agg(
        F.count("*").alias("n_chains"), F.countDistinct("game_id").alias("n_games"), F.avg("k").alias("mean_actionable"), F.min("k").alias("min_actionable"), F.max("k").alias("max_actionable")
    )
    return sums.join(exact_quantiles(per, ["cell"], "k", {"median_actionable": 0.5}), "cell")


# --- samples ------------------------------------------------------------------------------------------------------------
ORDERED = ", o AS (SELECT DISTINCT cell, game_id, chain_no, chain_id FROM ch), r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY game_id, chain_no) - 1 AS pos, count(*) OVER (PARTITION BY cell) AS n FROM o)"


def one_per_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains(spark, sf_dir).where("slot = 0").select("cell", "game_id", "chain_no", "chain_id")


@query(on_chains("SELECT cell, game_id, chain_no, chain_id FROM r WHERE pos < 100", ORDERED))
def cap_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.capped(one_per_chain(spark, sf_dir), "cell", ["game_id", "chain_no"], 100)


@query(on_chains("SELECT DISTINCT cell, game_id, chain_no, chain_id FROM r JOIN (SELECT unnest(range(0, 37)) AS i) ON CAST(floor(i * n / 37) AS BIGINT) = pos OR n <= 37", ORDERED))
def uniform_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.evenly(one_per_chain(spark, sf_dir), "cell", ["game_id", "chain_no"], 37)


@query(on_chains("SELECT cell, game_id, chain_no, chain_id FROM r WHERE pos < 30 ORDER BY game_id, chain_no LIMIT 120", ORDERED))
def stratified_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stratified(one_per_chain(spark, sf_dir), "cell", ["game_id", "chain_no"], 30, 120)


@query(
    on_chains(
        """SELECT n.chain_id, n.slot, n.from_slot, n.event_type, t.t_us FROM (
          SELECT chain_id, slot AS from_slot, event_type, row_number() OVER (PARTITION BY chain_id ORDER BY CAST('0x' || substr(md5('42:' || chain_id || ':0:' || slot), 1, 8) AS BIGINT), slot) - 1 AS slot FROM ch) n
        JOIN ch t ON t.chain_id = n.chain_id AND t.slot = n.slot"""
    )
)
def hash_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = chains(spark, sf_dir).select("chain_id", "slot", "event_type", F.col("t_us").alias("timestamp"))
    return C.shuffled(held).select("chain_id", "slot", "from_slot", "event_type", F.col("timestamp").alias("t_us"))


# --- identifiers and text --------------------------------------------------------------------------------------------------
@query(on_chains("SELECT DISTINCT chain_id, game_id, chain_no FROM ch"))
def chain_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_per_chain(spark, sf_dir).select("chain_id", "game_id", "chain_no")


@query("SELECT c_custkey, CASE WHEN CAST('0x' || substr(md5(c_mktsegment || c_custkey), 1, 2) AS INTEGER) % 2 = 0 THEN 'team_A' ELSE 'team_B' END AS team FROM customer")
def team_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.team_slot(F.concat("c_mktsegment", F.col("c_custkey").cast("string"))).alias("team"))


PLAYERS = """, f AS (SELECT chain_id, actor, min(slot) AS first FROM ch GROUP BY ALL),
pl AS (SELECT chain_id, actor, 'Player_' || (row_number() OVER (PARTITION BY chain_id ORDER BY first) - 1) AS player FROM f)"""


@query(on_chains("SELECT ch.chain_id, slot, player FROM ch JOIN pl USING (chain_id, actor)", PLAYERS))
def anonymous_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.anonymous(chains(spark, sf_dir)).select("chain_id", "slot", "player")


@query(
    on_chains(
        """SELECT chain_id, cell, string_agg(printf('%3d. t=%7.1fs | %-22s | actor=%-12s | k=%d', CAST(slot AS INTEGER), t_us / 1e6, event_type, player, k), chr(10) ORDER BY slot) AS text
        FROM ch JOIN pl USING (chain_id, actor) GROUP BY ALL""",
        PLAYERS,
    )
)
def rendered_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = chains(spark, sf_dir).withColumns({"timestamp": F.col("t_us") / 1e6, "context": F.concat(F.lit("k="), F.col("k").cast("string"))})
    return C.rendered(held)


def by_cell(values: dict[str, str]) -> str:
    """A text per cell as SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"CASE cell {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in values.items())} END"


def prompts_sql(question: str) -> str:
    asked = by_cell({c: question % d for c, d in V.DOMAIN.items()})
    between = "chr(10) || chr(10)"
    return f"SELECT *, text || {between} || {asked} AS baseline, {by_cell(V.RULES)} || {between} || text || {between} || {asked} AS intervention FROM ({ORACLE_SQL['rendered_chains']})"


@query(prompts_sql(V.QUESTION))
def chain_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prompts(rendered_chains(spark, sf_dir))


@query(prompts_sql(V.IGNORE_TIMES + V.DIAGNOSTIC))
def diagnostic_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any event breaks a rule, times left aside."""
    return C.prompts(rendered_chains(spark, sf_dir), "diagnostic", ignore_times=True)


@query("SELECT conv_id, turn, CASE WHEN length(text) > 32 THEN substr(text, 1, 29) || '...' ELSE text END AS short FROM conversations")
def short_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.short_value(F.col("text")).alias("short"))


@query("SELECT event_id, printf('%.1f', value) AS one, printf('%.2f', value) AS two, printf('%8.3f', (event_id % 4096) / 16.0::DOUBLE) AS three, printf('%.0f', (event_id % 64) / 2.0::DOUBLE) AS none FROM events")
def fixed_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as rendered: exact binary values, ties to even."""
    id = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", fixed(F.col("value"), 1).alias("one"), fixed(F.col("value"), 2).alias("two"), fixed((id % 4096) / 16, 3, 8).alias("three"), fixed((id % 64) / 2).alias("none")
    )


# --- planted violations ------------------------------------------------------------------------------------------------------
@query(
    on_chains(
        """SELECT chain_id || '_adv' AS chain_id, slot, CASE WHEN slot = 0 THEN 'engage_decision' ELSE event_type END AS event_type,
        CASE WHEN slot = 0 THEN who END AS eliminates, CASE WHEN slot > 0 THEN who END AS already_out
        FROM (SELECT *, arg_max(actor, slot) OVER (PARTITION BY chain_id) AS who FROM ch)"""
    )
)
def inject_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.eliminated_acts(chains(spark, sf_dir)).select("chain_id", "slot", "event_type", "eliminates", "already_out")


REPEATS = """, ra AS (SELECT chain_id, actor AS who, min(slot) AS first_slot, max(slot) AS last_slot FROM ch GROUP BY ALL HAVING count(*) > 1),
rp AS (SELECT * FROM ra QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY first_slot) = 1)"""


@query(
    on_chains(
        """SELECT chain_id || '_adv' AS chain_id, slot, CASE WHEN actor = who AND slot > first_slot THEN 'engage_decision' ELSE event_type END AS event_type,
        actor = who AND slot = first_slot AS folded, actor = who AND slot > first_slot AS already_folded FROM ch JOIN rp USING (chain_id)""",
        REPEATS,
    )
)
def inject_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.repeats_after(chains(spark, sf_dir), "folded", "engage_decision").select("chain_id", "slot", "event_type", "folded", "already_folded")


@query(on_chains("SELECT chain_id || '_adv' AS chain_id, slot, CASE WHEN slot = 1 THEN 'objective_capture' ELSE event_type END AS event_type, slot = 1 AS goal, slot > 1 AS pre_goal_state FROM ch"))
def inject_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.goal_persists(chains(spark, sf_dir)).select("chain_id", "slot", "event_type", "goal", "pre_goal_state")


@query(
    on_chains(
        """SELECT chain_id || '_adv' AS chain_id, slot, CASE WHEN slot = hit THEN who ELSE actor END AS actor, CASE WHEN slot = hit OR slot = 4 THEN 7 END AS fouls, CASE WHEN slot = hit THEN 'Foul' END AS terminal
        FROM (SELECT *, coalesce(min(slot) FILTER (actor = who AND slot < 4) OVER (PARTITION BY chain_id), 3) AS hit FROM (SELECT *, arg_max(actor, slot) OVER (PARTITION BY chain_id) AS who FROM ch))"""
    )
)
def inject_foul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.foul_out(chains(spark, sf_dir)).select("chain_id", "slot", "actor", "fouls", "terminal")


@query(on_chains("SELECT chain_id || '_adv' AS chain_id, slot, CASE WHEN slot = last_slot THEN first_k + 50 ELSE k END AS k FROM ch JOIN rp USING (chain_id) JOIN (SELECT chain_id, slot AS first_slot, k AS first_k FROM ch) USING (chain_id, first_slot)", REPEATS))
def inject_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.stack_grows(chains(spark, sf_dir), "k").select("chain_id", "slot", "k")


@query(on_chains("SELECT chain_id || '_adv' AS chain_id, slot, CASE WHEN slot = coalesce((min(slot) FILTER (k > 5) OVER (PARTITION BY chain_id)), 2) THEN 2 * k + 10 ELSE 0 END AS bet FROM ch"))
def inject_overbet(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = chains(spark, sf_dir).withColumn("bet", F.lit(0).cast("long"))
    return I.overbet(held, "k").select("chain_id", "slot", F.col("bet").cast("long").alias("bet"))


@query(on_chains("SELECT chain_id || '_adv' AS chain_id, slot, CASE WHEN slot = 4 THEN 99 ELSE period END AS round, CASE WHEN slot = 3 THEN who END AS demolishes FROM (SELECT *, arg_max(actor, slot) OVER (PARTITION BY chain_id) AS who FROM ch)"))
def inject_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = I.demolished_acts(chains(spark, sf_dir).withColumn("round", F.col("period")))
    return I.impossible_round(held).select(F.regexp_replace("chain_id", "_adv_adv$", "_adv").alias("chain_id"), "slot", "round", "demolishes")


# --- answers and pairs -------------------------------------------------------------------------------------------------------
@query(on_chains("SELECT chain_id, baseline, intervention FROM ans", LABELS))
def mock_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("chain_id", "baseline", "intervention")


#: A document's text without the white space around it, and its first line.
TRIMMED = "trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')"
FIRST = "lower(trim(regexp_split_to_array(s, '\\r\\n|\\n|\\r')[1], ' '))"
STRICT = rf"""SELECT doc_id, CASE WHEN text IS NULL OR s = '' OR regexp_matches(s, '(?i)^\s*(i\s*don''?t\s*know|abstain|n/?a|unknown|cannot\s*determine|insufficient|no\s*answer|skip)\s*\.?\s*$') THEN ''
      WHEN starts_with(s, '{{') AND ends_with(s, '}}') AND json_valid(s) AND coalesce(s ->> '$.answer', s ->> '$.prediction', s ->> '$.response', s ->> '$.value') IS NOT NULL
        THEN lower(trim(coalesce(s ->> '$.answer', s ->> '$.prediction', s ->> '$.response', s ->> '$.value'), ' '))
      WHEN regexp_replace({FIRST}, '[.!?,]+$', '') IN ('yes', 'no') THEN regexp_replace({FIRST}, '[.!?,]+$', '') ELSE '' END AS parsed
    FROM (SELECT doc_id, text, {TRIMMED} AS s FROM documents)"""
LENIENT = f"SELECT doc_id, CASE WHEN starts_with(f, 'yes') THEN 'yes' WHEN starts_with(f, 'no') THEN 'no' END AS parsed FROM (SELECT doc_id, lower(trim(split_part(s, chr(10), 1), ' ')) AS f FROM (SELECT doc_id, {TRIMMED} AS s FROM documents))"


@query(STRICT)
def parse_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text as an answer."""
    return table(spark, sf_dir, "documents").select("doc_id", X.parse_strict(F.col("text"), ("yes", "no")).alias("parsed"))


@query(LENIENT)
def parse_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text as an answer."""
    return table(spark, sf_dir, "documents").select("doc_id", X.parse_lenient(F.col("text")).alias("parsed"))


@query(STRICT)
def parse_strict_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`parse_strict` under its former name."""
    return parse_strict(spark, sf_dir)


@query(LENIENT)
def parse_lenient_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`parse_lenient` under its former name."""
    return parse_lenient(spark, sf_dir)


@query(on_chains("""SELECT CAST(chain_no AS BIGINT) AS "index", chain_id AS chain, baseline, intervention FROM ans""", LABELS))
def custom_id_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = answers(spark, sf_dir)
    rows = made.select("chain_no", "chain_id", F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(v).alias("text")) for v in ("baseline", "intervention")))).alias("x"))
    return P.paired(rows.select(X.custom_id(F.col("chain_no"), F.col("chain_id"), F.col("x.variant")).alias("custom_id"), "x.text"))


LEDGER = """, q AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY game_id, chain_no) - 1 AS i FROM ans),
an AS (SELECT cell, i AS "index", chain_id, CASE WHEN i % 11 = 5 THEN '' ELSE baseline END AS baseline_raw, CASE WHEN i % 11 = 5 OR i % 13 = 7 THEN '' ELSE intervention END AS intervention_raw FROM q)"""


@query(on_chains("""SELECT cell, "index", chain_id, baseline_raw, intervention_raw, baseline_raw = '' AND intervention_raw = '' AS missing FROM an""", LABELS + LEDGER))
def ledger_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs from a ledger whose first run ends early, whose second one meets errors, and of which some requests never succeed."""
    chains_ = answers(spark, sf_dir).select("cell", "game_id", "chain_no", "chain_id", F.lit("b").alias("baseline"), F.lit("i").alias("intervention"))
    book = ledger.Ledger(spark, f"{session_dir(spark)}/ledger-{uuid.uuid4().hex}")
    book.register(ledger.requests_of(chains_, ["game_id", "chain_no"], 1_000))
    parts = X.custom_id_parts(F.col("custom_id"))
    never = (parts["index"] % 11 == 5) | ((parts["index"] % 13 == 7) & (parts["variant"] == "intervention"))

    def answer(run: int) -> Callable[[DataFrame], DataFrame]:
        later = never | (F.lit(run < 2) & (parts["index"] % 3 == run))
        return lambda part: part.where(F.lit(run > 0) | (F.col("batch") < 2)).select("cell", "custom_id", F.when(later, "errored").otherwise("succeeded").alias("type"), X.dry_label(parts["chain"], parts["variant"]).alias("text"))

    for run in range(3):
        book.run(answer(run), attempts=run + 1)
    return book.pairs()


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def missing_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(have, "o_orderkey", "left_anti")


@query(on_chains("SELECT chain_id, slot, event_type FROM ch WHERE chain_id IN (SELECT chain_id FROM ans WHERE chain_no % 2 = 1 AND intervention = 'YES')", LABELS))
def false_positive_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = answers(spark, sf_dir).where("chain_no % 2 = 1 and intervention = 'YES'").select("chain_id")
    return chains(spark, sf_dir).select("chain_id", "slot", "event_type").join(wrong, "chain_id", "left_semi")


@query(
    "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE coalesce(c_mktsegment, '') END AS text FROM orders LEFT JOIN customer ON o_custkey = c_custkey"
)
def answered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("custom_id"))
    responses = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("custom_id"), F.col("c_mktsegment").alias("text"))
    return P.answered(requests, responses).select("o_orderkey", F.col("custom_id").alias("o_custkey"), "text")


# --- statistics ---------------------------------------------------------------------------------------------------------------
def tables_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.contingency(answers(spark, sf_dir), ["cell"])


@query(on_chains("SELECT * FROM ct", LABELS))
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_of(spark, sf_dir)


@query(
    on_chains(
        "SELECT cell, b, c, CASE WHEN b + c = 0 THEN 0.0 ELSE CAST(power(abs(b - c) - 1, 2) AS DOUBLE) / (b + c) END AS statistic, round(2 * (asin(sqrt(c / n)) - asin(sqrt(b / n))), 9) AS h, b + c < 10 AS few FROM ct", LABELS
    )
)
def mcnemar_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_of(spark, sf_dir).select("cell", "b", "c", P.statistic().alias("statistic"), F.round(P.effect(), 9).alias("h"), ((F.col("b") + F.col("c")) < V.MIN_DISCORDANT).alias("few"))


@query(
    """WITH t AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS b, count(*) FILTER (o_orderstatus = 'O') AS c FROM orders GROUP BY 1)
    SELECT o_custkey, b, c, CASE WHEN b + c = 0 THEN 1.0 WHEN b + c < 25 THEN round(least(1.0, 2 * (SELECT sum(factorial(CAST(b + c AS INTEGER))::DOUBLE / factorial(CAST(i AS INTEGER))::DOUBLE / factorial(CAST(b + c - i AS INTEGER))::DOUBLE)
      FROM (SELECT unnest(range(0, least(b, c) + 1)) AS i)) / power(2.0, b + c)), 9) END AS p FROM t"""
)
def exact_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("b"), F.count_if(F.col("o_orderstatus") == "O").alias("c"))
    return per.withColumn("p", F.round(P.exact_p(), 9))


@query(on_chains("SELECT cell, n, a, b, c, d FROM ct UNION ALL SELECT NULL, sum(n)::BIGINT, sum(a)::BIGINT, sum(b)::BIGINT, sum(c)::BIGINT, sum(d)::BIGINT FROM ct", LABELS))
def pooled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pooled(answers(spark, sf_dir), "cell")


@query(
    on_chains(
        """, h AS (SELECT cell, round((c - b) / n, 9) AS "primary" FROM ct), k AS (SELECT cell, round((b - c) / n + 0.1, 9) AS control FROM ct)
        SELECT cell, "primary", control, CASE WHEN abs("primary") >= 0.01 THEN round(abs(control) / abs("primary"), 9) END AS ratio,
        coalesce(sign("primary") = sign(control) AND abs("primary") >= 0.01 AND abs(control) / abs("primary") > 0.5, false) AS suspected FROM h JOIN k USING (cell)""",
        LABELS,
    ).replace("GROUP BY cell) ,", "GROUP BY cell),")
)
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tables_of(spark, sf_dir).select("cell", F.round((F.col("c") - F.col("b")) / F.col("n"), 9).alias("primary"), F.round((F.col("b") - F.col("c")) / F.col("n") + 0.1, 9).alias("control"))
    return P.leakage(made).withColumn("ratio", F.round("ratio", 9))


@query(
    on_chains(
        """SELECT cell, chain_no % 2 = 0 AS planted, count(*) AS n, count(*) FILTER (baseline = 'YES') / count(*) AS base_rate, count(*) FILTER (intervention = 'YES') / count(*) AS int_rate,
        count(*) FILTER (baseline = 'YES' AND intervention = 'YES') AS both_yes, count(*) FILTER (baseline = 'NO' AND intervention = 'NO') AS both_no FROM ans GROUP BY ALL""",
        LABELS,
    )
)
def rates_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("baseline") == "YES", F.col("intervention") == "YES"
    made = answers(spark, sf_dir).withColumn("planted", F.col("chain_no") % 2 == 0)
    return made.groupBy("cell", "planted").agg(F.count("*").alias("n"), (F.count_if(x) / F.count("*")).alias("base_rate"), (F.count_if(y) / F.count("*")).alias("int_rate"), F.count_if(x & y).alias("both_yes"), F.count_if(~x & ~y).alias("both_no"))


@query("SELECT lang, count(*) AS n, round(avg(q), 9) AS share, round(stddev_pop(q), 9) AS deviation, round(stddev_pop(q) / sqrt(count(*)), 9) AS error FROM (SELECT lang, coalesce(quality, 0) AS q FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang")
def variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstaining (unlabelled) counts as wrong here, unlike in the contingency."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("lang", F.coalesce("quality", F.lit(0)).alias("q"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("q"), 9).alias("share"), F.round(F.stddev_pop("q"), 9).alias("deviation"), F.round(F.stddev_pop("q") / F.sqrt(F.count("*")), 9).alias("error"))


@query()
def mcnemar_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p by erfc, which SQL lacks, and what follows from it."""
    rows = tables_of(spark, sf_dir).withColumns({"statistic": P.statistic(), "h": P.effect()})
    return P.with_power(P.corrected(P.with_p(rows)))


@query()
def interim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = C.first_share(answers(spark, sf_dir), "cell", ["game_id", "chain_no"], 0.5)
    return P.interim(P.contingency(half, ["cell"]))


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("lang").alias("cell"), "doc_id", (F.col("quality") == 1).alias("intervention_ok"), F.lit(False).alias("baseline_ok"))


@query(
    """WITH p AS (SELECT lang AS cell, doc_id, quality AS v, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents JOIN labels USING (doc_id)),
    d AS (SELECT cell, it, CAST('0x' || substr(md5('42:' || it || ':' || cell || ':' || pos), 1, 12) AS BIGINT) % n AS pos FROM p, (SELECT unnest(range(0, 50)) AS it)),
    m AS (SELECT cell, it, avg(CAST(p.v AS DOUBLE)) AS delta FROM d JOIN p USING (cell, pos) GROUP BY ALL)
    SELECT cell, round(quantile_cont(delta, 0.025), 9) AS lo, round(quantile_cont(delta, 0.975), 9) AS hi FROM m GROUP BY cell"""
)
def keyed_resamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of 50 resamples drawn by keyed hashes, which SQL can draw too; `bootstrap_interval` draws 10,000."""
    found = P.bootstrap(labelled_pairs(spark, sf_dir), "cell", "doc_id", iterations=50)
    return found.select("cell", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


@query()
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of 10,000 resamples, drawn by counts; tested against resamples one by one."""
    return H.resampled(P.contingency(labelled_pairs(spark, sf_dir), ["cell"])).select("cell", "lo", "hi")


@query()
def bootstrap_interval_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`bootstrap_interval` under its former name."""
    return bootstrap_interval(spark, sf_dir)


@query()
def second_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p by the exact test or chi square, as pairs are few or many, and the interval of 5,000 resamples' order statistics."""
    return H.ordered_bounds(P.with_chosen_p(tables_of(spark, sf_dir)))


# --- distributions ---------------------------------------------------------------------------------------------------------------
@query(on_events("SELECT cell, event_type, n, f[1] AS first_game, f[2] AS first_idx FROM (SELECT cell, event_type, count(*) AS n, min([game_id, sequence_idx]) AS f FROM ev GROUP BY ALL)"))
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type, and the first one by game and place."""
    per = events(spark, sf_dir).groupBy("cell", "event_type").agg(F.count("*").alias("n"), F.min(F.struct("game_id", "sequence_idx")).alias("f"))
    return per.select("cell", "event_type", "n", F.col("f.game_id").alias("first_game"), F.col("f.sequence_idx").alias("first_idx"))


@query(on_events("SELECT cell, max(n) / sum(n) AS top_share, max(n) / sum(n) > 0.8 AS dominant FROM (SELECT cell, event_type, count(*) AS n FROM ev GROUP BY ALL) GROUP BY cell"))
def dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = events(spark, sf_dir).groupBy("cell", "event_type").agg(F.count("*").alias("n"))
    share = F.max("n") / F.sum("n")
    return per.groupBy("cell").agg(share.alias("top_share"), (share > 0.8).alias("dominant"))


@query(f"WITH {EVENTS_SQL}{PLAYS} SELECT cell, avg(n) AS mean, min(n) AS least, max(n) AS most, median(n) AS median FROM (SELECT cell, game_id, play, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 2) GROUP BY cell")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = W.with_plays(events(spark, sf_dir), "resource_spend").groupBy("cell", "game_id", "play").agg(F.count("*").alias("n")).where("n >= 2")
    per = stored(per, "lengths")
    sums = per.groupBy("cell").agg(F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))
    return sums.join(exact_quantiles(per, ["cell"], "n", {"median": 0.5}), "cell")


@query(
    on_events(
        """SELECT cell, sum((event_type = 'engage_decision')::INT) / count(*) AS engage_decision, sum((event_type = 'position_commit')::INT) / count(*) AS position_commit, sum((event_type = 'resource_spend')::INT) / count(*) AS resource_spend,
        sum((event_type = 'zone_enter')::INT) / count(*) AS zone_enter, sum((event_type = 'player_idle')::INT) / count(*) AS player_idle FROM ev GROUP BY cell"""
    )
)
def type_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["engage_decision", "position_commit", "resource_spend", "zone_enter", "player_idle"]
    made = events(spark, sf_dir).groupBy("cell").pivot("event_type", kinds).count().na.fill(0, kinds)
    total = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    return made.select("cell", *[(F.col(k) / total).alias(k) for k in kinds])


@query("SELECT lang, rule, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, rule) AS r FROM (SELECT lang, substr(text, 1, 120) AS rule, count(*) AS n FROM documents GROUP BY 1, 2)) WHERE r <= 10")
def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "documents").groupBy("lang", F.substring("text", 1, 120).alias("rule")).agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "rule"))
    return per.withColumn("r", best).where("r <= 10").drop("r")


@query(on_events("SELECT cell, count(*) - count(DISTINCT substr(md5(actor || '__' || event_type || '_' || sequence_idx), 1, 16)) AS n_repeated FROM ev GROUP BY cell"))
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = X.chain_id(F.col("actor"), F.concat("event_type", F.lit("_"), F.col("sequence_idx").cast("string")))
    return events(spark, sf_dir).groupBy("cell").agg((F.count("*") - F.countDistinct(made)).alias("n_repeated"))


@query(on_chains("SELECT chain_id, string_agg(event_type, ',' ORDER BY slot) AS types, count(DISTINCT actor) AS n_actors, min(t_us) AS t_start, max(t_us) AS t_end FROM ch GROUP BY chain_id"))
def chain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = chains(spark, sf_dir).groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("slot", "event_type"))).alias("x"), F.countDistinct("actor").alias("n_actors"), F.min("t_us").alias("t_start"), F.max("t_us").alias("t_end"))
    return per.select("chain_id", F.array_join(F.transform("x", lambda e: e["event_type"]), ",").alias("types"), "n_actors", "t_start", "t_end")


@query(on_events("SELECT cell, count(DISTINCT game_id) AS games, count(*) AS events, count(*) / count(DISTINCT game_id) AS per_game, floor(count(*) / 8) * 0.5 AS usable, ceil(1200 / (floor(count(*) / 8) * 0.5)) AS scale_up FROM ev GROUP BY cell"))
def chain_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = F.floor(F.count("*") / 8) * F.lit(0.5).cast("double")
    return events(spark, sf_dir).groupBy("cell").agg(
        F.countDistinct("game_id").alias("games"), F.count("*").alias("events"), (F.count("*") / F.countDistinct("game_id")).alias("per_game"), usable.alias("usable"), F.ceil(F.lit(1200.0) / usable).cast("double").alias("scale_up")
    )


@query("SELECT lang, count(*) AS calls, sum(n_chars // 4)::BIGINT AS tokens_in, count(*) * 30 AS tokens_out, round(sum(n_chars // 4) * 0.25 / 1e6 + count(*) * 30 * 1.25 / 1e6, 9) AS cost FROM documents GROUP BY lang")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.sum(F.floor(F.col("n_chars") / 4))
    cost = F.round(tokens * 0.25 / 1e6 + F.count("*") * 30 * 1.25 / 1e6, 9)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("calls"), tokens.cast("long").alias("tokens_in"), (F.count("*") * 30).alias("tokens_out"), cost.alias("cost"))


# --- whole runs --------------------------------------------------------------------------------------------------------------------
CANDIDATES = f""", tw AS (SELECT DISTINCT game_id, greatest(0, least(greatest(0, sequence_idx - 4), n_game - 8)) AS start FROM ev
    WHERE cell = 'pubg' AND event_type IN ('zone_enter', 'position_commit') AND n_game >= 2),
pl AS (SELECT *, coalesce(sum((event_type = 'resource_spend')::INT) OVER (PARTITION BY game_id ORDER BY sequence_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS play FROM ev WHERE cell = 'rocket_league'),
cd AS (
  SELECT cell, ev.game_id, 'zone_' || start AS tag, sequence_idx - start AS slot, event_type FROM tw JOIN ev ON ev.game_id = tw.game_id AND sequence_idx BETWEEN start AND start + 7
  UNION ALL SELECT cell, game_id, 'nba_q' || period || '_p' || ((row_number() OVER (PARTITION BY game_id, period ORDER BY sequence_idx) - 1) // 5), (row_number() OVER (PARTITION BY game_id, period ORDER BY sequence_idx) - 1) % 5, event_type FROM ev WHERE cell = 'nba'
  UNION ALL SELECT cell, game_id, 'cs_r' || (k % 12 - 1), row_number() OVER (PARTITION BY game_id, k % 12 ORDER BY sequence_idx) - 1, event_type FROM ev WHERE cell = 'csgo' AND k % 12 >= 1
  UNION ALL SELECT cell, game_id, 'rl_play' || play, row_number() OVER (PARTITION BY game_id, play ORDER BY sequence_idx) - 1, event_type FROM pl
  UNION ALL SELECT cell, game_id, 'hand', sequence_idx, event_type FROM ev WHERE cell = 'poker' AND n_game >= 3 AND sequence_idx < 8),
cn AS (SELECT *, substr(md5(game_id || '__' || tag), 1, 16) AS parent, count(*) OVER (PARTITION BY game_id, tag) AS n,
         CASE cell WHEN 'nba' THEN 5 WHEN 'csgo' THEN 10 WHEN 'rocket_league' THEN 12 ELSE 8 END AS size FROM cd),
fx AS (SELECT cell, game_id, parent || '_sub' || lpad(CAST(slot // size AS VARCHAR), 3, '0') AS chain_id, count(*) FILTER ({ACTIONABLE}) AS n_actionable, count(*) AS n
       FROM cn WHERE (slot // size + 1) * size <= n GROUP BY ALL)"""
CUTS = {"rocket_league": lambda e: H.by_goal(e, "resource_spend")}


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    made = events(spark, sf_dir).withColumns({"round": F.col("k") % 12 - 1, "phase": none, "actor_team": none, "context": F.to_json(F.struct("k", F.col("period").alias("period")))})
    return made.drop("t_us", "value", "k")


@query(on_events("SELECT * FROM fx").replace("events) SELECT", f"events){CANDIDATES} SELECT"))
def translated_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's own cut, then its fixed length."""
    found = H.fixed_chains(H.candidates(run_events(spark, sf_dir), cuts=CUTS))
    return found.groupBy("cell", "game_id", "chain_id").agg(F.count_if(X.is_actionable(F.col("event_type"), F.col("cell"))).alias("n_actionable"), F.count("*").alias("n"))


@query(
    on_events("SELECT cell, n_chains_raw, n_chains_post_gate, length_mean, length_median, retention_rate FROM pt").replace(
        "events) SELECT",
        f"""events){CANDIDATES},
        pc AS (SELECT cell, game_id, parent, count(*) AS len, count(*) FILTER ({ACTIONABLE}) / count(*) AS share FROM cn WHERE cell <> 'nba' OR n = 5 GROUP BY ALL HAVING count(*) >= 2),
        pt AS (SELECT cell, count(*) AS n_chains_raw, count(*) FILTER (share >= 0.5) AS n_chains_post_gate, avg(len) FILTER (share >= 0.5) AS length_mean,
               median(len) FILTER (share >= 0.5) AS length_median, count(*) FILTER (share >= 0.5) / count(*) AS retention_rate FROM pc GROUP BY cell) SELECT""",
    )
)
def pilot_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.pilot(run_events(spark, sf_dir), cuts=CUTS).select("cell", "n_chains_raw", "n_chains_post_gate", "length_mean", "length_median", "retention_rate")


@query()
def consistency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run with the deterministic stand-in: real and shuffled chains, tests, leak check. SQL lacks erfc."""
    return H.consistency_run(run_events(spark, sf_dir))


@query()
def cell_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept chain in its cell's own lines; tests hold the lines against hand-made ones."""
    kept = H.passing(H.fixed_chains(H.candidates(run_events(spark, sf_dir), cuts=CUTS)))
    return C.prompts(H.rendered(kept))


#: Games per cell of the synthetic pilot.
PILOT_GAMES = {"fortnite": 200, "nba": 300, "csgo": 150, "rocket_league": 250}


@query()
def synthetic_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic streams of four cells cut by sliding windows of 5 every 3 events; tests know the counts."""
    made = synthetic.streams_of(spark, PILOT_GAMES)
    cut = W.sliding(made, X.is_actionable(F.col("event_type"), F.col("cell")))
    cell = F.regexp_extract("game_id", "^(.*)_mock_", 1).alias("cell")
    chains = cut.groupBy(cell).agg(F.count("*").alias("n_chains"), F.sum("n_actionable").alias("n_actionable"))
    return made.groupBy("cell").agg(F.countDistinct("game_id").alias("n_streams"), F.count("*").alias("n_events")).join(chains, "cell")


#: Corrected for five cells at 0.05: p is below 0.01 from this chi square on.
AT_ONE_PERCENT = 6.634896601021214


@query(
    on_chains(
        f"""SELECT count(*) AS n_cells, count(*) FILTER (x > {AT_ONE_PERCENT}) AS n_cells_significant, sum(n)::BIGINT AS total_chains, sum(b + c)::BIGINT AS total_discordant,
        CASE WHEN sum(b + c) = 0 THEN 0.0 ELSE round(power(abs(sum(b) - sum(c)) - 1, 2)::DOUBLE / sum(b + c)::DOUBLE, 9) END AS pooled_chi2
        FROM (SELECT *, CASE WHEN b + c = 0 THEN 0 ELSE power(abs(b - c) - 1, 2)::DOUBLE / (b + c) END AS x FROM ct)""",
        LABELS,
    )
)
def pooled_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells' tests together; the pooled p and the lines of the cells, which SQL lacks, are tested by hand."""
    told = P.aggregate(H.tested(answers(spark, sf_dir)))
    return told.select("n_cells", "n_cells_significant", "total_chains", "total_discordant", F.round("pooled_chi2", 9).alias("pooled_chi2"))


@query(
    on_events(
        f"""{CANDIDATES}, st AS (SELECT cell, count(DISTINCT game_id) AS n_streams, count(*) AS n_events FROM ev GROUP BY cell),
        rg AS (SELECT unnest(['pubg', 'nba', 'poker', 'fortnite']) AS cell),
        cc AS (SELECT cell, count(*) AS n_candidates FROM cn WHERE cell IN ('pubg', 'nba') AND slot = 0 AND (cell <> 'nba' OR n = 5) GROUP BY cell)
        SELECT cell, rg.cell IS NOT NULL AS registered, coalesce(n_streams, 0) AS n_streams, coalesce(n_events, 0) AS n_events, coalesce(n_candidates, 0) AS n_candidates,
          CASE WHEN rg.cell IS NULL THEN 'no cut is registered' WHEN cell = 'poker' THEN 'its cut isn''t there yet' WHEN n_streams IS NULL THEN 'no streams' ELSE '' END AS errors
        FROM rg FULL JOIN st USING (cell) LEFT JOIN cc USING (cell)"""
    ).replace("events) ,", "events),")
)
def cell_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with a cut and streams, with a cut only, with streams only, and one whose cut isn't there."""
    _, told = H.run_cells(run_events(spark, sf_dir), {"pubg": H.around_triggers, "nba": H.by_period, "poker": H.not_ready, "fortnite": H.around_triggers})
    return told.withColumn("errors", F.array_join("errors", ", "))


# --- files and records ---------------------------------------------------------------------------------------------------------------
@query(on_events("SELECT CAST(game_id AS VARCHAR) AS game_id, CAST(part AS BIGINT) AS part, count(*) AS lines FROM (SELECT game_id, sequence_idx // 50 AS part FROM ev UNION ALL SELECT DISTINCT game_id, 0 FROM ev) GROUP BY ALL"))
def bucketed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every game's parts in the manifest of bucketed event lines, counted from the lines that the manifest leads to."""
    path = f"{session_dir(spark)}/bucketed-{uuid.uuid4().hex}"
    made = events(spark, sf_dir).select("game_id", "cell", "sequence_idx", "event_type", "actor")
    manifest = buckets.write_bucketed(made, path, 1 << 20, 50)
    lines = spark.read.text(f"{path}/lines").groupBy(F.get_json_object("value", "$.game_id").alias("game_id"), F.floor(F.coalesce(F.get_json_object("value", "$.sequence_idx").cast("long"), F.lit(0)) / 50).alias("part")).agg(F.count("*").alias("lines"))
    return manifest.select("game_id", "part").join(lines, ["game_id", "part"])


@query(
    on_events(
        """, m AS (SELECT cell = 'poker' AND k % 17 = 3 AS nameless, cell = 'poker' AND k % 13 = 2 AS misplaced FROM ev)
        SELECT cause, count(*) AS n FROM (SELECT CASE WHEN nameless THEN 'no game id' WHEN misplaced THEN 'bad place' ELSE 'good' END AS cause FROM m) GROUP BY cause"""
    ).replace("events) ,", "events),")
)
def quarantined_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good events and rejected ones by cause; together they are all that came in."""
    bad = lambda n, rest: (F.col("cell") == "poker") & (F.col("k") % n == rest)
    made = events(spark, sf_dir).withColumns({"game_id": F.when(~bad(17, 3), F.col("game_id")), "sequence_idx": F.when(bad(13, 2), F.lit(-1)).otherwise(F.col("sequence_idx"))})
    found = quarantine.checked_events(made)
    if sum(n for name, n in found.counts.items() if name != "read") != found.counts["read"]:
        raise ValueError("the counts of a pass don't add up")
    return found.good.select(F.lit("good").alias("cause")).unionByName(found.rejected.select("cause")).groupBy("cause").agg(F.count("*").alias("n"))


@query(on_events("SELECT cell, stage, rows FROM (SELECT cell, 'events' AS stage, count(*) AS rows FROM ev GROUP BY cell UNION ALL SELECT cell, 'chains', sum(n // 5)::BIGINT FROM (SELECT cell, game_id, count(*) AS n FROM ev GROUP BY ALL) GROUP BY cell UNION ALL SELECT cell, 'events of types', count(*) FILTER (event_type <> 'player_idle') FROM ev GROUP BY cell)"))
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per stage and cell as a run's metrics tell them; times and memory, which differ from run to run, are left out here."""
    run = metrics.Metrics(spark)
    made = run.measured("events", events(spark, sf_dir))
    run.measured("chains", W.tumbling(made, 5).where("slot = 0"))
    run.measured("events of types", made.where("event_type <> 'player_idle'"))
    return run.table().select("cell", "stage", "rows")


# --- further projections -----------------------------------------------------------------------------------------------------------
@query(on_events("SELECT game_id, string_agg(actor, ',' ORDER BY first_idx) AS actors, count(*) AS n FROM (SELECT game_id, actor, min(sequence_idx) AS first_idx FROM ev GROUP BY ALL) GROUP BY game_id"))
def ordered_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct actors of each game by first appearance."""
    first = events(spark, sf_dir).groupBy("game_id", "actor").agg(F.min("sequence_idx").alias("first_idx"))
    per = first.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("first_idx", "actor"))).alias("x"), F.count("*").alias("n"))
    return per.select("game_id", F.array_join(F.transform("x", lambda a: a["actor"]), ",").alias("actors"), "n")


@query(
    on_events(
        """SELECT cell, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n DESC, first_seen) AS r
        FROM (SELECT cell, event_type, count(*) AS n, min([game_id, sequence_idx]) AS first_seen FROM ev GROUP BY 1, 2)) WHERE r <= 3"""
    )
)
def top_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent types of each cell; ties go to the type seen first."""
    best = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("n"), "first_game", "first_idx"))
    return type_histogram(spark, sf_dir).withColumn("r", best).where("r <= 3").select("cell", "event_type", "n")


@query(f"SELECT chain_no % 10 < 3 AS degraded, count(*) AS n_chains, sum(n_actionable)::BIGINT AS n_actionable FROM ({ORACLE_SQL['sliding_windows']}) GROUP BY 1")
def noisy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of ten chains of a game are marked as degraded."""
    return sliding_windows(spark, sf_dir).groupBy((F.col("chain_no") % 10 < 3).alias("degraded")).agg(F.count("*").alias("n_chains"), F.sum("n_actionable").alias("n_actionable"))


CITED = r"SELECT conv_id, turn, regexp_extract(text, '(?im)^\s*RULE:\s*(.+)$', 1) AS rule FROM conversations"


@query(CITED)
def cited_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule cited in every message's whole text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.cited(F.col("text"), "RULE").alias("rule"))


@query(CITED)
def cited_rules_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`cited_rules` under its former name."""
    return cited_rules(spark, sf_dir)


@query("SELECT cell, batch, count(*) AS n FROM (SELECT o_orderpriority AS cell, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 1000 AS batch FROM orders) GROUP BY ALL")
def request_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cell"), "o_orderkey")
    return files.request_batches(rows, ["o_orderkey"], 1_000).groupBy("cell", "batch").agg(F.count("*").alias("n"))


@query("SELECT lower(replace(c_name, '-', '')) AS match_id, CAST(c_custkey % 2 AS INTEGER) AS list, c_custkey AS place FROM customer")
def merged_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even customers stand in both lists and keep their place in the first one."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_name").alias("match_id"), F.col("c_custkey").alias("place"))
    return files.merged_ids(ids.where("place % 2 = 0"), ids)


@query("SELECT lang, quality AS correct, count(*) AS n, CASE WHEN quality IS NULL THEN -1 ELSE quality END AS score_label FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def score_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right, wrong and abstained answers as 1, 0 and -1."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("lang", F.col("quality").alias("correct")).agg(F.count("*").alias("n")).withColumn("score_label", H.score_label(F.col("correct") == 1))
