"""Poker hand histories (TOML files) to hands, and hands to events by a fold over each hand's few actions."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions.decimals import rounded
from eventloom.operators.ordinals import with_ordinals
from eventloom.sources.common import enveloped

HAND = "path string, place int, players array<string>, actions array<string>, starting_stacks array<double>, blinds_or_straddles array<double>"
STAKES, SEATS, UNKNOWN_STACK = ("200", "400", "600", "1000"), 6, 1_000_000
#: Hands of the uncapped subset that the stakes' budgets leave room for.
RESERVED = 83
# Seat names by number of players, streets, and event types of the action codes.
POSITIONS = {2: ("SB", "BB"), 3: ("BTN", "SB", "BB"), 4: ("BTN", "SB", "BB", "UTG"), 5: ("BTN", "SB", "BB", "UTG", "CO"), 6: ("SB", "BB", "UTG", "HJ", "CO", "BTN")}
STREETS = ("preflop", "flop", "turn", "river")
CODES = {"f": "disengage_decision", "cc": "engage_decision", "cbr": "engage_decision"}


def numbers(values: object) -> list[float]:
    return [float(v) if isinstance(v, int | float) else float("inf") for v in values or []]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, place, players, actions, starting_stacks, blinds_or_straddles of every hand below `path`: a `.phh` file
    holds one, a `.phhs` file a table of them. What isn't TOML gives none.

    A file of many hands of any size is read by many tasks: it is cut where a line begins with a table's head, and hands are
    numbered by their tables' places in the file. A hand that isn't TOML is dropped alone.
    """

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for path_, at, row, text in part.itertuples(index=False):
                try:
                    data = tomllib.loads(text)
                except tomllib.TOMLDecodeError:
                    continue
                hands = [h for h in data.values() if isinstance(h, dict)] if path_.endswith(".phhs") else [data]
                rows += [(path_, at, row, list(h.get("players") or []), list(h.get("actions") or []), numbers(h.get("starting_stacks")), numbers(h.get("blinds_or_straddles"))) for h in hands]
            yield pd.DataFrame(rows, columns=["path", "_at", "_row", "players", "actions", "starting_stacks", "blinds_or_straddles"])

    some = spark.read.option("recursiveFileLookup", "true")
    whole = some.format("binaryFile").option("pathGlobFilter", "*.phh").load(path).select("path", F.lit(0).cast("long").alias("_at"), F.lit(0).cast("long").alias("_row"), F.try_validate_utf8("content").alias("_text"))
    tables = some.option("lineSep", "\n[").option("pathGlobFilter", "*.phhs").text(path)
    # Only the first table of a file has its own bracket.
    head = F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), F.col("value")))
    cut = tables.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_row"), head.alias("_text"))
    made = whole.unionByName(cut).where("_text is not null").mapInPandas(parsed, HAND.replace("place int", "_at long, _row long"))
    return with_ordinals(made, ["path"], ["_at", "_row"], "place").withColumn("place", F.col("place").cast("int")).drop("_at", "_row")


def hands(files: DataFrame) -> DataFrame:
    """One record per usable hand: game_id, subset, stake, actor names by seat, whole chips.

    Hands without players or actions are dropped, and of the cash subset those of other stakes or numbers of seats. The
    subset is the folder below the last `data`. Stacks that are no finite number count as very deep ones.
    """
    parts = F.split("path", "/")
    last_data = F.size(parts) - F.array_position(F.reverse(parts), "data")
    subset = F.when(F.array_contains(parts, "data"), F.coalesce(F.get(parts, last_data + 1), F.lit("unknown"))).otherwise("unknown")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.phhs?$", "")
    stake = F.regexp_extract("path", r"_(\d+)NLH_", 1)
    chips = lambda c: F.transform(c, lambda x: F.when(F.abs(x) == float("inf"), UNKNOWN_STACK).when(F.isnan(x), UNKNOWN_STACK).otherwise(x).cast("long"))
    many = F.col("path").endswith(".phhs")
    # Seats of one name are called after the last of them.
    names = F.transform("players", lambda p: F.concat(F.lit("actor_"), (F.size("players") - F.array_position(F.reverse("players"), p)).cast("string")))
    made = files.where((F.size("players") > 0) & (F.size("actions") > 0)).select(
        F.concat(F.lit("pk_"), stem, F.when(many, F.concat(F.lit("_"), (F.col("place") + 1).cast("string"))).otherwise("")).alias("game_id"),
        subset.alias("subset"), stake.alias("stake"), "path", "place", names.alias("players"), F.size("players").alias("n_players"),
        chips("starting_stacks").alias("starting_stacks"), chips("blinds_or_straddles").alias("blinds"), "actions",
    )
    big = F.when(F.size("blinds") > 0, F.array_max("blinds")).otherwise(100)
    cash = F.col("path").contains("/handhq/")
    return made.withColumn("big_blind", big.cast("long")).where(~cash | (F.col("stake").isin(*STAKES) & (F.col("n_players") == SEATS)))


def stratified(found: DataFrame, target: int) -> DataFrame:
    """At most `target` hands: all of the uncapped subset first, then of each stake the first, in file order, up to an
    equal budget."""
    budget = max(1, (target - RESERVED) // len(STAKES))
    cash = F.col("path").contains("/handhq/")
    row = F.row_number().over(Window.partitionBy("_cash", "stake").orderBy("path", "place"))
    kept = found.withColumn("_cash", cash).withColumn("_row", row).where(~F.col("_cash") | (F.col("_row") <= budget))
    return kept.orderBy("_cash", "path", "place").limit(target).drop("_cash", "_row")


def position(seat: Column, n_players: Column) -> Column:
    found = F.lit(None).cast("string")
    for n, names in POSITIONS.items():
        found = F.when(n_players == n, F.get(F.array(*map(F.lit, names)), seat)).otherwise(found)
    return F.coalesce(found, F.concat(F.lit("seat_"), seat.cast("string")))


STATE = "struct<stacks:array<bigint>,put:array<bigint>,pot:bigint,bet:bigint,deals:int,t:double,out:array<struct<t:double,seat:int,code:string,chips:bigint,stack:bigint,pot:bigint,deals:int>>>"


def events(found: DataFrame) -> DataFrame:
    """One event per fold, check or call, and bet or raise, with stack, pot and bet in big blinds behind it.

    Blinds are paid first. A bet to an amount adds what the seat hasn't put in on this street and empties the stack at
    most; a call adds what is missing, at most the stack; a board deal starts a street and takes two seconds; later
    seats think longer. Other actions and unknown seats are skipped. Hands without events give none.
    """
    n = F.col("n_players")
    big = F.when(F.coalesce("big_blind", F.lit(0)) != 0, F.col("big_blind")).otherwise(100)
    seats = F.sequence(F.lit(0), n - 1)
    blind = lambda i: F.coalesce(F.get("blinds", i), F.lit(0)).cast("long")
    stack = lambda i: F.coalesce(F.get("starting_stacks", i), big * 1_000).cast("long")
    paid = F.transform(seats, lambda i: F.when(blind(i) > 0, F.greatest(F.lit(0), stack(i) - blind(i))).otherwise(stack(i)).cast("long"))
    put = F.transform(seats, lambda i: blind(i))
    zero = F.struct(
        paid.alias("stacks"), put.alias("put"), F.aggregate(put, F.lit(0).cast("long"), lambda a, b: a + F.greatest(b, F.lit(0))).alias("pot"), F.coalesce(F.array_max(put), F.lit(0)).cast("long").alias("bet"),
        F.lit(0).alias("deals"), F.lit(0.0).alias("t"), F.array().cast("array<struct<t:double,seat:int,code:string,chips:bigint,stack:bigint,pot:bigint,deals:int>>").alias("out"),
    ).cast(STATE)
    words = F.transform("actions", lambda a: F.split(F.trim(a), r"\s+"))
    acts = F.transform(
        words,
        lambda w: F.struct(
            ((F.size(w) >= 3) & (w[0] == "d") & (F.get(w, F.lit(1)) == "db")).alias("deal"), F.when(w[0].rlike(r"^p\d+$"), F.substring(w[0], 2, 9).try_cast("int")).alias("seat"),
            F.get(w, F.lit(1)).alias("code"), F.coalesce(F.get(w, F.lit(2)).try_cast("double"), F.lit(0.0)).cast("long").alias("amount"),
        ),
    )

    def step(s: Column, a: Column) -> Column:
        has = F.get(s["put"], a["seat"])
        left = F.get(s["stacks"], a["seat"])
        added = F.when(a["code"] == "cbr", F.greatest(F.lit(0), a["amount"] - has)).when(a["code"] == "cc", F.least(F.greatest(F.lit(0), s["bet"] - has), left)).otherwise(0).cast("long")
        rest = F.greatest(F.lit(0), left - added).cast("long")
        chips = F.when(a["code"] == "cbr", a["amount"]).when(a["code"] == "cc", added).otherwise(0).cast("long")
        row = F.struct(s["t"].alias("t"), a["seat"].alias("seat"), a["code"].alias("code"), chips.alias("chips"), rest.alias("stack"), (s["pot"] + added).alias("pot"), s["deals"].alias("deals"))
        acted = F.struct(
            F.transform(s["stacks"], lambda v, i: F.when(i == a["seat"], rest).otherwise(v)).alias("stacks"),
            F.transform(s["put"], lambda v, i: F.when(i != a["seat"], v).when(a["code"] == "cbr", a["amount"]).otherwise(v + added)).alias("put"),
            (s["pot"] + added).alias("pot"), F.when(a["code"] == "cbr", a["amount"]).otherwise(s["bet"]).alias("bet"), s["deals"].alias("deals"),
            (s["t"] + F.greatest(F.lit(3.0), a["seat"] * 0.3 + 2.0)).alias("t"), F.concat(s["out"], F.array(row)).alias("out"),
        ).cast(STATE)
        dealt = F.struct(s["stacks"].alias("stacks"), F.transform(s["put"], lambda v: F.lit(0).cast("long")).alias("put"), s["pot"].alias("pot"), F.lit(0).cast("long").alias("bet"), (s["deals"] + 1).alias("deals"), (s["t"] + 2.0).alias("t"), s["out"].alias("out")).cast(STATE)
        known = a["seat"].isNotNull() & (a["seat"] < n) & a["code"].isin(*CODES)
        return F.when(a["deal"], dealt).when(F.coalesce(known, F.lit(False)), acted).otherwise(s)

    folded = found.where(n > 0).withColumn("_acts", acts).withColumn("_out", F.aggregate("_acts", zero, step)["out"])
    rows = folded.select("game_id", "players", n.alias("n_players"), big.alias("_big"), F.posexplode("_out").alias("sequence_idx", "x"))
    in_blinds = lambda c: rounded(F.col(c) / F.col("_big"), 1)
    street = F.get(F.array(*map(F.lit, STREETS)), F.least(F.col("x.deals"), F.lit(3)))
    kinds = F.create_map(*[F.lit(v) for pair in CODES.items() for v in pair])
    context = F.struct(
        street.alias("street"), position(F.col("x.seat"), F.col("n_players")).alias("position"), F.col("x.code").alias("action"), in_blinds("x.chips").alias("bet_size_bb"),
        in_blinds("x.pot").alias("pot_size_bb"), in_blinds("x.stack").alias("stack_bb"), F.col("n_players").alias("num_players"),
    )
    made = rows.select("game_id", F.col("sequence_idx").cast("long").alias("sequence_idx"), F.col("x.t").alias("timestamp"), kinds[F.col("x.code")].alias("event_type"), F.get("players", F.col("x.seat")).alias("actor"), street.alias("phase"), context.alias("context"))
    return enveloped(made, "poker")
