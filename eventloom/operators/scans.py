"""Running values along the events of a game, without one task that sees the whole game.

Events have their dense place in the game, so a division cuts a game into chunks. Each chunk is summed up in one row, the
rows of a game's chunks are scanned, and what the chunks before leave is joined back. The summaries are associative: sums,
last values, and the four functions of one bit (keep, flip, set, clear). Window, summary and join share one partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Events of a chunk. A game of a billion events has some 15,000 chunks, whose summaries one task scans.
CHUNK = 65_536


def cut_up(events: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Adds _cut: the keys, which may be null, and the chunk."""
    return events.withColumn("_cut", F.struct(*keys, F.floor(F.col("sequence_idx") / size).cast("long").alias("_chunk")))


def here() -> WindowSpec:
    return Window.partitionBy("_cut").orderBy("sequence_idx")


def up_to_here() -> WindowSpec:
    return here().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def chunks(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*[F.col(f"_cut.{c}") for c in keys]).orderBy("_cut._chunk")


def chunks_before(keys: list[str]) -> WindowSpec:
    return chunks(keys).rowsBetween(Window.unboundedPreceding, -1)


def running_sum(events: DataFrame, value: Column, name: str, keys: tuple[str, ...] = ("game_id",), inclusive: bool = True, size: int = CHUNK) -> DataFrame:
    """Adds the sum of `value` (whole numbers; null is 0) over a game's events, or those alike in `keys`, up to this one, which
    counts if `inclusive`."""
    keys = list(keys)
    cut = cut_up(events.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0))), keys, size)
    totals = cut.groupBy("_cut").agg(F.sum("_value").alias("_total"))
    offsets = totals.select("_cut", F.coalesce(F.sum("_total").over(chunks_before(keys)), F.lit(0)).alias("_offset"))
    found = cut.withColumn("_local", F.sum("_value").over(up_to_here())).join(offsets, "_cut")
    total = F.col("_offset") + F.col("_local") - (F.lit(0) if inclusive else F.col("_value"))
    return found.withColumn(name, total).drop("_value", "_cut", "_local", "_offset")


def previous(events: DataFrame, value: Column, name: str, keys: tuple[str, ...] = ("game_id",), size: int = CHUNK) -> DataFrame:
    """Adds the value of the event before, among a game's events or those alike in `keys`; null for the first. A value may
    be null."""
    keys = list(keys)
    # In a struct, so that a null value isn't taken for no event.
    cut = cut_up(events.withColumn("_held", F.struct(value.alias("v"))), keys, size)
    lasts = cut.groupBy("_cut").agg(F.max_by("_held", "sequence_idx").alias("_last"))
    carried = lasts.select("_cut", F.lag("_last").over(chunks(keys)).alias("_carried"))
    found = cut.withColumn("_lag", F.lag("_held").over(here())).join(carried, "_cut")
    return found.withColumn(name, F.coalesce("_lag", "_carried")["v"]).drop("_held", "_cut", "_lag", "_carried")


def alternating(events: DataFrame, always: Column, flips: Column, name: str, count: str, keys: tuple[str, ...] = ("game_id",), size: int = CHUNK) -> DataFrame:
    """Adds the bit `name`: set where `always`; where `flips` and not `always`, the opposite of the bit before; clear elsewhere
    and before the first event. Adds `count`: how many set bits came before.

    A chunk is a function of the bit before it: a constant, or, if all its events flip, that bit kept or flipped. So each
    chunk is worked out for both bits, a game's chunks are composed, and the bit that holds picks the right one.
    """
    keys = list(keys)
    on = lambda c: F.col(c).cast("long")
    marked = events.withColumn("_set", F.coalesce(always, F.lit(False))).withColumn("_flip", ~F.col("_set") & F.coalesce(flips, F.lit(False)))
    cut = cut_up(marked, keys, size).withColumn("_flips", F.sum(on("_flip")).over(up_to_here()))
    # The last event that doesn't flip decides, and the parity of the flips since then.
    based = cut.withColumn("_base", F.last(F.when(~F.col("_flip"), F.struct(F.col("_set").alias("bit"), F.col("_flips").alias("at"))), ignorenulls=True).over(up_to_here()))
    odd, sure = F.col("_flips") % 2 == 1, F.col("_base.bit") != ((F.col("_flips") - F.col("_base.at")) % 2 == 1)
    both = based.withColumns({"_if0": F.coalesce(sure, odd), "_if1": F.coalesce(sure, ~odd)})
    ran = both.withColumns({"_n0": F.sum(on("_if0")).over(up_to_here()) - on("_if0"), "_n1": F.sum(on("_if1")).over(up_to_here()) - on("_if1")})
    each = ran.groupBy("_cut").agg(
        F.max_by(F.struct(F.col("_base").isNotNull().alias("sure"), "_if0"), "sequence_idx").alias("_end"), F.sum(on("_if0")).alias("_sum0"), F.sum(on("_if1")).alias("_sum1")
    )
    # The same once more: constant chunks decide, and the parity of the flipping ones since then.
    so_far = chunks(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = each.withColumn("_turns", F.sum(F.when(~F.col("_end.sure") & F.col("_end._if0"), 1).otherwise(0)).over(so_far))
    held = turned.withColumn("_held", F.last(F.when(F.col("_end.sure"), F.struct(F.col("_end._if0").alias("bit"), F.col("_turns").alias("at"))), ignorenulls=True).over(so_far))
    after = F.coalesce("_held.bit", F.lit(False)) != ((F.col("_turns") - F.coalesce("_held.at", F.lit(0))) % 2 == 1)
    entered = held.withColumn("_after", after).withColumn("_in", F.coalesce(F.lag("_after").over(chunks(keys)), F.lit(False)))
    offset = F.sum(F.when(F.col("_in"), F.col("_sum1")).otherwise(F.col("_sum0"))).over(chunks_before(keys))
    found = ran.join(entered.select("_cut", "_in", F.coalesce(offset, F.lit(0)).alias("_offset")), "_cut")
    pick = lambda one, zero: F.when(F.col("_in"), F.col(one)).otherwise(F.col(zero))
    return found.withColumns({name: pick("_if1", "_if0"), count: F.col("_offset") + pick("_n1", "_n0")}).drop("_set", "_flip", "_cut", "_flips", "_base", "_if0", "_if1", "_n0", "_n1", "_in", "_offset")
