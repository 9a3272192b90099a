"""Places of rows in the order of their group, without one task that sorts a group.

All rows are range-partitioned by group and order and sorted within their range. A row's place is its place in the range
plus the rows of its group in the ranges before: a table of as many rows as there are ranges and groups.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.storage import checked_broadcast, stored

#: Bits of a generated id that count the rows of a partition; those above are the partition.
ROW_BITS = 33


def with_ordinals(rows: DataFrame, by: list[str], order: list[str], at: str = "ordinal", total: str | None = None) -> DataFrame:
    """Adds `at`, the row's place from 0 among those with its values of `by`, in ascending order, nulls first, and
    `total`, their number, if it is named.

    Rows alike in all of `by` and `order` get different places in no defined order; they are dealt to several ranges, so
    that masses of them aren't one task. Null keys are a group. An empty table stays empty. Columns with the new names are
    replaced.
    """
    kept = [c for c in rows.columns if c not in (at, total)]
    ranged = rows.select(*kept, F.monotonically_increasing_id().alias("_tie")).repartitionByRange(*by, *order, "_tie").sortWithinPartitions(*by, *order, "_tie")
    placed = stored(ranged.withColumn("_id", F.monotonically_increasing_id()).drop("_tie"), "ordinals")
    placed = placed.withColumns({"_range": F.shiftright("_id", ROW_BITS), "_row": F.col("_id").bitwiseAND((1 << ROW_BITS) - 1)}).drop("_id")
    counts = placed.groupBy("_range", *by).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], (before - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("_total"))
    same = reduce(and_, [placed[c].eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], placed["_range"] == F.col("_r"))
    joined = placed.join(checked_broadcast(stored(shifts, "ordinal-shifts")), same)
    new = {at: F.col("_row") + F.col("_shift")} | ({total: F.col("_total")} if total else {})
    return joined.select(*kept, *[c.alias(n) for n, c in new.items()])
