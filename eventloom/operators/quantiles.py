"""Exact quantiles of groups of any size: counted, ranged and summed up, with no buffer that holds a group."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.storage import stored


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row per group with one column per share: the value at that share of the order, interpolated as by `percentile`.

    Equal values are counted first; distinct ones are range-partitioned by group and value and their counts summed up,
    within ranges and then over them, so a group of any number of values is dealt to many tasks. Nulls don't count; a group
    of nulls gives nulls. Null groups are groups. An empty table gives an empty result.
    """
    counted = rows.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_k"))
    ranged = stored(counted.repartitionByRange(*by, "_v").withColumn("_range", F.spark_partition_id()), "quantile-counts")
    held = F.when(F.col("_v").isNotNull(), F.col("_k")).otherwise(0)
    group = Window.partitionBy(*by)
    totals = ranged.groupBy("_range", *by).agg(F.sum(held).alias("_t"))
    before = F.coalesce(F.sum("_t").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], before.alias("_offset"), F.sum("_t").over(group).alias("_n"))
    upto = F.sum(held).over(Window.partitionBy("_range", *by).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.withColumn("_upto", upto)
    same = reduce(and_, [local[c].eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], local["_range"] == F.col("_r"))
    placed = local.join(offsets, same).withColumns({"_to": F.col("_offset") + F.col("_upto"), "_from": F.col("_offset") + F.col("_upto") - held})
    found = {}
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("_n") - 1)
        for end, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            found[f"{name}_{end}"] = F.max(F.when((F.col("_from") <= place) & (place < F.col("_to")), F.col("_v"))).alias(f"{name}_{end}")
    per = placed.groupBy(*by).agg(F.max("_n").alias("_n"), *found.values())

    def between(name: str, share: float):  # noqa: ANN202
        at, low, high = F.lit(float(share)) * (F.col("_n") - 1), F.col(f"{name}_low"), F.col(f"{name}_high")
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name)

    return per.select(*by, *[between(n, s) for n, s in shares.items()])
