"""What the training-data operators share: shared storage, checked broadcasts, distributed prefix sums."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from eventloom.storage import BROADCAST_ROWS, checked_broadcast, released, shared_dir, stored

__all__ = ["BROADCAST_ROWS", "checked_broadcast", "released", "shared_dir", "stored"]

#: Bytes of rows that a Python worker gets, and works on, at a time; and rows of one slice of them.
BATCH_BYTES, SLICE_ROWS = 4 << 20, 1_000

#: White space and words as the contracts define them.
WORD = r"[^\x20\x09-\x0D]+"


#: What operators remember in a worker process, by operator: something with `clear`.
_REMEMBERED: dict[str, object] = {}


def remembering(operator: str, cache: object = None) -> None:
    """Called in a worker before an operator's work: what other operators remember there is forgotten.

    Workers serve many stages. Each cache has its bound, but all of them together would fill an executor.
    """
    for other in [k for k in _REMEMBERED if k != operator]:
        _REMEMBERED.pop(other).clear()
    if cache is not None:
        _REMEMBERED[operator] = cache


def small_batches(spark: SparkSession) -> None:
    """Bounds this session's Arrow batches by bytes, unless it has a bound of its own: 10,000 long texts at once would
    fill an executor outside its heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and of about `size` bytes."""
    for part in batches:
        step = max(1, min(rows, part.num_rows * size // max(1, part.nbytes)))
        for at in range(0, part.num_rows, step):
            yield part.slice(at, step)


def trimmed() -> None:
    """Gives what a finished task has freed back to the system: workers live on and allocators keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def mapped(df: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """`df.mapInArrow(made, schema)` over small slices. Columns that `made` passes on never leave Arrow, so that ids
    beside nulls stay exact."""
    small_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from made(slices(batches))
        finally:
            trimmed()

    return df.mapInArrow(work, schema)


def unit_interval(hexed: Column) -> Column:
    """The first 13 hex digits of a digest as a double in [0, 1), monotone in the digest."""
    return F.conv(F.substring(hexed, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def grouped_prefix(df: DataFrame, group: str, digest: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive prefix sums of `value` within `group`, in the order of `digest` then `order`.

    `digest` is a hex digest, so its value range splits a group evenly without sampling. A group of n rows is cut
    into about sqrt(n) ranges: neither a range nor the list of ranges of one group exceeds the root of the group,
    so no hot group meets in one task. `df` should be stored: it is read three times.
    """
    sizes = df.groupBy(group).agg(F.ceil(F.sqrt(F.count("*").cast("double"))).cast("long").alias("_ranges"))
    placed = (
        df.join(checked_broadcast(sizes), df[group].eqNullSafe(sizes[group])).drop(sizes[group])
        .withColumn("_range", F.floor(unit_interval(F.col(digest)) * F.col("_ranges")).cast("long")).drop("_ranges")
    )
    totals = placed.groupBy(group, "_range").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy(group, "_range").orderBy(digest, *order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_before", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = local.join(offsets, local[group].eqNullSafe(offsets["_g"]) & (local["_range"] == offsets["_r"]))
    return joined.withColumn(out, F.col("_offset") + F.col("_before")).drop("_g", "_r", "_range", "_offset", "_before")
