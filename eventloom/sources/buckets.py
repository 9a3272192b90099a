"""Event lines in buckets of bounded size with a manifest, in place of a file or folder per game.

A game's lines are cut into parts, parts are dealt to buckets by hash, a bucket is one file. The manifest tells for every
part its file, offset, bytes, lines and checksum, so one game is read from the files that hold it, and checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.operators.ordinals import with_ordinals
from eventloom.sources.files import event_lines
from eventloom.storage import stored

#: Bytes that a bucket should hold, and lines of a part: a larger game spreads over several buckets.
BUCKET_BYTES, PART_LINES = 128 << 20, 100_000


def write_bucketed(events: DataFrame, path: str, bucket_bytes: int = BUCKET_BYTES, part_lines: int = PART_LINES) -> DataFrame:
    """Writes the event lines of all games below `path`/lines and their manifest as Parquet to `path`/manifest, which it
    returns: game_id (as text), part, file, offset, bytes, lines, crc32 (the sum of its lines' CRC-32).

    Within a part lines are in order of place, a game's header first. Replaces what `path` held.
    """
    lines = event_lines(events).select(F.col("game_id").cast("string").alias("game_id"), "place", "line")
    lines = stored(lines.withColumns({"part": F.floor(F.greatest(F.col("place"), F.lit(0)) / part_lines).cast("long"), "size": F.octet_length("line") + 1}), "event-lines")
    total = lines.agg(F.sum("size")).first()[0] or 0
    count = max(1, -(-total // bucket_bytes))
    bucket = F.pmod(F.xxhash64("game_id", "part"), F.lit(count)).cast("int")
    placed = lines.withColumn("bucket", bucket)
    # A task per bucket, so a file per bucket; its rows are sorted as the manifest's offsets say.
    placed.repartition(count, "bucket").sortWithinPartitions("bucket", "game_id", "part", "place").select("bucket", F.col("line").alias("value")).write.mode("overwrite").partitionBy("bucket").text(f"{path}/lines")
    parts = placed.groupBy("bucket", "game_id", "part").agg(F.sum("size").cast("long").alias("bytes"), F.count("*").alias("lines"), F.sum(F.crc32(F.col("line").cast("binary"))).alias("crc32"))
    before = Window.partitionBy("bucket").orderBy("game_id", "part").rowsBetween(Window.unboundedPreceding, -1)
    spark = events.sparkSession
    files = spark.read.text(f"{path}/lines").groupBy(F.col("bucket").cast("int").alias("bucket")).agg(F.max(F.element_at(F.split("_metadata.file_path", "/"), -1)).alias("_name")) if total else spark.createDataFrame([], "bucket int, _name string")
    rows = parts.withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0))).join(files, "bucket")
    told = rows.select("game_id", "part", F.concat(F.lit("bucket="), F.col("bucket").cast("string"), F.lit("/"), F.col("_name")).alias("file"), "offset", "bytes", "lines", "crc32")
    told.write.mode("overwrite").parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def read_games(spark: SparkSession, path: str, games: list[str]) -> DataFrame:
    """game_id, part, line of the games in order of their places, from only the files that hold them; checked against the manifest.

    A part whose lines, bytes or checksum differ raises, and so does a game that the manifest lacks.
    """
    wanted = read_manifest(spark, path).where(F.col("game_id").isin(*games))
    held = wanted.collect()  # some parts of the games asked for
    if missing := set(games) - {r["game_id"] for r in held}:
        raise ValueError(f"no such games: {sorted(missing)}")
    files = sorted({r["file"] for r in held})
    read = spark.read.text([f"{path}/lines/{f}" for f in files])
    lines = read.select(F.concat_ws("/", F.slice(F.split("_metadata.file_path", "/"), -2, 2)).alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    # The place of a line in bytes, from the lines before it in its file.
    sized = with_ordinals(lines, ["file"], ["_at", "_row"], "_place")
    offset = F.sum(F.octet_length("line") + 1).over(Window.partitionBy("file").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    at = sized.withColumn("_offset", F.coalesce(offset, F.lit(0)))
    met = at.join(F.broadcast(wanted.withColumnRenamed("lines", "_lines")), "file").where((F.col("_offset") >= F.col("offset")) & (F.col("_offset") < F.col("offset") + F.col("bytes")))
    kept = stored(met.select("game_id", "part", "_offset", "line", "_lines", "bytes", "crc32"), "read-games")
    sums = kept.groupBy("game_id", "part", "_lines", "bytes", "crc32").agg(F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("b"), F.sum(F.crc32(F.col("line").cast("binary"))).alias("c"))
    if sums.where((F.col("n") != F.col("_lines")) | (F.col("b") != F.col("bytes")) | (F.col("c") != F.col("crc32"))).limit(1).count() or sums.count() != len(held):
        raise ValueError("the lines don't match the manifest")
    return kept.orderBy("game_id", "part", "_offset").select("game_id", "part", "line")
