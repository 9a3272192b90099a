"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of narrow rows is broadcast; larger ones take the shuffle join.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: `spark.checkpoint.dir`.

    Only a local session that names none gets a temporary folder; a cluster without the setting is an error,
    because a machine-local folder would lose data there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="eventloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def session_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    Results read these tables when they are used, so they stay until `forget`.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting: `df` must be cheap to count (stored or aggregated)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def released(spark: SparkSession) -> None:
    """Lets the driver notice that finished shuffles aren't needed, so that executors drop their files now and not at
    some later collection of its garbage."""
    spark.sparkContext._jvm.System.gc()


def forget(spark: SparkSession) -> None:
    """Deletes all tables that this application has stored. Results that weren't written elsewhere can't be read then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
