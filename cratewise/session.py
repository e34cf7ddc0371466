"""Session settings, reliable materialisation and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lookup tables up to this many rows may be broadcast; larger ones take a shuffle join.
BROADCAST_ROWS = 100_000

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even when that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

#: What a table may weigh to be broadcast unasked. A plan made before a run knows sizes of files alone, where repeated values take
#: next to no room: millions of rows can weigh a few MB. What was shuffled is known by the size of its rows.
_BROADCASTS = {"spark.sql.autoBroadcastJoinThreshold": "1m", "spark.sql.adaptive.autoBroadcastJoinThreshold": "4m"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator assumes (AQE with skew splitting, UTC)."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def limit_broadcasts(spark: SparkSession) -> SparkSession:
    """Keep rows out of the driver where only the size of a file speaks for a broadcast. Hints stay as they are."""
    for key, value in _BROADCASTS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="cratewise-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, inside the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def fixed(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: later readers see the same rows even after executors
    are lost, prune columns, and plan from the table's real size instead of a long lineage."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A configuration table. Broadcast while it is within ``BROADCAST_ROWS``, shuffled beyond."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def bounded(table: DataFrame) -> DataFrame:
    """``table`` with a broadcast hint if it has at most ``BROADCAST_ROWS`` rows, counted now; a larger one is shuffled."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
