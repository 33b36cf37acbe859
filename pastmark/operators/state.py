"""Cutting the lineage of iterative jobs in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir, or of the session's checkpoints; only a session on one machine may go without
    and gets a local folder."""
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def new_folder(spark, name: str) -> str:
    """A path in the shared folder that no other job uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Saved with its rows dealt by `keys`, which Spark then knows of: groups, windows and joins by these keys and any
    further ones need no exchange of it. For joins by further keys the session is told to accept such a dealing."""
    spark, adaptive = df.sparkSession, "spark.sql.adaptive.enabled"
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    rows, before = saved(df), spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")  # an adaptive plan does not say how its rows are dealt
    try:
        return saved(rows.repartition(*keys))
    finally:
        spark.conf.set(adaptive, before)


#: Rows of a table that is still sent whole to every executor.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast if the table is counted and small; else Spark shuffles the join as usual."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
