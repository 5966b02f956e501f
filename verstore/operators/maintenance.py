"""Segments, compaction, version garbage and restore, over a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .resolve import newest


def delta(log: DataFrame, flushed: int) -> DataFrame:
    """What a checkpoint writes: the newest version per key since the last."""
    return newest(log.where(F.col("commit_ts") > flushed))


def segment_stats(log: DataFrame, size: int) -> DataFrame:
    """Key and commit bounds of each segment of size commits."""
    return log.groupBy(F.expr(f"(commit_ts - 1) div {size}").alias("segment")).agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("commit_ts").alias("min_ts"), F.max("commit_ts").alias("max_ts"), F.count(F.lit(1)).alias("rows")
    )


def overlapping(stats: DataFrame, low: str, high: str) -> DataFrame:
    return stats.where(~((F.col("max_key") < low) | (F.col("min_key") > high)))


def gc_removable(log: DataFrame, floor: int) -> DataFrame:
    """Versions per key whose successor is already visible at the floor."""
    after = F.lead("commit_ts").over(Window.partitionBy("key").orderBy("commit_ts"))
    return log.select("key", after.alias("after")).where(F.col("after") <= floor).groupBy("key").agg(F.count(F.lit(1)).alias("removable"))


def max_tx_id(ops: DataFrame) -> DataFrame:
    """The greatest transaction id of a log, committed or not; 0 without any."""
    return ops.agg(F.coalesce(F.max("tx"), F.lit(0).cast("bigint")).alias("tx_id"))
