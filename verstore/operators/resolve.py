"""Visibility: the newest version of each key at a commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(log: DataFrame, *also: str, order: str | Column = "commit_ts") -> DataFrame:
    """The newest version per key, tombstones kept.

    A struct keeps NULL values (a bare max_by of the value would too, but the
    struct carries further columns of the same version).
    """
    best = F.max_by(F.struct("value", "commit_ts", *also), order)
    return log.groupBy("key").agg(best.alias("v")).select("key", "v.*")


def newest_ts(log: DataFrame) -> DataFrame:
    """key and the commit_ts of its newest version, tombstone or not."""
    return log.groupBy("key").agg(F.max("commit_ts").alias("commit_ts"))


def live(resolved: DataFrame) -> DataFrame:
    """Drops tombstones; applied after resolution, never before."""
    return resolved.where(F.col("value").isNotNull())


def as_of(log: DataFrame, commit_ts: int) -> DataFrame:
    """Resolution at a snapshot; the cut lies below the aggregate."""
    return newest(log.where(F.col("commit_ts") <= commit_ts))


def in_range(df: DataFrame, start, end) -> DataFrame:
    """start <= key < end; reaches the scan where key is a stored column (see
    ``changelog.within`` for one that is computed)."""
    return df.where((F.col("key") >= F.lit(start)) & (F.col("key") < F.lit(end)))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per asked key: key, found, value."""
    asked = keys.select("key").distinct()
    got = live(newest(log.join(asked, "key", "left_semi"))).select("key", "value", F.lit(True).alias("found"))
    return asked.join(got, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"), "value")


def overlay(base: DataFrame, staged: DataFrame) -> DataFrame:
    """A transaction's own writes over its snapshot; staged rows win."""
    both = base.select("key", "value", F.lit(0).alias("layer")).unionByName(staged.select("key", "value", F.lit(1).alias("layer")))
    return both.groupBy("key").agg(F.max_by(F.struct("value"), "layer").alias("v")).select("key", "v.value")


def last_write_wins(ops: DataFrame) -> DataFrame:
    """One version per (transaction, key): the last operation by seq."""
    return ops.groupBy("tx", "key").agg(F.max_by(F.struct("value"), "seq").alias("v")).select("tx", "key", "v.value")


def dense_ordinal(df: DataFrame, column: str, name: str, bucket: int = 1 << 20) -> DataFrame:
    """df's distinct column values numbered from 1 in order, as a table.

    Counted by buckets of the value and numbered within each, so that no task
    sorts more than a bucket; the window without a key sees a row per bucket.
    """
    values = df.select(column).distinct().withColumn("_b", F.expr(f"`{column}` div {bucket}"))
    counts = values.groupBy("_b").count()
    before = counts.select("_b", (F.sum("count").over(Window.orderBy("_b")) - F.col("count")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(column))
    return values.withColumn("_n", inside).join(before, "_b").select(column, (F.col("_n") + F.col("_before")).alias(name))


def recovered(ops: DataFrame, committed: DataFrame) -> DataFrame:
    """Replays the committed transactions: new dense ordinals, newest per key."""
    ordinals = dense_ordinal(committed, "tx", "ordinal")
    rows = ops.join(ordinals, "tx")
    best = F.max_by(F.struct("value", "ordinal"), F.struct("ordinal", "seq"))
    return rows.groupBy("key").agg(best.alias("v")).select("key", F.col("v.ordinal").alias("commit_ts"), "v.value")


def valid_prefix(frames: DataFrame, position: str, bad: Column) -> DataFrame:
    """The frames before the first bad one."""
    first = frames.where(bad).agg(F.min(position).alias("_first"))
    return frames.join(F.broadcast(first), F.coalesce(F.col(position) < F.col("_first"), F.lit(True))).drop("_first")
