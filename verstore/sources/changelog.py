"""The change-log view of an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def key_of(column: str) -> F.Column:
    return F.format_string("user-%08d", F.col(column))


def change_log(events_df: DataFrame, *extra: str) -> DataFrame:
    """key, commit_ts, value (NULL where an error event deletes the key)."""
    return events_df.select(
        key_of("user_id").alias("key"),
        (F.col("event_id") + 1).alias("commit_ts"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        *extra,
    )


def within(events_df: DataFrame, start: str, end: str) -> DataFrame:
    """The events with start <= key < end, for keys as ``key_of`` makes them.

    The key is computed, so a range of it can't reach the file; as keys have a
    fixed width, their order is that of user_id, whose range can.
    """
    number = lambda key: int(key.removeprefix("user-"))
    return events_df.where(F.col("user_id").between(number(start), number(end) - 1))


def transactions(events_df: DataFrame) -> DataFrame:
    """Five events make a transaction; views and clicks read, the rest write."""
    tx = F.expr("event_id div 5")
    return events_df.select(
        tx.alias("tx"),
        (tx + 1).alias("cts"),
        (tx - tx % 4).alias("snap"),
        (F.col("event_id") % 5).alias("seq"),
        key_of("user_id").alias("key"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.col("event_type").isin("view", "click").alias("is_read"),
    )
