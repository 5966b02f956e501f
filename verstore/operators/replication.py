"""Replicated logs: matching, shipping, quorum and state hash."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checksum import combined


def divergence(local: DataFrame, request: DataFrame) -> DataFrame:
    """The first index at which both have an entry and the terms differ."""
    pairs = local.select("index", F.col("term").alias("own")).join(request.select("index", F.col("term").alias("asked")), "index")
    return pairs.where("own != asked").agg(F.min("index").alias("index"))


def shipped(local: DataFrame, request: DataFrame) -> DataFrame:
    """The follower's log after the request: its prefix and what it lacks."""
    none = F.lit(None).cast("bigint")
    at = divergence(local, request).select(F.col("index").alias("_at"), none.alias("_last"))
    both = at.unionByName(local.agg(F.max("index").alias("_last")).select(none.alias("_at"), "_last"))
    marks = F.broadcast(both.agg(F.max("_at").alias("_at"), F.max("_last").alias("_last")))  # one row
    kept = local.join(marks, F.coalesce(F.col("index") < F.col("_at"), F.lit(True)))
    new = request.join(marks, F.col("index") >= F.coalesce("_at", F.col("_last") + 1, F.lit(0)))
    return kept.drop("_at", "_last").unionByName(new.drop("_at", "_last"))


def gaps(log: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """Entries whose distance to the entry before isn't 1, with that distance.

    Entries are looked at by buckets of the index, so that no task sorts more
    than a bucket; the window without a key sees a row per bucket.
    """
    rows = log.select("index").withColumn("_b", F.expr(f"index div {bucket}"))
    ends = rows.groupBy("_b").agg(F.max("index").alias("_end"))
    ends = ends.select("_b", F.lag("_end").over(Window.orderBy("_b")).alias("_before"))
    inside = F.lag("index").over(Window.partitionBy("_b").orderBy("index"))
    gap = F.col("index") - F.coalesce("_in", "_before")
    return rows.withColumn("_in", inside).join(ends, "_b").select("index", gap.alias("gap")).where("gap != 1")


def append_request(log: DataFrame, start: int, most: int) -> DataFrame:
    return log.where(F.col("index") >= start).orderBy("index").limit(most)


def commit_index(matches: DataFrame, members: int) -> DataFrame:
    """Per term, the index that a majority of members has reached."""
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("match")))
    return matches.withColumn("_n", rank).where(F.col("_n") == members // 2 + 1).select("term", F.col("match").alias("commit_index"))


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """UTF-8 bytes of texts in chunks: doc_id, offset, n, crc32."""
    raw = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    offsets = F.sequence(F.lit(0), F.greatest(F.octet_length("raw") - 1, F.lit(0)), F.lit(size))
    cut = raw.select("doc_id", F.explode(offsets).alias("offset"), "raw").select("doc_id", "offset", F.substring("raw", F.col("offset") + 1, F.lit(size)).alias("data"))
    return cut.select("doc_id", F.col("offset").cast("bigint").alias("offset"), F.octet_length("data").cast("bigint").alias("n"), F.crc32("data").alias("crc32"))


def state_hash(state: DataFrame) -> int:
    """CRC-32 over (key length, value length, key, value) in key order.

    Sorted by ranges; each partition's checksum and length are combined on the
    driver, one row per partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = n = 0
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entry = len(k).to_bytes(4, "little") + len(v).to_bytes(4, "little") + k + v
                crc, n = zlib.crc32(entry, crc), n + len(entry)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([crc], pa.int64()), pa.array([n], pa.int64())], names=["part", "crc", "n"])

    rows = state.where(F.col("value").isNotNull()).select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    parts = rows.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "part bigint, crc bigint, n bigint").collect()
    crc = 0
    for p in sorted(parts):
        crc = combined(crc, p["crc"], p["n"])
    return crc
