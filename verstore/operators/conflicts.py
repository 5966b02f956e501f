"""Backward validation of transactions as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Commits of one key that a task looks at together.
BUCKET = 1 << 20


def _committed_between(rows: DataFrame, writes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """rows whose key another transaction wrote after the snapshot: the last
    write before a row's own commit is the one to look at.

    A key's rows are dealt by buckets of commits, with the last write of the
    buckets before, so that a hot key isn't in one task and no pair is built.
    """
    none = F.lit(None).cast("bigint")
    mine = rows.select("tx", "key", "snap", "cts", none.alias("_wrote"))
    theirs = writes.select(none.alias("tx"), "key", none.alias("snap"), "cts", F.col("cts").alias("_wrote"))
    both = mine.unionByName(theirs).withColumn("_b", F.expr(f"cts div {bucket}"))
    ends = both.groupBy("key", "_b").agg(F.max("_wrote").alias("_end"))
    earlier = Window.partitionBy("key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("key", "_b", F.max("_end").over(earlier).alias("_before"))
    inside = Window.partitionBy("key", "_b").orderBy("cts").rangeBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("_in", F.max("_wrote").over(inside)).where("tx IS NOT NULL").join(ends, ["key", "_b"])
    return seen.where(F.coalesce("_in", "_before") > F.col("snap")).select("tx", "key", "snap", "cts")


def write_conflicts(ops: DataFrame) -> DataFrame:
    writes = ops.where(~F.col("is_read"))
    return _committed_between(writes.select("tx", "key", "snap", "cts"), writes).select("tx", "key").distinct()


def read_conflicts(ops: DataFrame) -> DataFrame:
    writes = ops.where(~F.col("is_read"))
    reads = ops.where("is_read").select("tx", "key", "snap", "cts")
    reads = reads.join(writes.select("tx", "key").distinct(), ["tx", "key"], "left_anti")
    return _committed_between(reads, writes).select("tx", "key").distinct()


def phantom_conflicts(ops: DataFrame) -> DataFrame:
    """Writes of others that fall into a transaction's read range.

    The window of transactions between snapshot and commit is cut into blocks
    of 1, 2, 4, ... of them, two of a size at most; writes are kept for the
    blocks of each size they lie in, the newest per key.  The join is on the
    block; the range is a filter upon it.
    """
    writes = ops.where(~F.col("is_read")).select("tx", "key", "cts").distinct()
    ranges = ops.where("is_read").groupBy("tx", "snap").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("snap < tx")
    longest = ranges.agg(F.max(F.col("tx") - F.col("snap"))).first()[0] or 1
    sizes = F.explode(F.sequence(F.lit(0), F.lit(int(longest).bit_length()))).alias("size")
    # blocks [a, b) of each size that aren't in a block of twice the size
    cut = ranges.select("*", sizes).withColumn("a", F.expr("(snap + shiftleft(1L, size) - 1) div shiftleft(1L, size)")).withColumn("b", F.expr("tx div shiftleft(1L, size)"))
    ends = F.array(F.when(F.col("a") % 2 == 1, F.col("a")), F.when(F.col("b") % 2 == 1, F.col("b") - 1))
    looked = cut.where("a < b").select("tx", "low", "high", "size", F.explode(F.array_compact(ends)).alias("block"))
    theirs = writes.select("key", "cts", "tx", sizes).groupBy("size", F.expr("tx div shiftleft(1L, size)").alias("block"), "key").agg(F.max("cts").alias("other_cts"))
    hit = looked.join(theirs, ["size", "block"]).where("low <= key AND key < high")
    hit = hit.join(writes.select("tx", "key"), ["tx", "key"], "left_anti")
    return hit.groupBy("tx", "key").agg(F.max("other_cts").alias("cts"))
