"""Whole databases to and from folders of binary files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import resolve
from ..sources import binary
from .database import Database
from .errors import CorruptionError

#: Names in such a folder.
MANIFEST, WAL, SNAPSHOT, ARCHIVE = "MANIFEST", "db.wal", "db.snapshot", "pitr"


def replay(db: Database, paths: list[str]) -> int:
    """Commits the logs' finished transactions in order; returns their number.

    Logs are read in the order given; a transaction may begin in one and end in
    a later one.  Of a transaction's operations on a key the last counts, and
    operations after its commit are another transaction of that id.
    """
    if not paths:
        return 0
    order = F.array_position(F.array(*(F.lit(os.path.basename(p)) for p in paths)), F.element_at(F.split("file", "/"), -1))
    records = binary.wal(db.spark, paths).withColumn("at", F.shiftleft(order.cast("bigint"), 40) + F.col("position"))
    # each record belongs to the next commit of its id, seen from the end
    backwards = Window.partitionBy("tx_id").orderBy(F.desc("at"))
    next_commit = F.last(F.when(F.col("op") == binary.COMMIT, F.col("at")), ignorenulls=True).over(backwards)
    owned = records.withColumn("tx", next_commit).where((F.col("op") != binary.COMMIT) & F.col("tx").isNotNull())
    ordinals = resolve.dense_ordinal(owned, "tx", "n", 1 << 16)
    ops = owned.where(F.col("op").isin(binary.SET, binary.DELETE)).withColumnRenamed("at", "seq")
    last = resolve.last_write_wins(ops.select("tx", "seq", "key", "value")).join(ordinals, "tx")
    return db.import_commits(last.select("key", "value", "n"), ordinals.count())


def import_folder(db: Database, folder: str) -> int:
    """Commits what a folder holds; returns the commits made.

    The manifest's segments (later ones win), or else the snapshot, are one
    commit; each finished transaction of the log is one more.  A segment that
    is listed but missing is corruption.
    """
    made, at = 0, lambda name: os.path.join(folder, name)
    base: DataFrame | None = None
    if os.path.exists(at(MANIFEST)):
        with open(at(MANIFEST), "rb") as f:
            names = binary.decode_manifest(f.read())["segments"]
        if gone := [n for n in names if not os.path.exists(at(n))]:
            raise CorruptionError(f"{gone[0]} is listed but missing")
        if names:
            rank = F.array_position(F.array(*map(F.lit, names)), F.element_at(F.split("file", "/"), -1))
            base = binary.segments(db.spark, [at(n) for n in names]).groupBy("key").agg(F.max_by(F.struct("value"), rank).alias("v")).select("key", "v.value").where("value IS NOT NULL")
    elif os.path.exists(at(SNAPSHOT)):
        base = binary.snapshot_rows(db.spark, at(SNAPSHOT)).select("key", "value")
    if base is not None:
        made += db.import_commits(base.withColumn("n", F.lit(1).cast("bigint")), 1)
    if os.path.exists(at(WAL)) and os.path.getsize(at(WAL)):
        made += replay(db, [at(WAL)])
    return made


def import_archive(db: Database, folder: str) -> int:
    """Commits every transaction of a folder's archived logs and its live log."""
    old = os.path.join(folder, ARCHIVE)
    paths = sorted(os.path.join(old, n) for n in os.listdir(old) if n.endswith(".wal")) if os.path.isdir(old) else []
    live = os.path.join(folder, WAL)
    return replay(db, [p for p in (*paths, live) if os.path.exists(p) and os.path.getsize(p)])


def export_folder(db: Database, folder: str) -> None:
    """The present state as segments with their indexes, manifest and an empty log."""
    m = db.manifest
    names = binary.write_segments(db.view(m.last_commit_ts).select("key", "value"), folder)
    binary._replaced(os.path.join(folder, WAL), lambda out: None)
    binary._replaced(os.path.join(folder, MANIFEST), lambda out: out.write(binary.encode_manifest(m.last_commit_ts, m.next_tx_id, m.last_commit_ts, names)))


def export_wal(db: Database, path: str) -> None:
    """Every retained version as one log: begin, operations, commit per commit."""
    rows = db.history().select("commit_ts", "key", "value")
    ops = rows.select("commit_ts", F.lit(1).alias("part"), F.when(F.col("value").isNull(), binary.DELETE).otherwise(binary.SET).alias("op"), "key", "value")
    none = F.lit(None).cast("binary")
    marks = rows.select("commit_ts").distinct().select("commit_ts", F.explode(F.array(F.lit(0), F.lit(2))).alias("part")).select("commit_ts", "part", F.when(F.col("part") == 0, binary.BEGIN).otherwise(binary.COMMIT).alias("op"), none.alias("key"), none.alias("value"))
    both = ops.unionByName(marks).select(F.struct("commit_ts", "part", "key").alias("position"), F.col("op").cast("tinyint").alias("op"), F.col("commit_ts").alias("tx_id"), "key", "value")
    binary.write_wal(both, path)
