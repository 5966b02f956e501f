"""The change log as a stream.

The offset is a manifest version with its last commit_ts and the number of
restores so far.  A micro-batch reads the log files of its end's manifest that
hold commits between two offsets, each file by a task of its own, so that a
restarted query reads the same rows again (while vacuum keeps that manifest;
after that, the newest one's).  After a restore the batch begins at the commit
that was gone back to: rows that the restore undid stay delivered, and all
commits since are delivered though their numbers repeat.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..store import manifest as mf
from ..store.database import SCHEMA, Database


class _Part(InputPartition):
    def __init__(self, path: str, after: int, to: int):
        self.path, self.after, self.to = path, after, to


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str, after: int):
        self.root, self.after = root, after

    def initialOffset(self) -> dict:
        return {"version": 0, "commit_ts": self.after, "restores": 0}

    def latestOffset(self) -> dict:
        m = mf.latest(self.root)
        return {"version": m.version, "commit_ts": m.last_commit_ts, "restores": len(m.restores)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        m = mf.read(self.root, end["version"]) if end["version"] in mf.versions(self.root) else mf.latest(self.root)
        after, to = m.survived(start["commit_ts"], start["restores"]), end["commit_ts"]
        files = [f for f in m.files if f.kind == "log" and f.max_ts > after and f.min_ts <= to]
        return [_Part(os.path.join(self.root, f.path, n), after, to) for f in files for n in sorted(os.listdir(os.path.join(self.root, f.path))) if n.endswith(".parquet")]

    def read(self, part: _Part) -> Iterator:
        table = pq.read_table(part.path, columns=["key", "value", "commit_ts", "tx_id"], filters=[("commit_ts", ">", part.after), ("commit_ts", "<=", part.to)])
        yield from table.to_batches()


class ChangeLogSource(DataSource):
    """Format ``verstore_log``; options path and after (a commit_ts)."""

    @classmethod
    def name(cls) -> str:
        return "verstore_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], int(self.options.get("after", 0)))


def tail(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """Streaming rows (key, value, commit_ts, tx_id) of commits past after."""
    spark.dataSource.register(ChangeLogSource)
    return spark.readStream.format("verstore_log").option("after", after).load(path)


def newest(log: DataFrame) -> DataFrame:
    """The newest version per key as a stream, in update mode; tombstones stay."""
    return log.groupBy("key").agg(F.max_by(F.struct("value", "commit_ts"), "commit_ts").alias("v")).select("key", "v.value", "v.commit_ts")


def apply(rows: DataFrame, db: Database, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch of (key, value or NULL[, seq]) becomes one commit of db.

    A batch that is repeated after a failure is committed again: the state is
    the same, as the same rows win.
    """

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            db.write_df(batch)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
