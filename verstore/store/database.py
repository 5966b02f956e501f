"""A transactional store: commits are manifest versions, reads are DataFrames.

Every stored row keeps its commit_ts, so the newest version is always found by
commit order.  Files are never deleted before a manifest without them is
published (``vacuum``); a file that a manifest lists but that is gone is
corruption.
"""

from __future__ import annotations

import heapq
import os
import shutil
import threading
import time
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve
from . import manifest as mf
from .errors import ConflictError, CorruptionError, InvalidDataError

SCHEMA = "key binary, value binary, commit_ts bigint, tx_id bigint"
#: Folders of the log from which maintenance merges them.
MERGE = 64
_ARROW = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("commit_ts", pa.int64()), ("tx_id", pa.int64())])


class Transaction:
    """Snapshot reads, buffered writes, validation at commit."""

    def __init__(self, db: Database, tx_id: int, snapshot: mf.Manifest):
        self.db, self.tx_id, self.snapshot = db, tx_id, snapshot
        self.writes: dict[bytes, bytes | None] = {}
        self.read_keys: set[bytes] = set()
        self.ranges: list[tuple[bytes, bytes]] = []
        self.closed = False

    def set(self, key: bytes, value: bytes) -> None:
        self.writes[bytes(key)] = bytes(value)

    def delete(self, key: bytes) -> None:
        self.writes[bytes(key)] = None

    def apply_batch(self, ops: Iterable[tuple]) -> None:
        """("put", key, value) and ("delete", key); the last per key wins."""
        for op, key, *value in ops:
            if op == "put":
                self.set(key, value[0])
            elif op == "delete":
                self.delete(key)
            else:
                raise InvalidDataError(f"operation {op!r}")

    def get(self, key: bytes) -> bytes | None:
        self.read_keys.add(key)
        if key in self.writes:
            return self.writes[key]
        return self.db._get(key, self.snapshot)

    def get_range(self, start: bytes, end: bytes) -> list[tuple[bytes, bytes]]:
        found = dict(self.db._range(start, end, self.snapshot))
        self.ranges.append((start, end))
        found |= {k: v for k, v in self.writes.items() if start <= k < end}
        out = sorted((k, v) for k, v in found.items() if v is not None)
        self.read_keys |= {k for k, _ in out}
        return out

    def iter_range(self, start: bytes, end: bytes) -> Iterator[tuple[bytes, bytes]]:
        """As get_range, a row at a time, with the writes made up to this call."""
        self.ranges.append((start, end))
        own = dict(sorted((k, v) for k, v in self.writes.items() if start <= k < end))
        found = ((k, v) for k, v in self.db._range(start, end, self.snapshot) if k not in own)
        rows = heapq.merge(found, own.items(), key=lambda kv: kv[0])
        return ((k, v) for k, v in rows if v is not None and not self.read_keys.add(k))

    def commit(self) -> int | None:
        """The commit's ts; a second call changes nothing."""
        if self.closed:
            return None
        ts = self.db._commit(self)
        self.close()
        return ts

    def rollback(self) -> None:
        self.close()

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self.db._release(self.snapshot)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


class Database:
    """open(path) restores the last published manifest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        os.makedirs(path, exist_ok=True)
        self._lock, self._pinned, self._open = threading.RLock(), Counter(), Counter()
        self._background: tuple[threading.Thread, threading.Event] | None = None
        self.manifest = mf.latest(path)
        for f in self.manifest.files:
            self._present(f)

    open = classmethod(lambda cls, spark, path: cls(spark, path))

    # reading

    def _present(self, f: mf.File) -> str:
        full = os.path.join(self.path, f.path)
        if not os.path.exists(full):
            raise CorruptionError(f"{f.path} is listed but missing")
        return full

    def _files(self, m: mf.Manifest, as_of: int, low: bytes | None = None, high: bytes | None = None) -> list[mf.File]:
        """At the present: segments and unflushed log; before that: the log."""
        flushed = m.flushed_ts if as_of >= m.flushed_ts else -1
        return [f for f in m.files if (f.kind == "seg" and flushed >= 0 or f.kind == "log" and f.max_ts > flushed and f.min_ts <= as_of) and f.overlaps(low, high)]

    def _log(self, m: mf.Manifest, files: list[mf.File]) -> DataFrame:
        paths = [self._present(f) for f in files]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def _newest(self, m: mf.Manifest, as_of: int, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        rows = self._log(m, self._files(m, as_of, low, high)).where(F.col("commit_ts") <= as_of)
        return resolve.newest(rows)

    def view(self, as_of: int | None = None) -> DataFrame:
        """key, value, commit_ts of the live keys at a commit."""
        with self._lock:
            m = self.manifest
        if as_of is not None and as_of < self._retained(m):
            raise InvalidDataError(f"commits before {self._retained(m)} were merged away")
        return resolve.live(self._newest(m, m.last_commit_ts if as_of is None else min(as_of, m.last_commit_ts)))

    def history(self) -> DataFrame:
        """Every retained version."""
        m = self.manifest
        return self._log(m, [f for f in m.files if f.kind == "log"])

    def multi_get(self, keys: DataFrame) -> DataFrame:
        m = self.manifest
        return resolve.multi_get(self._log(m, self._files(m, m.last_commit_ts)), keys)

    def _get(self, key: bytes, m: mf.Manifest) -> bytes | None:
        got = resolve.live(self._newest(m, m.last_commit_ts, key, key).where(F.col("key") == F.lit(bytearray(key)))).select("value").head(1)
        return bytes(got[0][0]) if got else None

    def _range(self, start: bytes, end: bytes, m: mf.Manifest) -> Iterator[tuple[bytes, bytes]]:
        if start > end:
            raise InvalidDataError("range start lies after its end")
        if start == end:
            return iter(())
        rows = resolve.live(resolve.in_range(self._newest(m, m.last_commit_ts, start, end), bytearray(start), bytearray(end)))
        return ((bytes(r[0]), bytes(r[1])) for r in rows.select("key", "value").orderBy("key").toLocalIterator())

    def get(self, key: bytes) -> bytes | None:
        return self._get(key, self.manifest)

    def get_range(self, start: bytes, end: bytes) -> list[tuple[bytes, bytes]]:
        return list(self._range(start, end, self.manifest))

    def iter_range(self, start: bytes, end: bytes) -> Iterator[tuple[bytes, bytes]]:
        return self._range(start, end, self.manifest)

    # writing

    def begin_tx(self) -> Transaction:
        with self._lock:  # chosen and pinned at once
            self.manifest = mf.latest(self.path)
            self._tx_ids = max(getattr(self, "_tx_ids", 0), self.manifest.next_tx_id) + 1
            self._pinned[self.manifest.last_commit_ts] += 1
            self._open[self.manifest] += 1
            return Transaction(self, self._tx_ids, self.manifest)

    def _release(self, snapshot: mf.Manifest) -> None:
        with self._lock:
            self._pinned[snapshot.last_commit_ts] -= 1
            self._open[snapshot] -= 1
            self._pinned += Counter()
            self._open += Counter()

    def oldest_snapshot(self) -> int | None:
        return min(self._pinned, default=None)

    def set(self, key: bytes, value: bytes) -> None:
        self.write_batch([("put", key, value)])

    def delete(self, key: bytes) -> None:
        self.write_batch([("delete", key)])

    def write_batch(self, ops: Iterable[tuple]) -> int:
        with self.begin_tx() as tx:
            tx.apply_batch(ops)
            return tx.commit()

    def write_df(self, ops: DataFrame) -> int:
        """One commit of (key, value or NULL) rows of any number, last by seq
        if there is such a column; blind writes, as validated as a batch."""
        order = "seq" if "seq" in ops.columns else None
        rows = ops.groupBy("key").agg((F.max_by(F.struct("value"), order) if order else F.first(F.struct("value"))).alias("v")).select("key", "v.value")
        with self._lock:
            while True:
                m = mf.latest(self.path)
                ts = m.last_commit_ts + 1
                f = self._write(rows.select("key", "value", F.lit(ts).cast("bigint").alias("commit_ts"), F.lit(m.next_tx_id + 1).cast("bigint").alias("tx_id")), "log", 0)
                if self._publish(m.next(last_commit_ts=ts, next_tx_id=m.next_tx_id + 1, files=(*m.files, *f))):
                    return ts

    def import_commits(self, rows: DataFrame, commits: int) -> int:
        """rows (key, value or NULL, n) as the n-th of so many new commits."""
        if commits:
            with self._lock:
                while True:
                    m = mf.latest(self.path)
                    f = self._write(rows.select("key", "value", (F.col("n") + m.last_commit_ts).alias("commit_ts"), (F.col("n") + m.next_tx_id).alias("tx_id")), "log", 0)
                    if self._publish(m.next(last_commit_ts=m.last_commit_ts + commits, next_tx_id=m.next_tx_id + commits, files=(*m.files, *f))):
                        break
        return commits

    def _publish(self, m: mf.Manifest) -> bool:
        if mf.publish(self.path, m):
            self.manifest = m
            return True
        return False

    def _validate(self, tx: Transaction, m: mf.Manifest) -> None:
        """First committer wins: written keys, read keys, keys in read ranges."""
        if m.restores != tx.snapshot.restores:
            raise ConflictError("the store was restored after the snapshot")
        since = tx.snapshot.last_commit_ts
        new = [f for f in m.files if f.kind == "log" and f.max_ts > since]
        if not new:
            return
        rows = self._log(m, new).where(F.col("commit_ts") > since).select("key")
        watched = tx.read_keys | tx.writes.keys()
        if watched:
            keys = self.spark.createDataFrame([(bytearray(k),) for k in watched], "key binary")
            if hit := rows.join(keys, "key", "left_semi").head(1):
                raise ConflictError(f"key {bytes(hit[0][0])!r} changed after the snapshot")
        if tx.ranges and tx.writes:  # own writes were looked at above
            rows = rows.join(self.spark.createDataFrame([(bytearray(k),) for k in tx.writes], "key binary"), "key", "left_anti")
        for start, end in tx.ranges:  # pushed down to the scan
            if hit := resolve.in_range(rows, bytearray(start), bytearray(end)).head(1):
                raise ConflictError(f"key {bytes(hit[0][0])!r} appeared in a read range")

    def _commit(self, tx: Transaction) -> int:
        with self._lock:
            while True:
                m = mf.latest(self.path)
                self._validate(tx, m)
                ts, files = m.last_commit_ts + 1, m.files
                if tx.writes:
                    keys = sorted(tx.writes)
                    name = f"log/{ts:020d}-{uuid.uuid4().hex}"
                    os.makedirs(full := os.path.join(self.path, name))
                    n = len(keys)
                    pq.write_table(pa.table([pa.array(keys, pa.binary()), pa.array([tx.writes[k] for k in keys], pa.binary()), pa.array([ts] * n, pa.int64()), pa.array([tx.tx_id] * n, pa.int64())], schema=_ARROW), os.path.join(full, "part-0.parquet"), compression="zstd")
                    files = (*files, mf.File(name, "log", 0, n, keys[0].hex(), keys[-1].hex(), ts, ts))
                if self._publish(m.next(last_commit_ts=ts, next_tx_id=max(m.next_tx_id, tx.tx_id), files=files)):
                    return ts

    def _write(self, rows: DataFrame, kind: str, level: int) -> tuple[mf.File, ...]:
        """Sorted files in a folder of their own; none for no rows."""
        name = f"{kind}/l{level}-{uuid.uuid4().hex}"
        full = os.path.join(self.path, name)
        rows.select("key", "value", "commit_ts", "tx_id").repartitionByRange("key").sortWithinPartitions("key").write.option("compression", "zstd").option("parquet.bloom.filter.enabled#key", "true").parquet(full)
        found = self.entry(name, kind, level)
        return (found,) if found else ()

    def entry(self, name: str, kind: str, level: int) -> mf.File | None:
        """What a manifest lists of a folder, from its rows; None without any."""
        got = self.spark.read.schema(SCHEMA).parquet(os.path.join(self.path, name)).agg(F.count(F.lit(1)), F.min("key"), F.max("key"), F.min("commit_ts"), F.max("commit_ts")).first()
        return mf.File(name, kind, level, got[0], bytes(got[1]).hex(), bytes(got[2]).hex(), got[3], got[4]) if got[0] else None

    # maintenance

    def checkpoint(self) -> None:
        """Flushes the newest unflushed versions to level 0, then compacts."""
        with self._lock:
            while True:
                m = mf.latest(self.path)
                new = [f for f in m.files if f.kind == "log" and f.max_ts > m.flushed_ts]
                rows = resolve.newest(self._log(m, new).where(F.col("commit_ts") > m.flushed_ts), "tx_id") if new else None
                added = self._write(rows, "seg", 0) if rows is not None else ()
                after = self._compacted(m.next(flushed_ts=m.last_commit_ts, files=(*m.files, *added)))
                if self._publish(after):
                    return

    def _compacted(self, m: mf.Manifest) -> mf.Manifest:
        while found := mf.due(m.files):
            level, taken = found
            merged = self._write(resolve.newest(self._log(m, sorted(taken, key=lambda f: f.path)), "tx_id"), "seg", level + 1)
            m = mf.replace(m, files=(*(f for f in m.files if f not in taken), *merged))
        return m

    def gc(self) -> int:
        """Versions that no snapshot can read any more since the last call."""
        with self._lock:
            while True:
                m = mf.latest(self.path)
                floor = min([m.last_commit_ts, *self._pinned, *(ts for _, ts in m.pins)])
                if floor <= m.gc_floor:
                    return 0
                from pyspark.sql import Window

                after = F.lead("commit_ts").over(Window.partitionBy("key").orderBy("commit_ts"))
                rows = self._log(m, [f for f in m.files if f.kind == "log"]).select(after.alias("after"))
                removed = rows.where((F.col("after") > m.gc_floor) & (F.col("after") <= floor)).count()
                if self._publish(m.next(gc_floor=floor)):
                    return removed

    def restore(self, commit_ts: int) -> None:
        """The state at min(commit_ts, last), as a new manifest version; open
        transactions can't commit after it."""
        with self._lock:
            while True:
                m = mf.latest(self.path)
                target = max(0, min(commit_ts, m.last_commit_ts))
                if target < self._retained(m):
                    raise InvalidDataError(f"commits before {self._retained(m)} were merged away")
                kept = []
                for f in m.files:
                    if f.kind == "log" and f.max_ts <= target:
                        kept.append(f)
                    elif f.kind == "log" and f.min_ts <= target:
                        kept += self._write(self._log(m, [f]).where(F.col("commit_ts") <= target), "log", 0)
                pins = tuple(p for p in m.pins if p[1] <= target)
                if self._publish(m.next(last_commit_ts=target, flushed_ts=0, gc_floor=min(m.gc_floor, target), restores=(*m.restores, target), pins=pins, files=tuple(kept))):
                    return

    # retention

    @staticmethod
    def _retained(m: mf.Manifest) -> int:
        """Reads at commits before this one would miss versions."""
        return m.merged_ts

    def pin(self, name: str) -> int:
        """Keeps the present snapshot, by name, over closes and vacuums."""
        with self._lock:
            while True:
                m = mf.latest(self.path)
                if any(n == name for n, _ in m.pins):
                    raise InvalidDataError(f"pin {name!r} is taken")
                if self._publish(m.next(pins=(*m.pins, (name, m.last_commit_ts)))):
                    return m.last_commit_ts

    def unpin(self, name: str) -> None:
        with self._lock:
            while True:
                m = mf.latest(self.path)
                if self._publish(m.next(pins=tuple(p for p in m.pins if p[0] != name))):
                    return

    def pins(self) -> dict[str, int]:
        return dict(mf.latest(self.path).pins)

    def merge_log(self, drop_garbage: bool = False) -> int:
        """Rewrites the flushed commits' folders as one; returns how many it replaced.

        With drop_garbage, versions that gc has counted go too: reads and
        restores before the floor are refused from then on.
        """
        with self._lock:
            while True:
                m = mf.latest(self.path)
                logs = [f for f in m.files if f.kind == "log" and f.max_ts <= m.flushed_ts]
                if len(logs) < 2 and not (drop_garbage and logs and m.gc_floor > m.merged_ts):
                    return 0
                rows = self._log(m, logs)
                if drop_garbage:
                    from pyspark.sql import Window

                    after = F.lead("commit_ts").over(Window.partitionBy("key").orderBy("commit_ts"))
                    rows = rows.withColumn("after", after).where(F.col("after").isNull() | (F.col("after") > m.gc_floor)).drop("after")
                merged = self._write(rows, "log", 0)
                files = (*merged, *(f for f in m.files if f not in logs))
                if self._publish(m.next(merged_ts=max(m.merged_ts, m.gc_floor) if drop_garbage else m.merged_ts, files=files)):
                    return len(logs)

    def vacuum(self, keep_versions: int = 1, older_than_s: float = 3600.0) -> list[str]:
        """Deletes folders that none of the newest keep_versions manifests nor an
        open snapshot lists, and older manifests.  Folders younger than
        older_than_s stay: a writer may be about to publish them."""
        with self._lock:
            found = mf.versions(self.path)
            old, new = found[: -max(1, keep_versions)], found[-max(1, keep_versions) :]
            manifests = [mf.read(self.path, v) for v in new] + list(self._open)
            listed = {f.path for m in manifests for f in m.files}
            gone = []
            for kind in ("log", "seg"):
                top = os.path.join(self.path, kind)
                for name in sorted(os.listdir(top)) if os.path.isdir(top) else ():
                    full = os.path.join(top, name)
                    if f"{kind}/{name}" not in listed and time.time() - os.path.getmtime(full) >= older_than_s:
                        shutil.rmtree(full)
                        gone.append(f"{kind}/{name}")
            for v in old:
                os.unlink(os.path.join(mf.folder(self.path), f"{v:020d}.json"))
            return gone

    def start_background(self, interval_s: float) -> None:
        if interval_s <= 0:
            raise InvalidDataError("the interval must be positive")
        if self._background:
            raise InvalidDataError("maintenance is running")
        stop = threading.Event()

        def loop() -> None:
            while not stop.wait(interval_s):
                try:
                    self.checkpoint()
                    self.gc()
                    if sum(f.kind == "log" for f in self.manifest.files) > MERGE:
                        self.merge_log()
                    self.vacuum()
                except Exception:  # noqa: BLE001  the next round tries again
                    continue

        thread = threading.Thread(target=loop, daemon=True)
        self._background = (thread, stop)
        thread.start()

    def stop_background(self) -> None:
        if self._background:
            thread, stop = self._background
            stop.set()
            thread.join()
            self._background = None
