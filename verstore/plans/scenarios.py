"""Queries that go through the store, its logs and its files, with their SQL.

Each works in a fresh folder below spark.checkpoint.dir, which executors and
driver share, and returns what the store says.
"""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import binary, changelog
from ..store import ConflictError, Database, InvalidDataError, consensus, facade, snapshot
from ..store.replicated_log import AppendRequest, Entry, ReplicatedLog

SCENARIOS: dict = {}

#: Events per commit (all that remain are the last) and number of commits.
PER_COMMIT, COMMITS = 2000, 5
_EVENTS = f"(SELECT printf('user-%08d', user_id) AS key, CASE WHEN event_type <> 'error' THEN CAST(value AS VARCHAR) END AS value, event_id, least(event_id // {PER_COMMIT}, {COMMITS - 1}) + 1 AS commit_ts FROM events)"


def _newest(where: str, events: str = _EVENTS) -> str:
    return f"SELECT key, value, commit_ts FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC, event_id DESC) AS n FROM {events} WHERE {where}) WHERE n = 1 AND value IS NOT NULL"


def scenario(sql: str):
    def add(f):
        SCENARIOS[f.__name__] = (f, sql)
        return f

    return add


def folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, as a path."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidDataError("spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="verstore-")
    at = urlsplit(base)
    if at.scheme not in ("", "file"):
        raise InvalidDataError("the store needs a folder that is mounted")
    path = os.path.join(at.path, f"verstore-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def _commits(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    events = changelog.events(spark, sf_dir)
    value = F.when(F.col("event_type") != "error", F.col("value").cast("string").cast("binary"))
    rows = events.select(changelog.key_of("user_id").cast("binary").alias("key"), value.alias("value"), F.col("event_id").alias("seq"))
    number = F.least(F.expr(f"seq div {PER_COMMIT}"), F.lit(COMMITS - 1))
    return [rows.where(number == n) for n in range(COMMITS)]


def _shown(view: DataFrame) -> DataFrame:
    return view.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "commit_ts")


@scenario(_newest("TRUE"))
def store_reopened(spark, sf_dir):
    """Bulk commits, a checkpoint after each but the last; seen after reopening."""
    db = Database.open(spark, folder(spark))
    for n, rows in enumerate(_commits(spark, sf_dir)):
        db.write_df(rows)
        if n < COMMITS - 1:
            db.checkpoint()
    return _shown(Database.open(spark, db.path).view())


_AGAIN = f"(SELECT key, value, event_id, CASE WHEN commit_ts = {COMMITS} THEN 3 ELSE commit_ts END AS commit_ts FROM {_EVENTS} WHERE commit_ts <= 2 OR commit_ts = {COMMITS})"


@scenario(_newest("TRUE", _AGAIN))
def store_restored(spark, sf_dir):
    """A restore to commit 2, another commit over it; the log merged, files
    that no manifest lists deleted, reopened."""
    db, commits = Database.open(spark, folder(spark)), _commits(spark, sf_dir)
    for rows in commits[:4]:
        db.write_df(rows)
    db.checkpoint()
    db.restore(2)
    db.write_df(commits[-1])
    db.checkpoint()
    db.merge_log()
    db.vacuum(older_than_s=0)
    return _shown(Database.open(spark, db.path).view())


@scenario(_newest("commit_ts <= 2"))
def store_pinned(spark, sf_dir):
    """A pinned snapshot outlives garbage collection, merging and reopening."""
    db, commits = Database.open(spark, folder(spark)), _commits(spark, sf_dir)
    for rows in commits[:2]:
        db.write_df(rows)
    db.pin("kept")
    for rows in commits[2:]:
        db.write_df(rows)
    db.checkpoint()
    db.gc()
    db.merge_log(drop_garbage=True)
    db.vacuum(older_than_s=0)
    again = Database.open(spark, db.path)
    return _shown(again.view(as_of=again.pins()["kept"]))


@scenario("SELECT * FROM (VALUES ('blind write', 'committed'), ('phantom', 'conflict'), ('read', 'conflict'), ('restored', 'conflict'), ('snapshot', 'v1'), ('write', 'conflict')) AS t(scenario, outcome)")
def store_transactions(spark, sf_dir):
    """What becomes of transactions that another commit, or a restore, crosses."""
    db, out = Database.open(spark, folder(spark)), []
    db.write_batch([("put", b"a1", b"v1"), ("put", b"k", b"v1")])
    begun = {name: db.begin_tx() for name in ("read", "phantom", "write", "blind write", "snapshot", "restored")}
    begun["read"].get(b"k")
    begun["phantom"].get_range(b"a", b"b")
    for name, key in (("read", b"x"), ("phantom", b"y"), ("write", b"k"), ("blind write", b"z"), ("restored", b"free")):
        begun[name].set(key, b"mine")
    ts = db.write_batch([("put", b"a2", b"v2"), ("put", b"k", b"v2")])
    out.append(("snapshot", begun["snapshot"].get(b"k").decode()))
    for name in ("read", "phantom", "write", "blind write"):
        try:
            begun[name].commit()
            out.append((name, "committed"))
        except ConflictError:
            out.append((name, "conflict"))
    db.restore(ts - 1)
    try:
        begun["restored"].commit()
        out.append(("restored", "committed"))
    except ConflictError:
        out.append(("restored", "conflict"))
    for tx in begun.values():
        tx.close()
    return spark.createDataFrame(out, "scenario string, outcome string")


@scenario("SELECT event_id + 1 AS index, event_id // 100 AS term, printf('user-%08d', user_id) AS key FROM events")
def log_applied(spark, sf_dir):
    """The members' log files: a follower with a tail of other terms takes the
    leader's requests, 1000 entries each, and is read back from its file."""
    rows = changelog.events(spark, sf_dir).orderBy("event_id").select((F.col("event_id") + 1).alias("index"), F.expr("event_id div 100").alias("term"), changelog.key_of("user_id").alias("key"))
    entries = (Entry(r["index"], r.term, r.key.encode(), b"") for r in rows.toLocalIterator())  # a log is one file of its member
    at = folder(spark)
    leader, follower = ReplicatedLog(f"{at}/leader"), ReplicatedLog(f"{at}/follower")
    for part in itertools.batched(entries, 1000):
        leader.append_entries(part)
    follower.apply_append_request(leader.build_append_request(1, 250))
    tail = (Entry(index, follower.last_term + 1, b"other", None) for index in range(follower.last_index + 1, follower.last_index + 31))
    follower.append_entries(tuple(tail))
    for start in range(101, leader.last_index + 1, 1000):  # what the follower has of it stays
        follower.apply_append_request(leader.build_append_request(start, 1000))
    leader.close()
    follower.close()
    return binary.replicated_log(spark, f"{at}/follower").select("index", "term", F.col("key").cast("string").alias("key"))


@scenario(f"SELECT event_id // 100 + 1 AS tx_id, count(*) AS operations, min(printf('user-%08d', user_id)) AS low, max(printf('user-%08d', user_id)) AS high FROM events GROUP BY 1")
def wal_file(spark, sf_dir):
    """Events as the operations of one binary log file, read back."""
    path = f"{folder(spark)}/db.wal"
    _write_wal(spark, sf_dir, path)
    key = F.col("key").cast("string")
    return binary.wal(spark, path).where(F.col("op").isin(binary.SET, binary.DELETE)).groupBy("tx_id").agg(F.count(F.lit(1)).alias("operations"), F.min(key).alias("low"), F.max(key).alias("high"))


def _write_wal(spark: SparkSession, sf_dir: str, path: str) -> None:
    """A transaction per 100 events: begin, a record per event, commit."""
    events, none = changelog.events(spark, sf_dir), F.lit(None).cast("binary")
    tx = F.expr("event_id div 100") + 1
    ops = events.select(tx.alias("tx_id"), F.struct(tx.alias("tx"), F.col("event_id").alias("at")).alias("position"), F.when(F.col("event_type") == "error", binary.DELETE).otherwise(binary.SET).cast("tinyint").alias("op"), changelog.key_of("user_id").cast("binary").alias("key"), F.when(F.col("event_type") != "error", F.col("value").cast("string").cast("binary")).alias("value"))
    ids = ops.select("tx_id").distinct()
    marks = [ids.select("tx_id", F.struct(F.col("tx_id").alias("tx"), F.lit(at).cast("bigint").alias("at")).alias("position"), F.lit(op).cast("tinyint").alias("op"), none.alias("key"), none.alias("value")) for op, at in ((binary.BEGIN, -1), (binary.COMMIT, 1 << 62))]
    binary.write_wal(ops.unionByName(marks[0]).unionByName(marks[1]), path)


@scenario("SELECT key, value FROM (SELECT printf('user-%08d', user_id) AS key, CAST(value AS VARCHAR) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def segment_files(spark, sf_dir):
    """The newest event of each key as binary segment files, read back."""
    best = changelog.events(spark, sf_dir).groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"))
    at = folder(spark)
    names = binary.write_segments(best.select(changelog.key_of("user_id").alias("key"), F.col("value").cast("string").alias("value")), at)
    return binary.segments(spark, [f"{at}/{n}" for n in names]).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


_FRAMES = "12 + CASE WHEN event_type = 'error' THEN 13 + length(printf('user-%08d', user_id)) ELSE 17 + length(printf('user-%08d', user_id)) + length(CAST(value AS VARCHAR)) END"


@scenario(f"SELECT CAST(sum({_FRAMES}) + 42 * count(DISTINCT event_id // 100) AS BIGINT) AS bytes, count(*) + 2 * count(DISTINCT event_id // 100) AS records FROM events")
def wal_bytes(spark, sf_dir):
    """The raw bytes of the log file of ``wal_file``, and its records."""
    path = f"{folder(spark)}/db.wal"
    _write_wal(spark, sf_dir, path)
    size = binary.raw_bytes(spark, path).agg(F.sum(F.octet_length("content"))).first()[0]
    return binary.wal(spark, path).agg(F.lit(size).cast("bigint").alias("bytes"), F.count(F.lit(1)).alias("records"))


@scenario(f"SELECT key, value FROM ({_newest('TRUE')})")
def snapshot_installed(spark, sf_dir):
    """The live state as a snapshot file, sent in chunks of 1000 bytes with one
    that repeats, installed elsewhere and read there."""
    db, at = Database.open(spark, folder(spark)), folder(spark)
    for rows in _commits(spark, sf_dir):
        db.write_df(rows)
    with open(f"{at}/sent", "wb") as out:
        for r in _shown(db.view()).orderBy("key").toLocalIterator():
            out.write(f"{r.key}\t{r.value}\n".encode())
    sender, receiver, offset, again = snapshot.Sender(f"{at}/sent"), snapshot.Receiver(f"{at}/installed"), 0, True
    while True:
        chunk = sender.chunk_at(offset, 1000)
        got = receiver.handle_chunk(snapshot.InstallRequest(7, sender.metadata, chunk.offset, chunk.data, chunk.is_last))
        if got.done:
            break
        offset, again = (0, False) if again else (got.next_offset, False)
    parts = F.split("value", "\t")
    return spark.read.text(f"{at}/installed").select(parts[0].alias("key"), parts[1].alias("value"))


@scenario("SELECT member, CASE WHEN member = 1 THEN 'leader' ELSE 'follower' END AS role, CAST(1 AS BIGINT) AS term, n AS last_index, n AS commit_index FROM (SELECT unnest([1, 2, 3]) AS member, count(*) AS n FROM events)")
def members_agree(spark, sf_dir):
    """Three members elect a leader, which appends an entry per event; one
    follower hears of none but the last requests."""
    counts = changelog.events(spark, sf_dir).groupBy(F.expr("event_id div 10000").alias("part")).count().orderBy("part").collect()  # requests of 10,000
    nodes = {i: consensus.Node(i, tuple(p for p in (1, 2, 3) if p != i)) for i in (1, 2, 3)}
    leader = nodes[1]
    for peer, request in leader.begin_election():
        leader.on_vote_response(nodes[peer].on_vote_request(request))
    for k, r in enumerate(counts):
        for peer, request in leader.append_and_replicate(r["count"]):
            if peer == 2 or k == len(counts) - 1:
                leader.on_append_response(nodes[peer].on_append(request))
    for _ in range(2):  # what a majority has, then that it has it
        for peer, request in leader.heartbeats():
            leader.on_append_response(nodes[peer].on_append(request))
    return spark.createDataFrame([(n.id, n.role, n.term, n.last_index, n.commit) for n in nodes.values()], "member int, role string, term bigint, last_index bigint, commit_index bigint")


@scenario("SELECT * FROM (VALUES (1, 'open', 0), (2, 'put', 0), (3, 'get', 0), (4, 'get absent', 1), (5, 'delete', 0), (6, 'get deleted', 1), (7, 'no key', 2), (8, 'not a name', 3), (9, 'checkpoint', 0), (10, 'close nothing', 0)) AS t(step, call, status)")
def status_codes(spark, sf_dir):
    """The status that each call of the façade answers."""
    status, db = facade.open_database(spark, folder(spark).encode())
    out = [("open", status), ("put", facade.put(db, b"k", b"v")), ("get", facade.get(db, b"k")[0]), ("get absent", facade.get(db, b"q")[0]), ("delete", facade.delete(db, b"k"))]
    out += [("get deleted", facade.get(db, b"k")[0]), ("no key", facade.delete(db, None)), ("not a name", facade.open_database(spark, b"\xff")[0]), ("checkpoint", facade.checkpoint(db)), ("close nothing", facade.close(None))]
    return spark.createDataFrame([(i, call, int(s)) for i, (call, s) in enumerate(out, 1)], "step int, call string, status int")


@scenario("SELECT * FROM (VALUES ('a1', 'v1'), ('a2', 'own'), ('a4', 'new')) AS t(key, value)")
def own_range(spark, sf_dir):
    """A transaction iterates a range: its snapshot with its own writes, not
    what was committed since."""
    db = Database.open(spark, folder(spark))
    db.write_batch([("put", k, b"v1") for k in (b"a1", b"a2", b"a3", b"b1")])
    with db.begin_tx() as tx:
        db.set(b"a5", b"later")
        tx.apply_batch([("put", b"a2", b"own"), ("delete", b"a3"), ("put", b"a4", b"new"), ("put", b"c", b"out")])
        return spark.createDataFrame([(k.decode(), v.decode()) for k, v in tx.iter_range(b"a", b"b")], "key string, value string")


@scenario("SELECT keys, CAST(segments AS BIGINT) AS segments, min_ts, max_ts, rows FROM (SELECT count(DISTINCT user_id) AS keys, 1 AS segments, CAST(1 AS BIGINT) AS min_ts, count(DISTINCT user_id) AS rows FROM events), (SELECT max(commit_ts) AS max_ts FROM " + _EVENTS + ")")
def segment_entry(spark, sf_dir):
    """What a manifest says of the segment a checkpoint wrote, made anew from
    its rows."""
    db = Database.open(spark, folder(spark))
    last = 0
    for rows in _commits(spark, sf_dir):
        if not rows.isEmpty():
            last = db.write_df(rows)
    db.checkpoint()
    listed = [f for f in db.manifest.files if f.kind == "seg"]
    made = [db.entry(f.path, f.kind, f.level) for f in listed]
    if made != listed or last != db.manifest.flushed_ts:
        raise InvalidDataError("the manifest's entry isn't its segment's")
    return spark.createDataFrame([(db.history().select("key").distinct().count(), len(made), 1, last, made[0].rows)], "keys bigint, segments bigint, min_ts bigint, max_ts bigint, rows bigint")
