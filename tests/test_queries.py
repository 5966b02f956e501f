"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os
import zlib

import duckdb
import pytest

from verstore.functions.checksum import combined
from verstore.operators import conflicts, replication, resolve
from verstore.plans import queries as core

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query(spark, duck, name):
    got, want = core.QUERIES[name](spark, DATA).toPandas(), duck.execute(core.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_chunks(spark):
    got = {(r.doc_id, r.offset): (r.n, r.crc32) for r in core.snapshot_chunks(spark, DATA).collect()}
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        raw = r.text.encode()
        for at in range(0, len(raw) or 1, 1024):
            want[r.doc_id, at] = (len(raw[at : at + 1024]), zlib.crc32(raw[at : at + 1024]))
    assert got == want


def test_combined_checksum():
    for a, b in ((b"", b""), (b"abc", b""), (b"", b"x"), (b"hello ", b"world" * 99)):
        assert combined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_state_hash_values(spark):
    assert replication.state_hash(spark.createDataFrame([], "key string, value string")) == 0
    assert replication.state_hash(spark.createDataFrame([("b", "2"), ("a", "1"), ("c", None)], "key string, value string")) == 625698271


def test_tombstones_and_empty_values(spark):
    log = spark.createDataFrame([(b"", 1, b""), (b"a", 1, b"x"), (b"a", 2, None), (b"b\x00", 1, b"y"), (b"b\xff", 3, b"z")], "key binary, commit_ts bigint, value binary")
    assert {bytes(r.key): bytes(r.value) for r in resolve.live(resolve.newest(log)).collect()} == {b"": b"", b"b\x00": b"y", b"b\xff": b"z"}
    assert {bytes(r.key) for r in resolve.live(resolve.as_of(log, 1)).collect()} == {b"", b"a", b"b\x00"}
    got = resolve.multi_get(log, spark.createDataFrame([(b"a",), (b"",), (b"q",)], "key binary"))
    assert {bytes(r.key): r.found for r in got.collect()} == {b"a": False, b"": True, b"q": False}


@pytest.mark.parametrize("bucket", [1, 3, 64, 1 << 20])
def test_buckets(spark, bucket):
    """Ordinals, gaps and conflicts are the same however rows are dealt."""
    numbers = [x * x % 301 for x in range(0, 300, 2)]
    df = spark.createDataFrame([(n,) for n in numbers], "index bigint")
    got = {r["index"]: r.n for r in resolve.dense_ordinal(df, "index", "n", bucket).collect()}
    assert got == {x: i for i, x in enumerate(sorted(set(numbers)), 1)}
    ordered = sorted(set(numbers))
    got = {(r["index"], r.gap) for r in replication.gaps(df.distinct(), bucket).collect()}
    assert got == {(b, b - a) for a, b in zip(ordered, ordered[1:]) if b - a != 1}
    rows = [(t, f"k{t * 7 % 5}", max(0, t - t % 6), t + 1) for t in range(200)]
    writes = [(t, k, s, c) for t, k, s, c in rows if t % 3]
    got = {(r.tx, r.key) for r in conflicts._committed_between(*(spark.createDataFrame(x, "tx bigint, key string, snap bigint, cts bigint") for x in (rows, writes)), bucket).collect()}
    assert got == {(t, k) for t, k, s, c in rows if any(o == k and s < w < c for _, o, _, w in writes)}


def test_long_phantom_windows(spark):
    """Transactions open over many commits, against all pairs."""
    ops = [(t, t + 1, t - t * 13 % (t + 1), f"k{t * 11 % 40:02d}", t % 4 == 0) for t in range(150)]
    ops += [(t, t + 1, s, f"k{(t * 11 + 9) % 40:02d}", True) for t, _, s, _, read in ops if read]
    df = spark.createDataFrame(ops, "tx bigint, cts bigint, snap bigint, key string, is_read boolean")
    want = {}
    for t in {o[0] for o in ops if o[4]}:
        keys = [o[3] for o in ops if o[0] == t and o[4]]
        snap = next(o[2] for o in ops if o[0] == t)
        for w in ops:
            if not w[4] and snap < w[1] < t + 1 and min(keys) <= w[3] < max(keys) and not any(o[0] == t and o[3] == w[3] and not o[4] for o in ops):
                want[t, w[3]] = max(want.get((t, w[3]), 0), w[1])
    assert {(r.tx, r.key): r.cts for r in conflicts.phantom_conflicts(df).collect()} == want and len(want) > 20
