"""File formats, transfers, the replicated log, snapshot sessions, tailing."""

import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from verstore.operators import replication
from verstore.sources import binary
from verstore.store import CorruptionError, Database, InvalidDataError, snapshot, transfer
from verstore.store.replicated_log import AppendRequest, Entry, ReplicatedLog
from verstore.streaming import tail as streaming

SET_A = bytes.fromhex("3142445413000000911d1eeb01010000000000000001000000010000006131")


def pairs(rows):
    return {bytes(r.key): None if r.value is None else bytes(r.value) for r in rows.collect()}


def wal_frames(*records):
    return b"".join(binary.frame(binary.encode_record(*r), binary.WAL_MAGIC) for r in records)


def test_golden_bytes():
    assert wal_frames((3, 1)).hex() == "3142445409000000f5282e13030100000000000000"
    assert wal_frames((1, 1, b"a", b"1")) == SET_A
    assert wal_frames((2, 1, b"a")).hex() == "314244540e000000911c96ea0201000000000000000100000061"
    assert wal_frames((4, 1)).hex() == "31424454090000003c454f77040100000000000000"
    log = [binary.frame(binary.encode_entry(*e), binary.LOG_MAGIC).hex() for e in ((1, 1, b"a", b"1"), (2, 1, b"a", None))]
    assert log == ["4c5244541b0000002df43c6b010000000000000001000000000000000101000000010000006131", "4c5244541a0000000cd6cf7c0200000000000000010000000000000002010000000000000061"]


@pytest.mark.parametrize("tail", [b"", b"TDB", SET_A[:-1], SET_A[:-1] + b"2"])
def test_torn_tail(tail):
    assert [binary.decode_record(p) for _, p in binary.frames(SET_A + tail, binary.WAL_MAGIC)] == [(1, 1, b"a", b"1")]


def test_damaged_payloads():
    with pytest.raises(CorruptionError):
        list(binary.frames(SET_A + b"x" * 12, binary.WAL_MAGIC))
    for payload in (b"", b"\1" * 8, struct.pack("<BQ", 1, 1), binary.encode_record(1, 1, b"a", b"1") + b"x"):
        with pytest.raises(CorruptionError):
            binary.decode_record(payload)
    with pytest.raises(InvalidDataError):
        binary.decode_record(struct.pack("<BQ", 9, 1))


@pytest.mark.parametrize("rows", [[], [(b"", b"")], [(b"a", None), (b"b", b"\xff" * 5000), (b"c\x00", b"")]])
def test_segment_round_trip(rows):
    data = binary.encode_segment(rows)
    assert list(binary.decode_segment(data)) == rows
    for bad in (b"TDBSST09" + data[8:], data[:-1], data[:8] + b"\7" + data[9:]):
        with pytest.raises(CorruptionError):
            list(binary.decode_segment(bad))


def test_older_versions():
    v1 = struct.pack("<Q", 1) + struct.pack("<II", 1, 2) + b"kvv"
    assert list(binary.decode_segment(binary.SEGMENT_V1 + v1)) == [(b"k", b"vv")]
    v2 = struct.pack("<Q", 2) + struct.pack("<IBI", 1, 0, 1) + b"av" + struct.pack("<IBI", 1, 1, 0) + b"b"
    assert list(binary.decode_segment(binary.SEGMENT_V2 + v2)) == [(b"a", b"v"), (b"b", None)]
    assert binary.decode_snapshot(binary.SNAPSHOT_V1 + v1)[0] == 1
    ts, tx, rows = binary.decode_snapshot(binary.SNAPSHOT_V2 + struct.pack("<QQ", 7, 9) + v1)
    assert (ts, tx, list(rows)) == (7, 9, [(b"k", b"vv")])
    old = binary.MANIFEST_V1 + struct.pack("<QQB", 4, 5, 1) + struct.pack("<H", 1) + b"s"
    assert binary.decode_manifest(old) == {"last_commit_ts": 4, "next_tx_id": 5, "flushed_ts": 4, "segments": ["s"]}
    assert binary.decode_manifest(binary.encode_manifest(1, 2, 3, ["x", "y"]))["segments"] == ["x", "y"]
    with pytest.raises(InvalidDataError):
        binary.encode_manifest(1, 2, 3, ["x" * 70_000])
    index = binary.INDEX_MAGIC + b"\1" + struct.pack("<I", 1) + b"a" + b"\0" + bytes(256)
    assert binary.decode_index(index) == {"min_key": b"a", "max_key": None, "bitmap": bytes(256)}


def test_replay(spark, tmp_path):
    db = Database.open(spark, str(tmp_path / "db"))
    old, new = tmp_path / "wal-1.wal", tmp_path / "wal-2.wal"
    old.write_bytes(wal_frames((3, 1), (1, 1, b"a", b"1"), (1, 1, b"a", b"2"), (4, 1), (3, 2), (1, 2, b"b", b"1")))
    new.write_bytes(wal_frames((1, 2, b"c", b"1"), (4, 2), (1, 3, b"a", b"no"), (4, 9), (3, 4), (4, 4), (2, 5, b"a"), (4, 5)) + b"TDB")
    # 1; 2 across both files; 3 never ends; 9 holds nothing; 4 is empty; 5 deletes
    assert transfer.replay(db, [str(old), str(new)]) == 4
    assert pairs(db.view()) == {b"b": b"1", b"c": b"1"} and pairs(db.view(1)) == {b"a": b"2"}
    assert db.manifest.last_commit_ts == 4


def test_folder_round_trip(spark, tmp_path):
    db = Database.open(spark, str(tmp_path / "db"))
    db.write_batch([("put", b"a", b"1"), ("put", b"", b""), ("put", b"z\xff", b"9")])
    db.delete(b"a")
    folder = str(tmp_path / "out")
    transfer.export_folder(db, folder)
    back = Database.open(spark, str(tmp_path / "back"))
    assert transfer.import_folder(back, folder) == 1
    assert pairs(back.view()) == {b"": b"", b"z\xff": b"9"}
    transfer.export_wal(db, str(tmp_path / "all.wal"))
    third = Database.open(spark, str(tmp_path / "third"))
    assert transfer.replay(third, [str(tmp_path / "all.wal")]) == 2
    assert pairs(third.view(1))[b"a"] == b"1" and b"a" not in pairs(third.view())
    os.unlink(next(os.path.join(folder, n) for n in os.listdir(folder) if n.endswith(".sst")))
    with pytest.raises(CorruptionError):
        transfer.import_folder(back, folder)


def state(log, spark):
    rows = log.frame(spark).groupBy("key").agg(F.max_by(F.struct("value"), "index").alias("v")).select("key", "v.value")
    return replication.state_hash(rows)


def test_replicated_log(spark, tmp_path):
    log = ReplicatedLog(str(tmp_path / "log"))
    log.append(1, b"a", b"1")
    log.append(1, b"a", None)
    log.close()
    with open(tmp_path / "log", "ab") as f:
        f.write(b"RDT")
    log = ReplicatedLog(str(tmp_path / "log"))
    assert (log.last_index, log.last_term) == (2, 1) and log.term_at(3) is None
    log.append(2, b"b", b"2")
    assert [e.index for e in ReplicatedLog(log.path).entries_from(2)] == [2, 3]
    with pytest.raises(InvalidDataError):
        log.append_entry(Entry(9, 2, b"x", b""))
    with pytest.raises(InvalidDataError):
        log.append(1, b"x", b"")


def test_ship(spark, tmp_path):
    leader, follower = (ReplicatedLog(str(tmp_path / n)) for n in ("leader", "follower"))
    leader.append(1, b"x", b"v1")
    leader.append(2, b"x", b"v2")
    follower.append(1, b"x", b"old")
    follower.append(3, b"x", b"divergent")
    got = follower.apply_append_request(leader.build_append_request(2, 10))
    assert got.success and got.last_index == 2
    assert state(leader, spark) == state(follower, spark) == 3603351837
    assert follower.apply_append_request(AppendRequest(5, 1, ())).success is False
    assert follower.apply_append_request(leader.build_append_request(1, 1)).last_index == 2
    assert follower.entries_from(1)[0].value == b"old"


def test_snapshot_sessions(tmp_path):
    body = (b"chunked-snapshot-phrase-" * 22)[:46] * 512
    (tmp_path / "from").write_bytes(body)
    sender = snapshot.Sender(str(tmp_path / "from"))
    assert sender.metadata == snapshot.Metadata(len(body), zlib.crc32(body))
    receiver = snapshot.Receiver(str(tmp_path / "to"))

    def send(offset, size):
        c = sender.chunk_at(offset, size)
        return receiver.handle_chunk(snapshot.InstallRequest(42, sender.metadata, c.offset, c.data, c.is_last))

    assert send(0, 1024) == snapshot.InstallResponse(True, 1024, False)
    assert send(0, 1024) == snapshot.InstallResponse(False, 1024, False)
    at = 1024
    while not (got := send(at, 2048)).done:
        at = got.next_offset
    assert (tmp_path / "to").read_bytes() == body and not receiver.sessions
    assert sender.chunk_at(len(body), 5) == snapshot.Chunk(len(body), b"", True)
    for offset, size in ((0, 0), (len(body) + 1, 1)):
        with pytest.raises(InvalidDataError):
            sender.chunk_at(offset, size)


def test_damaged_snapshot(tmp_path):
    install = snapshot.Install(str(tmp_path / "to"), 3, 0)
    install.append_chunk(0, b"abc")
    with pytest.raises(InvalidDataError):
        install.append_chunk(1, b"")
    with pytest.raises(CorruptionError):
        install.finalize()
    install.abort()
    assert not os.listdir(tmp_path)


def test_tail(spark, tmp_path):
    db, copy = (Database.open(spark, str(tmp_path / n)) for n in ("db", "copy"))
    db.write_batch([("put", b"a", b"1"), ("put", b"b", b"1")])
    run = lambda: streaming.apply(streaming.tail(spark, db.path).withColumnRenamed("commit_ts", "seq"), copy, str(tmp_path / "at")).awaitTermination()
    run()
    assert pairs(copy.view()) == {b"a": b"1", b"b": b"1"}
    db.delete(b"a")
    db.set(b"c", b"2")
    run()
    assert pairs(copy.view()) == pairs(db.view()) == {b"b": b"1", b"c": b"2"}
    assert copy.manifest.last_commit_ts == 2


def test_tail_over_restore(spark, tmp_path):
    """Commits after a restore arrive though their numbers were seen before."""
    db, copy = (Database.open(spark, str(tmp_path / n)) for n in ("db", "copy"))
    run = lambda: streaming.apply(streaming.tail(spark, db.path).withColumnRenamed("commit_ts", "seq"), copy, str(tmp_path / "at")).awaitTermination()
    for i in range(4):
        db.set(b"k%d" % i, b"1")
    run()
    db.restore(2)
    db.set(b"k2", b"again")
    run()
    assert pairs(copy.view()) == {b"k0": b"1", b"k1": b"1", b"k2": b"again", b"k3": b"1"}  # what was undone stays delivered
    db.set(b"k4", b"1")
    run()
    assert pairs(copy.view())[b"k4"] == b"1"


def test_request_over_a_divergent_tail(tmp_path):
    """From the first difference on all of a request's entries count, also
    those whose terms happen to agree with the old tail's."""
    log = ReplicatedLog(str(tmp_path / "log"))
    for term in (1, 1, 3):
        log.append(term, b"old", b"")
    new = (Entry(2, 2, b"a", b"1"), Entry(3, 3, b"b", b"2"))
    assert log.apply_append_request(AppendRequest(1, 1, new)).last_index == 3
    assert log.entries_from(2) == list(new)
    assert log.apply_append_request(AppendRequest(1, 1, new[:1])).last_index == 3  # a longer tail stays
    log.close()
    again = ReplicatedLog(str(tmp_path / "log"))
    assert again.entries_from(2) == list(new)
    with pytest.raises(InvalidDataError):
        again.append_entries((Entry(4, 3, b"c", b""), Entry(6, 3, b"d", b"")))
    assert again.last_index == 3
    again.close()


def test_index(spark, tmp_path):
    assert binary.siphash(b"") == 0xD1FBA762150C532C  # of nothing, with the key 0
    empty = binary.decode_index(binary.encode_index([]))
    assert empty["min_key"] is None and not binary.may_hold(empty, b"") and not any(empty["bitmap"])
    keys = [b"key-%04d" % (7 * i) for i in range(300)]
    index = binary.decode_index(binary.encode_index(keys))
    assert (index["min_key"], index["max_key"]) == (keys[0], keys[-1]) and all(binary.may_hold(index, k) for k in keys)
    others = [b"key-%04d" % i for i in range(2000) if i % 7]
    assert sum(binary.may_hold(index, k) for k in others) < 0.1 * len(others)
    assert not binary.may_hold(index, b"a") and not binary.may_hold(index, b"z")
    rows = spark.createDataFrame([(bytearray(k), bytearray(b"v")) for k in keys], "key binary, value binary")
    names = binary.write_segments(rows, str(tmp_path / "out"))
    found = [binary.decode_index((tmp_path / "out" / f"{n}.idx").read_bytes()) for n in names]
    assert [i["min_key"] for i in found] == sorted(i["min_key"] for i in found) and all(any(binary.may_hold(i, k) for i in found) for k in keys)
