"""Import and export of the store's binary files.

Framed files (write-ahead and replicated logs) end silently at a torn or
damaged frame; a wrong magic number or a payload that can't be decoded is an
error.  Files are read by Spark's ``binaryFile`` source, one task each, so any
path that Spark reaches will do; one file may have 2 GB at most.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store.errors import CorruptionError, InvalidDataError

#: What marks the files.
WAL_MAGIC, LOG_MAGIC = 0x54444231, 0x5444524C
SEGMENT_V1, SEGMENT_V2, SEGMENT_V3 = b"TDBSST01", b"TDBSST02", b"TDBSST03"
INDEX_MAGIC = b"TDBIDX01"
MANIFEST_V1, MANIFEST_V2 = b"TDBMAN01", b"TDBMAN02"
SNAPSHOT_V1, SNAPSHOT_V2 = b"TDBSNAP1", b"TDBSNAP2"
#: Operation codes, codecs, bytes of an index's bitmap and hashes per key.
SET, DELETE, BEGIN, COMMIT = 1, 2, 3, 4
RAW, ZSTD = 0, 1
BITMAP, HASHES = 256, 3

WAL_SCHEMA = "file string, position bigint, op tinyint, tx_id bigint, key binary, value binary"
LOG_SCHEMA = "file string, position bigint, index bigint, term bigint, op tinyint, key binary, value binary"
SEGMENT_SCHEMA = "file string, key binary, value binary"

_FRAME, _RECORD, _ENTRY, _SIZES = (struct.Struct(x) for x in ("<III", "<BQ", "<QQB", "<II"))


def _field(data: bytes, at: int, n: int, what: str) -> bytes:
    if n > len(data) - at:
        raise CorruptionError(f"{what} is cut short")
    return data[at : at + n]


# frames


def frame(payload: bytes, magic: int) -> bytes:
    return _FRAME.pack(magic, len(payload), zlib.crc32(payload)) + payload


def frames(data: bytes, magic: int) -> Iterator[tuple[int, bytes]]:
    """(position, payload) up to the end or the first torn or damaged frame."""
    at = 0
    while at + _FRAME.size <= len(data):
        mark, n, crc = _FRAME.unpack_from(data, at)
        if mark != magic:
            raise CorruptionError(f"wrong magic number at byte {at}")
        payload = data[at + _FRAME.size : at + _FRAME.size + n]
        if len(payload) < n or zlib.crc32(payload) != crc:
            return
        yield at, payload
        at += _FRAME.size + n


# payloads


def encode_record(op: int, tx_id: int, key: bytes | None = None, value: bytes | None = None) -> bytes:
    head = _RECORD.pack(op, tx_id)
    if op == SET:
        return head + _SIZES.pack(len(key), len(value)) + key + value
    return head + struct.pack("<I", len(key)) + key if op == DELETE else head


def decode_record(payload: bytes) -> tuple[int, int, bytes | None, bytes | None]:
    """op, tx_id, key, value; lengths must fit exactly, but for begin and commit."""
    op, tx_id = _RECORD.unpack(_field(payload, 0, _RECORD.size, "record"))
    rest = payload[_RECORD.size :]
    if op in (BEGIN, COMMIT):
        return op, tx_id, None, None
    if op not in (SET, DELETE):
        raise InvalidDataError(f"unknown operation {op}")
    lengths = struct.Struct("<II" if op == SET else "<I")
    sizes = lengths.unpack(_field(rest, 0, lengths.size, "record"))
    body = rest[lengths.size :]
    if len(body) != sum(sizes):
        raise CorruptionError("a record's length doesn't match")
    return op, tx_id, body[: sizes[0]], body[sizes[0] :] if op == SET else None


def encode_entry(index: int, term: int, key: bytes, value: bytes | None) -> bytes:
    """A NULL value is a deletion."""
    return _ENTRY.pack(index, term, DELETE if value is None else SET) + _SIZES.pack(len(key), len(value or b"")) + key + (value or b"")


def decode_entry(payload: bytes) -> tuple[int, int, int, bytes, bytes | None]:
    """index, term, op, key, value."""
    index, term, op = _ENTRY.unpack(_field(payload, 0, _ENTRY.size, "entry"))
    key_n, value_n = _SIZES.unpack(_field(payload, _ENTRY.size, _SIZES.size, "entry"))
    body = payload[_ENTRY.size + _SIZES.size :]
    if len(body) != key_n + (value_n if op == SET else 0):
        raise CorruptionError("an entry's length doesn't match")
    if op not in (SET, DELETE):
        raise InvalidDataError(f"unknown operation {op}")
    return index, term, op, body[:key_n], body[key_n:] if op == SET else None


# segments, snapshots, manifests, indexes


def _pairs(data: bytes, count: int, flagged: bool, whole: bool = True) -> Iterator[tuple[bytes, bytes | None]]:
    head, at = struct.Struct("<IBI" if flagged else "<II"), 0
    for _ in range(count):
        key_n, *flag, value_n = head.unpack(_field(data, at, head.size, "entry"))
        if flag and flag[0] > 1:
            raise CorruptionError("a tombstone flag is neither 0 nor 1")
        gone = flag == [1]
        at += head.size
        key = _field(data, at, key_n, "key")
        at += key_n
        value = None if gone else _field(data, at, value_n, "value")
        at += 0 if gone else value_n
        yield key, value
    if whole and at != len(data):
        raise CorruptionError("bytes are left after the last entry")


def decode_segment(data: bytes) -> Iterator[tuple[bytes, bytes | None]]:
    """key, value (NULL: deleted) of a segment of any of the three versions."""
    magic, body = data[:8], data[8:]
    if magic not in (SEGMENT_V1, SEGMENT_V2, SEGMENT_V3):
        raise CorruptionError("not a segment")
    if magic == SEGMENT_V3:
        codec, raw_n, n = struct.unpack("<BQQ", _field(body, 0, 17, "segment"))
        body = _field(body, 17, n, "segment")
        if codec == ZSTD:
            try:
                body = pa.decompress(body, decompressed_size=raw_n, codec="zstd", asbytes=True)
            except (OSError, ValueError) as e:
                raise CorruptionError(f"segment: {e}") from e
        elif codec != RAW:
            raise CorruptionError(f"unknown codec {codec}")
        if len(body) != raw_n:
            raise CorruptionError("a segment's length doesn't match")
    (count,) = struct.unpack("<Q", _field(body, 0, 8, "segment"))
    return _pairs(body[8:], count, magic != SEGMENT_V1, magic == SEGMENT_V3)


def encode_segment(rows: Iterable[tuple[bytes, bytes | None]]) -> bytes:
    """Of rows in ascending order of distinct keys; compressed if that is smaller."""
    parts = [b""]
    for key, value in rows:
        parts += [struct.pack("<IBI", len(key), value is None, len(value or b"")), key, value or b""]
    parts[0] = struct.pack("<Q", len(parts) // 3)
    raw = b"".join(parts)
    packed = pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)
    codec, stored = (ZSTD, packed) if len(packed) < len(raw) else (RAW, raw)
    return SEGMENT_V3 + struct.pack("<BQQ", codec, len(raw), len(stored)) + stored


def decode_snapshot(data: bytes) -> tuple[int, int, Iterator[tuple[bytes, bytes]]]:
    """last commit_ts, next tx_id and the rows of a snapshot file."""
    magic, body = data[:8], data[8:]
    if magic == SNAPSHOT_V2:
        commit_ts, tx_id, count = struct.unpack("<QQQ", _field(body, 0, 24, "snapshot"))
        return commit_ts, tx_id, _pairs(body[24:], count, False, False)
    if magic != SNAPSHOT_V1:
        raise CorruptionError("not a snapshot")
    (count,) = struct.unpack("<Q", _field(body, 0, 8, "snapshot"))
    return min(count, 1), 0, _pairs(body[8:], count, False, False)


def decode_manifest(data: bytes) -> dict:
    """last_commit_ts, next_tx_id, flushed_ts and the segments' names, oldest first."""
    magic, body = data[:8], data[8:]
    if magic == MANIFEST_V2:
        commit_ts, tx_id, flushed, count = struct.unpack("<QQQI", _field(body, 0, 28, "manifest"))
        at = 28
    elif magic == MANIFEST_V1:
        commit_ts, tx_id, count = struct.unpack("<QQB", _field(body, 0, 17, "manifest"))
        flushed, at = commit_ts, 17
        if count > 1:
            raise CorruptionError("a manifest's flag is neither 0 nor 1")
    else:
        raise CorruptionError("not a manifest")
    names = []
    for _ in range(count):
        (n,) = struct.unpack("<H", _field(body, at, 2, "manifest"))
        try:
            names.append(_field(body, at + 2, n, "manifest").decode())
        except UnicodeDecodeError as e:
            raise InvalidDataError("a segment's name isn't UTF-8") from e
        at += 2 + n
    return {"last_commit_ts": commit_ts, "next_tx_id": tx_id, "flushed_ts": flushed, "segments": names}


def encode_manifest(last_commit_ts: int, next_tx_id: int, flushed_ts: int, segments: list[str]) -> bytes:
    names = [s.encode() for s in segments]
    if any(len(n) > 0xFFFF for n in names):
        raise InvalidDataError("a segment's name is too long")
    return MANIFEST_V2 + struct.pack("<QQQI", last_commit_ts, next_tx_id, flushed_ts, len(names)) + b"".join(struct.pack("<H", len(n)) + n for n in names)


def decode_index(data: bytes) -> dict:
    """min_key, max_key (None for an empty segment) and the bitmap."""
    if data[:8] != INDEX_MAGIC:
        raise CorruptionError("not an index")
    at, keys = 8, []
    for _ in range(2):
        flag, at = _field(data, at, 1, "index")[0], at + 1
        if flag > 1:
            raise CorruptionError("an index's flag is neither 0 nor 1")
        n = struct.unpack("<I", _field(data, at, 4, "index"))[0] if flag else 0
        keys.append(_field(data, at + 4, n, "index") if flag else None)
        at += (4 + n) * flag
    return {"min_key": keys[0], "max_key": keys[1], "bitmap": _field(data, at, BITMAP, "index")}


_M64 = (1 << 64) - 1


def siphash(data: bytes) -> int:
    """SipHash-1-3 with the key 0, as published by its authors."""
    rotl = lambda x, n: (x << n | x >> 64 - n) & _M64

    def rounds(v: tuple, n: int) -> tuple:
        a, b, c, d = v
        for _ in range(n):
            a, c = a + b & _M64, c + d & _M64
            b, d = rotl(b, 13) ^ a, rotl(d, 16) ^ c
            a, c = rotl(a, 32) + d & _M64, c + b & _M64
            d, b = rotl(d, 21) ^ a, rotl(b, 17) ^ c
            c = rotl(c, 32)
        return a, b, c, d

    v = tuple(int.from_bytes(x, "big") for x in (b"somepseu", b"dorandom", b"lygenera", b"tedbytes"))
    last = data[len(data) // 8 * 8 :].ljust(7, b"\0") + bytes([len(data) & 255])
    for word in (*(data[i : i + 8] for i in range(0, len(data) // 8 * 8, 8)), last):
        m = int.from_bytes(word, "little")
        a, b, c, d = rounds((*v[:3], v[3] ^ m), 1)
        v = a ^ m, b, c, d
    a, b, c, d = rounds((v[0], v[1], v[2] ^ 255, v[3]), 3)
    return a ^ b ^ c ^ d


def key_bits(key: bytes) -> list[int]:
    """The bits of an index's bitmap that a key sets."""
    return [siphash(seed.to_bytes(8, "little") + key) % (8 * BITMAP) for seed in range(HASHES)]


def encode_index(keys: Iterable[bytes]) -> bytes:
    """The index of a segment with these keys, in ascending order."""
    bits, low, high, full = 0, None, None, (1 << 8 * BITMAP) - 1
    for key in keys:
        low, high = key if low is None else low, key
        if bits != full:
            for bit in key_bits(key):
                bits |= 1 << bit
    ends = b"".join(b"\0" if k is None else b"\1" + struct.pack("<I", len(k)) + k for k in (low, high))
    return INDEX_MAGIC + ends + bits.to_bytes(BITMAP, "little")


def may_hold(index: dict, key: bytes) -> bool:
    """Whether a segment with this index (see decode_index) can hold the key."""
    if index["min_key"] is None or not index["min_key"] <= key <= index["max_key"]:
        return False
    return all(index["bitmap"][bit // 8] >> bit % 8 & 1 for bit in key_bits(key))


# DataFrames


def _decoded(spark: SparkSession, paths: str | list[str], decode: Callable[[bytes], Iterator[tuple]], schema: str, rows: int = 4096) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "tinyint": pa.int8(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                found = []
                for x in decode(content.as_py()):
                    found.append((path, *x))
                    if len(found) == rows:
                        yield batch(found)
                        found = []
                if found:
                    yield batch(found)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, schema)


def raw_bytes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file and content: whole files as they are."""
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "content")


def wal(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The records of write-ahead logs; position is a frame's byte in its file."""
    return _decoded(spark, paths, lambda data: ((at, *decode_record(p)) for at, p in frames(data, WAL_MAGIC)), WAL_SCHEMA)


def replicated_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _decoded(spark, paths, lambda data: ((at, *decode_entry(p)) for at, p in frames(data, LOG_MAGIC)), LOG_SCHEMA)


def segments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _decoded(spark, paths, decode_segment, SEGMENT_SCHEMA)


def snapshot_rows(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(spark, path, lambda data: decode_snapshot(data)[2], SEGMENT_SCHEMA)


def _replaced(path: str, write: Callable) -> None:
    """The file at path, whole or not at all."""
    temp = f"{path}.{os.getpid()}.tmp"
    with open(temp, "wb") as out:
        write(out)
        out.flush()
        os.fsync(out.fileno())
    os.replace(temp, path)


def write_wal(records: DataFrame, path: str, order: str = "position") -> None:
    """One log file of (op, tx_id, key, value) rows in their order.

    Frames are made by the executors; the driver appends them one partition at
    a time, as a log is one file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([frame(encode_record(*r), WAL_MAGIC) for r in zip(*(c.to_pylist() for c in b.columns))], pa.binary())], names=["frame"])

    rows = records.repartitionByRange(order).sortWithinPartitions(order).select("op", "tx_id", "key", "value").mapInArrow(run, "frame binary")
    _replaced(path, lambda out: out.writelines(bytes(r[0]) for r in rows.toLocalIterator()))


def write_segments(rows: DataFrame, folder: str, level: int = 1) -> list[str]:
    """Segment files, and an index beside each, of disjoint ranges of
    (key, value) rows with distinct keys.

    Each task writes one file into the folder, which executors and driver
    share; returns the names in the order of their keys.
    """
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [kv for b in batches for kv in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        if pairs:
            name = f"l{level}-{TaskContext.get().partitionId() + 1:020d}.sst"
            _replaced(os.path.join(folder, f"{name}.idx"), lambda out: out.write(encode_index(k for k, _ in pairs)))
            _replaced(os.path.join(folder, name), lambda out: out.write(encode_segment(pairs)))
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    parts = rows.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")).repartitionByRange("key").sortWithinPartitions("key")
    return sorted(r[0] for r in parts.mapInArrow(run, "name string").collect())
