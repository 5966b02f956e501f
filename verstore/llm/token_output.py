"""Operator 1, token-id output: canonical length-limited Huffman files.

``encode`` tokenizes whole texts, counts ids over all documents, builds one
canonical code (package-merge, lengths limited) and writes blocks of whole
documents in ascending doc_id order.  A block decodes on its own: it holds its
document ids and lengths, its bits and the bit offset of every CHECKPOINT-th
id, so that a reader starts at any checkpoint and a table lookup per id, done
for all checkpoints of a block at once, restores them.

Defined cases: a null or empty text is the end id alone; a null doc_id is kept
and sorts first; rows that repeat a doc_id are kept, in the order of their
token bytes; a text of any length is encoded whole, and is one block if it has
more ids than a block; an empty table makes an empty file; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END_ID = 2
#: Ids per block, at least (a document is never cut), and between checkpoints.
BLOCK_IDS, CHECKPOINT = 1 << 18, 128
#: Words, and chunks, whose ids a worker keeps, twice.
CACHED = 400_000


class Kept(dict):
    """Values made once and kept, in two generations of at most CACHED: the
    frequent ones move to the new one, the others go with the old."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 64:
            if len(self) >= CACHED:
                self.old = self.copy()
                self.clear()
            self[key] = value
        return value


class ChunkIds(Kept):
    """Ids (as bytes) of text chunks without spaces and line feeds.

    No token of this tokenizer crosses white space and no piece of it depends
    on text beyond, so a chunk's ids are the same in every text.  Where the
    tokenizer is seen to lower its input and to take runs of letters, digits
    and marks apart, chunks are made of such runs, whose ids the library's
    model gives; all others go through the whole of the library's encoder.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        super().__init__(self.ids_of)
        self.tokenizer, self.dtype, self.words = Tokenizer.from_file(path), dtype, Kept(self.word)
        self.runs = re.compile("[a-z]+|[0-9]|[^a-z0-9]+").findall
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = iter(range(256, 512))
        self.alphabet = {b: b if b in shown else next(hidden) for b in range(256)}
        samples = ("abcq", "the.", "12ab$$x", "éàüßq", "Ñandú", "ªº", "x,y.", "ABC")
        self.specials = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = all(self.encode(s) == self.encode(s.lower()) == self.assembled(s.lower()) for s in samples)

    def encode(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def word(self, run: str) -> bytes:
        """Ids of a run of letters, of marks, or of one digit (lower case, Latin-1)."""
        mapped = run if run.isascii() else run.encode().decode("latin-1").translate(self.alphabet)
        return array(self.dtype[1:] == "u2" and "H" or "I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def assembled(self, chunk: str) -> bytes:
        """Ids of a chunk in lower case from its runs, where these are plain."""
        body = chunk[:-1] if chunk[-1] in ".," else chunk
        if body.isalpha() and body.islower() and (body.isascii() or max(body) < "\u0100"):
            return self.words[body] if body is chunk else self.words[body] + self.words[chunk[-1]]
        if chunk.isascii() and chunk.isprintable() and "'" not in chunk:
            return b"".join(map(self.words.__getitem__, self.runs(chunk)))
        return self.encode(chunk)

    def ids_of(self, chunk: str) -> bytes:
        return b"" if not chunk else self.assembled(chunk) if self.fast else self.encode(chunk)


def token_bytes(chunks: ChunkIds, text: str) -> bytes:
    parts = text.replace("\n", " ").split(" ")
    if chunks.fast:
        low = text.lower()
        try:  # Latin-1 letters have one lower case and no other normal form
            text.encode("latin-1")
            plain = not any(s in low for s in chunks.specials)
        except UnicodeEncodeError:
            plain = False
        if not plain:
            return b"".join(chunks[c] if c.isascii() and c.lower() == c and not any(s in c for s in chunks.specials) else chunks.encode(c) for c in parts)
        parts = low.replace("\n", " ").split(" ")
    return b"".join(map(chunks.__getitem__, parts))


_known: dict[str, ChunkIds] = {}


def _tokenized(path: str, dtype: str, end_id: int | None):
    """Rows of documents, then one row with the partition's id counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _known.get(path) or _known.setdefault(path, ChunkIds(path, dtype))
        end = b"" if end_id is None else np.array([end_id], dtype=dtype).tobytes()
        counts = np.zeros(1, dtype=np.int64)
        names = ["doc_id", "n_tokens", "ids", "counted", "counts"]
        for batch in batches:
            for part in common.pieces(batch, "text"):
                ids = [token_bytes(chunks, t) + end for t in common.texts_of(part)]
                seen = np.bincount(np.frombuffer(b"".join(ids), dtype=dtype))
                if len(seen) > len(counts):
                    counts = np.pad(counts, (0, len(seen) - len(counts)))
                counts[: len(seen)] += seen
                width, none = np.dtype(dtype).itemsize, pa.nulls(len(ids), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary()), none, none], names=names)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()), pa.array([used], pa.list_(pa.int64())), pa.array([counts[used]], pa.list_(pa.int64()))], names=names)

    return run


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package-merge); counts > 0."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    rows, packages = [], np.zeros(0, dtype=np.int64)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        rows.append(at < n)
        both = both[at]
        packages = both[0 : len(both) // 2 * 2 : 2] + both[1 : len(both) // 2 * 2 : 2]
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for leaf in reversed(rows):
        own = int(leaf[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in code order (length, then id), their lengths and codes."""
    order = np.lexsort((ids, lengths))
    ids, lengths = ids[order], lengths[order]
    top = int(lengths[-1]) if len(lengths) else 1
    steps = np.left_shift(1, top - lengths)
    first = np.concatenate([[0], np.cumsum(steps)[:-1]]) if len(ids) else steps
    return ids, lengths, first >> (top - lengths)


class Codec:
    """Encoder and table-driven decoder of one canonical code."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths, self.codes = canonical(np.asarray(ids, dtype=np.int64), np.asarray(lengths, dtype=np.int64))
        self.top = int(self.lengths.max(initial=1))
        self.length_of = np.zeros(int(self.ids.max(initial=0)) + 1, dtype=np.uint64)
        self.code_of = np.zeros_like(self.length_of)
        self.length_of[self.ids], self.code_of[self.ids] = self.lengths, self.codes
        fill = np.left_shift(1, self.top - self.lengths)
        rest = (1 << self.top) - int(fill.sum())
        self.table_id = np.concatenate([np.repeat(self.ids, fill), np.zeros(rest, dtype=np.int64)]).astype(np.uint32)
        self.table_len = np.concatenate([np.repeat(self.lengths, fill), np.ones(rest, dtype=np.int64)])

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits, and the bit offset of every CHECKPOINT-th id."""
        if not len(ids):
            return b"", np.zeros(0, dtype=np.int64)
        size, code = self.length_of[ids], self.code_of[ids]
        ends = np.cumsum(size)
        at = ends - size
        word, bit = at >> np.uint64(6), at & np.uint64(63)
        over = (bit + size).astype(np.int64) - 64  # bits that fall into the next word
        spill = over > 0
        into = np.where(spill, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
        out = np.zeros(int(ends[-1] >> np.uint64(6)) + 2, dtype=np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.bitwise_or.reduceat(into, first)
        out[word[spill] + np.uint64(1)] |= code[spill] << (np.uint64(64) - over[spill].astype(np.uint64))
        return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], at[::CHECKPOINT].astype(np.int64)

    def decode(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, dtype=np.uint32)
        raw = np.frombuffer(bits + b"\0" * 8, dtype=np.uint8)
        at = checkpoints.astype(np.int64).copy()
        out = np.zeros((CHECKPOINT, len(at)), dtype=np.uint32)
        last = n - (len(at) - 1) * CHECKPOINT
        window = raw[:-3].astype(np.uint32)
        window = (window << 24) | (raw[1:-2].astype(np.uint32) << 16) | (raw[2:-1].astype(np.uint32) << 8) | raw[3:]
        shift, mask, limit = 32 - self.top, (1 << self.top) - 1, len(window) - 1
        for i in range(CHECKPOINT):
            if i == last:
                at[-1] = 0  # the last lane has ended; what it reads is cut off
            peek = (window[np.minimum(at >> 3, limit)] >> (shift - (at & 7))) & mask
            out[i] = self.table_id[peek]
            at += self.table_len[peek]
        return out.T.reshape(-1)[:n]


BLOCKS = "shard int, before bigint, doc_ids array<bigint>, doc_lens array<bigint>, n_ids bigint, checkpoints binary, bits binary"


def _blocks(codec: Codec, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, parts, held, before
            ids = np.frombuffer(b"".join(parts), dtype=dtype)
            bits, marks = codec.encode(ids)
            width = np.dtype(dtype).itemsize
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(x) // width for x in parts]], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([marks.tobytes()], pa.binary()), pa.array([bits], pa.binary())],
                names=["shard", "before", "doc_ids", "doc_lens", "n_ids", "checkpoints", "bits"],
            )
            docs, parts, held, before = [], [], 0, before + len(ids)
            return out

        for batch in batches:
            for doc, n, ids in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids").to_pylist()):
                docs.append(doc)
                parts.append(ids)
                held += n
                if held >= BLOCK_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def encode(docs: DataFrame, tokenizer_path: str, end_id: int | None = END_ID, out: str | None = None) -> str:
    """Writes docs' ids below the returned folder: ``blocks`` and ``codebook``.

    Everything gathered to the driver is bounded by the vocabulary.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    out = out or common.shared_dir(spark)
    size = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    dtype = "<u2" if max(size, (end_id or 0) + 1) <= 1 << 16 else "<u4"
    rows = common.stored(docs.select("doc_id", "text").mapInArrow(_tokenized(tokenizer_path, dtype, end_id), "doc_id bigint, n_tokens bigint, ids binary, counted array<bigint>, counts array<bigint>"))
    counted = rows.where("n_tokens = -1").select(F.explode(F.arrays_zip("counted", "counts")).alias("c")).groupBy(F.col("c.counted").alias("id")).agg(F.sum("c.counts").alias("n")).orderBy("id").toPandas()
    ids, n = counted["id"].to_numpy(dtype=np.int64), counted["n"].to_numpy(dtype=np.int64)
    lengths = code_lengths(n, max(16, int(len(ids)).bit_length() + 1))
    import pandas as pd

    spark.createDataFrame(pd.DataFrame({"id": ids, "length": lengths}), "id bigint, length bigint").coalesce(1).write.parquet(f"{out}/codebook")
    # repeated ids sort by their bytes, so that a task that runs again makes the same shard
    # (and are dealt by their first bytes, in the same order, so that many rows without an id aren't one task)
    ordered = rows.where("n_tokens >= 0").select("doc_id", "n_tokens", "ids").repartitionByRange("doc_id", F.substring("ids", 1, 24)).sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(_blocks(Codec(ids, lengths), dtype), BLOCKS).write.option("compression", "none").parquet(f"{out}/blocks")
    return out


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decodes the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()
    codec = Codec(book["id"].to_numpy(), book["length"].to_numpy())
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # as many rows as shards, which is as many as tasks that wrote
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").toPandas()
    base = dict(zip(totals["shard"].tolist(), (totals["n"].cumsum() - totals["n"]).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("shard", "doc_ids", "doc_lens", "n_ids", "checkpoints", "bits", "before")}
                ids = codec.decode(row["bits"], np.frombuffer(row["checkpoints"], dtype=np.int64), row["n_ids"]).astype("<u4")
                raw, lens = memoryview(ids.tobytes()), np.array(row["doc_lens"], dtype=np.int64)
                ends = np.cumsum(lens)
                starts = (ends - lens).tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends.tolist())]
                first = base[row["shard"]] + row["before"]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array([first + a for a in starts], pa.int64()), pa.array(row["doc_lens"], pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a : a + n] for a, n in zip(starts, row["doc_lens"])], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return blocks.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return read(spark, encode(docs, public_tokenizers.path("word_bpe_49k.json")))
