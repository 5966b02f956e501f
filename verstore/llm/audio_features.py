"""Operator 4, media columns: audio features as fixed-shape tensors.

``store`` writes each text's UTF-8 bytes (padded with zeros to a multiple of
64) as an 8-bit mono WAV column; ``features`` reads the stored bytes back,
resamples by a polyphase filter, takes overlapped log-mel frames, cuts them
into PATCH-frame tensors of one shape (Arrow's fixed-shape tensor type, as IPC
bytes) with time spans, and segments the signal by energy with hysteresis.
The query writes the tensors too, and reads back what it says of them.

Defined cases: null and empty texts are 64 zero bytes; long texts are worked
on in blocks of frames; each text is worked on by itself, so equal texts have
equal values; null doc_ids and repeated rows are kept; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

RATE, UP, DOWN, TAPS = 8000, 3, 8, 16
FRAME, HOP, MELS, PATCH = 256, 128, 32, 64
#: Frames worked on at once.
FRAMES_AT_ONCE = 4096


def wav(payload: bytes) -> bytes:
    """8-bit unsigned mono PCM; the payload has an even length."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The data chunk of a WAV."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV")
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV without data")


def _filter() -> np.ndarray:
    """Low-pass for UP/DOWN: windowed sinc, one row of taps per phase."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.hamming(UP * TAPS) / max(UP, DOWN) * UP
    return np.ascontiguousarray(h.reshape(TAPS, UP).T[:, ::-1]).astype(np.float32)


def _mel_bank() -> np.ndarray:
    """Triangles evenly spaced on the mel scale, FRAME/2+1 x MELS."""
    rate = RATE * UP / DOWN
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1) * FRAME / rate
    bins = np.arange(FRAME // 2 + 1)[:, None]
    rise = (bins - edges[:-2]) / np.maximum(edges[1:-1] - edges[:-2], 1e-9)
    fall = (edges[2:] - bins) / np.maximum(edges[2:] - edges[1:-1], 1e-9)
    bank = np.maximum(0, np.minimum(rise, fall))
    empty = bank.sum(axis=0) == 0  # narrow low filters take their nearest bin
    bank[np.rint(edges[1:-1]).astype(int)[empty], np.flatnonzero(empty)] = 1
    return bank.astype(np.float32)


PHASES, BANK, WINDOW = _filter(), _mel_bank(), np.hanning(FRAME + 1)[:-1].astype(np.float32)


def resampled(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """Outputs a..b of the resampled signal (a a multiple of UP)."""
    first = a // UP * DOWN
    blocks = -(-(b - a) // UP)
    low, high = first - TAPS + 1, first + blocks * DOWN + DOWN
    part = np.zeros(high - low, dtype=np.float32)
    s, e = max(low, 0), min(high, len(x))
    if e > s:
        part[s - low : e - low] = (x[s:e].astype(np.float32) - 128) / 128
    windows = np.lib.stride_tricks.sliding_window_view(part, TAPS)
    out = np.empty((blocks, UP), dtype=np.float32)
    for r in range(UP):
        base, phase = r * DOWN // UP, r * DOWN % UP
        out[:, r] = windows[base : base + blocks * DOWN : DOWN] @ PHASES[phase]
    return out.reshape(-1)[: b - a]


def log_mel(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and each frame's energy in dB."""
    x = np.frombuffer(payload, dtype=np.uint8)
    n_out = -(-len(x) * UP // DOWN)
    n = max(1, -(-(n_out - FRAME) // HOP) + 1)
    mel, energy = np.empty((n, MELS), dtype=np.float32), np.empty(n, dtype=np.float32)
    step = FRAMES_AT_ONCE * UP  # frame starts stay multiples of UP
    for f in range(0, n, step):
        to = min(n, f + step)
        y = resampled(x, f * HOP, (to - 1) * HOP + FRAME)
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * WINDOW
        power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
        mel[f:to] = np.log10(np.maximum(power @ BANK, 1e-8))
        energy[f:to] = 10 * np.log10(np.maximum((frames**2).mean(axis=1), 1e-8))
    return mel, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans: opened above the mean + half a deviation, closed below the
    mean - half a deviation; kept as they were in between."""
    mean, half = float(energy.mean()), float(energy.std()) / 2
    event = np.where(energy > mean + half, 1, np.where(energy < mean - half, -1, 0))
    event[0] = event[0] or -1
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), 0))
    on = np.concatenate([[False], event[last] > 0, [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def tensors(mel: np.ndarray) -> bytes:
    """IPC stream of one batch: patch (fixed-shape tensor), start_s, end_s."""
    n = -(-len(mel) // PATCH)
    full = np.full((n * PATCH, MELS), -8, dtype=np.float16)
    full[: len(mel)] = mel
    patch = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, PATCH, MELS))
    hop = HOP * DOWN / UP / RATE
    start = np.arange(n) * PATCH * hop
    batch = pa.RecordBatch.from_arrays([patch, pa.array(start), pa.array(np.minimum(start + PATCH * hop, len(mel) * hop))], names=["patch", "start_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.pieces(batch, "text"):
            raw = [t.encode("utf-8", "surrogatepass") for t in common.texts_of(part)]
            media = [wav(r + bytes(-len(r) % 64 if r else 64)) for r in raw]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: written to the shared folder and read from it."""
    return common.stored(docs.select("doc_id", "text").mapInArrow(_stored, "doc_id bigint, n_bytes bigint, media binary"))


FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, spans array<struct<start_s:double,end_s:double>>"


def features(media: DataFrame, with_tensors: bool = False) -> DataFrame:
    """Digests, feature, spans (and the tensors) of each stored media."""
    hop = HOP * DOWN / UP / RATE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in FEATURES.split(", ")] + ["tensors"] * with_tensors
        for batch in batches:
            for part in common.pieces(batch, "media"):
                out = []
                for doc, n, m in zip(part.column("doc_id").to_pylist(), part.column("n_bytes").to_pylist(), part.column("media").to_pylist()):
                    payload = samples(m)
                    mel, energy = log_mel(payload)
                    found, packed = segments(energy), tensors(mel)
                    spans = [{"start_s": a * hop, "end_s": b * hop} for a, b in found]
                    feature = f"mel{MELS}x{len(mel)}:{zlib.crc32(packed):08x}:{len(found)}"
                    out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature, spans) + (packed,) * with_tensors)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES + ", tensors binary" * with_tensors)


def stored_tensors(media: DataFrame) -> DataFrame:
    """features with tensors, written to the shared folder."""
    return common.stored(features(media, with_tensors=True))


def patches(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The patches of stored tensors, n x PATCH x MELS, and their time spans, n x 2."""
    batch = pa.ipc.open_stream(raw).read_next_batch()
    return batch.column("patch").to_numpy_ndarray(), np.stack([batch.column("start_s").to_numpy(), batch.column("end_s").to_numpy()], axis=1)


def described(kept: DataFrame) -> DataFrame:
    """Stored features with n_patches, tensor_crc32 and loudest (the patch with
    the greatest mean) in place of the tensors, as read back."""
    names = [f.split(" ")[0] for f in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, crc, loudest = [], [], []
            for raw in batch.column("tensors"):
                raw = raw.as_py()
                patch, _ = patches(raw)
                n.append(len(patch))
                crc.append(zlib.crc32(raw))
                loudest.append(int(patch.mean(axis=(1, 2), dtype=np.float32).argmax()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(loudest, pa.int64())], names=[*names, "n_patches", "tensor_crc32", "loudest"])

    return kept.select(*names, "tensors").mapInArrow(run, FEATURES + ", n_patches bigint, tensor_crc32 bigint, loudest bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = store(common.table(spark, sf_dir, "documents"))
    kept = stored_tensors(media)
    common.discard(media)
    return described(kept)
