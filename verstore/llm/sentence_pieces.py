"""Operator 7, SentencePiece encoding and decoding with N-best segmentation.

A text's pieces form a lattice; its best path maximises the sum of scores (of a
byte-pair model, of the likelihoods that its ranks stand for).
Forward Viterbi scores give, for any place, the exact score of the best way
from the start: as heuristics they let a backward A-star search pop complete
paths in order of score.

No piece has a space mark after another character, or a line feed, so the
lattice falls apart into units at those places.  Forward and backward scores
of all distinct units of a batch are computed at once, which also shows how
far each unit's second path lies behind.  A text's N best paths differ from
the best only in the N-1 units with the smallest such gaps; A-star runs on
these, and their lists are combined.  All paths' ids are returned: the best
path's in full, the others' as the stretches that they change in it.

Decoding joins pieces, turns space marks into spaces and drops the first.

Defined cases: null and empty texts have no pieces and one empty path; of
equal scores the longer last piece wins; characters without a piece become
byte pieces (or the unknown piece) below all others' scores; a text that holds
the space mark itself decodes to spaces (round_trip false); a text of any length
is segmented whole, one unit at a time; null ids and
repeated rows are kept; an empty table gives no rows; other columns are kept
by ``encode``'s caller or ignored.
"""

from __future__ import annotations

import bisect
import gc
import heapq
import itertools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

MARK = "▁"
#: Paths per text; longest unit that is worked on in batches; characters of these at once, with padding.
BEST, SHORT, CELLS = 3, 48, 1 << 15
#: Units of a generation; a worker keeps two of these.
CACHED = 50_000
#: What is added to ranks in Zipf's law; from where on a score is no rank.
ZIPF, UNRANKED = 100, 1e8


def likelihoods(scores: np.ndarray, plain: list[int]) -> np.ndarray:
    """Log likelihoods of pieces.  A byte-pair model's scores are its pieces'
    ranks, which add up to nothing; by Zipf's law these give likelihoods, here
    in steps of 2^-16, so that sums are exact.  Its characters that no merge
    made come far behind all ranks, and do so here."""
    ranks = np.sort(-scores[plain])
    ranks = ranks[ranks < UNRANKED]
    if (ranks % 1 != 0).any() or (ranks < 0).any() or (np.diff(ranks) == 0).any():
        return scores
    return np.round(-np.log(ZIPF + np.maximum(-scores, 0)) * 65536) / 65536


class Lattice:
    """A model's pieces and what both searches need of them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id = {model.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.id):
            raise ValueError("a piece crosses units")
        self.score = likelihoods(np.array([model.get_score(i) for i in range(n)], dtype=np.float64), plain)
        self.scored = np.append(self.score, -np.inf)
        self.unknown_id, self.bytes = model.unk_id(), {}
        for i in range(n):
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[3:5], 16)] = i
        self.unknown = float(self.score[plain].min()) - 10
        self.longest = max(map(len, self.id))
        self.text = [b""] * n
        for p, i in self.id.items():
            self.text[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])
        self.width = "<u2" if n <= 1 << 16 else "<u4"
        # characters by number; pieces by hash of their characters' numbers
        chars = sorted(set("".join(self.id)))
        self.number = np.zeros(0x110000, dtype=np.uint32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.step = np.uint64(0x9E3779B97F4A7C15)
        keys = np.array([self._hash(self.number[[ord(c) for c in p]]) for p in self.id], dtype=np.uint64)
        self.keys, self.ids = keys, np.array(list(self.id.values()), dtype=np.int32)
        order = np.argsort(self.keys)
        self.keys, self.ids = self.keys[order], self.ids[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        # hash -> position: a table by the upper bits, then the few beside it
        self.bits = np.uint64(44)
        self.slot = np.searchsorted(self.keys, np.arange(1 << 20, dtype=np.uint64) << self.bits).astype(np.int32)
        self.reach = int(np.diff(np.append(self.slot, len(self.keys))).max())
        # what is known of units: this generation's, and the one's before
        self.found: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.paths: dict[tuple[str, int], list] = {}

    def _hash(self, numbers: np.ndarray) -> int:
        h = 0
        for x in numbers.tolist():
            h = (h * int(self.step) + x + 1) % (1 << 64)
            h ^= h >> 29
        return h * int(self.step) % (1 << 64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The pieces' ids of hashes, -1 where none."""
        h = h * self.step
        out = np.full(h.shape, -1, dtype=np.int32)
        at = self.slot[h >> self.bits]
        for k in range(self.reach):
            here = np.minimum(at + k, len(self.keys) - 1)
            hit = self.keys[here] == h
            out[hit] = self.ids[here[hit]]
        return out

    def spelled(self, char: str) -> list[int]:
        """A character without a piece."""
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown_id]

    def best(self, units: list[str]) -> list[tuple[bytes, float, float]]:
        """(ids, score, gap to the second path) of each unit, len <= SHORT."""
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        n, top = len(units), int(lengths.max())
        codes = np.frombuffer("".join(u.ljust(top, "\0") for u in units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, top)
        number = self.number[codes.T].astype(np.uint64) + np.uint64(1)  # place by unit from here on
        h = np.zeros((top, n), dtype=np.uint64)
        pieces, scores, most = [], [], min(self.longest, top)
        for length in range(1, most + 1):  # [length-1][i]: of the piece at i..i+length
            h = h[: top - length + 1] * self.step + number[length - 1 :]
            h ^= h >> np.uint64(29)
            piece = self.lookup(h)
            score = self.scored[piece]  # the last entry, of -1, is -inf
            if length == 1:
                np.copyto(score, self.unknown, where=piece < 0)
            pieces.append(piece)
            scores.append(score)
        # padding has no piece and comes after a unit's end, so it changes nothing before
        forward, took = np.full((top + 1, n), -np.inf), np.zeros((top + 1, n), dtype=np.int8)
        forward[0] = 0
        for j in range(1, top + 1):
            for length in range(1, min(most, j) + 1):
                got = forward[j - length] + scores[length - 1][j - length]
                better = got >= forward[j]
                better &= got > -np.inf
                np.copyto(forward[j], got, where=better)
                np.copyto(took[j], length, where=better)
        every = np.arange(n)
        total = forward[lengths, every]
        backward = np.full((top + 1, n), -np.inf)
        backward[lengths, every] = 0
        for i in range(top - 1, -1, -1):
            for length in range(1, min(most, top - i) + 1):
                np.maximum(backward[i], scores[length - 1][i] + backward[i + length], out=backward[i])
        # the best path, from its end
        at, active, steps = lengths.copy(), every, []
        off = [s.copy() for s in scores]
        while len(active):
            step = took[at[active], active].astype(np.int64)
            at[active] -= step
            piece = np.empty(len(active), dtype=np.int64)
            for length in np.flatnonzero(np.bincount(step)).tolist():
                here = np.flatnonzero(step == length)
                rows = active[here]
                off[length - 1][at[rows], rows] = -np.inf
                piece[here] = pieces[length - 1][at[rows], rows]
            steps.append((active, at[active], piece))
            active = active[at[active] > 0]
        second = np.full(n, -np.inf)  # the best path through an edge off the best
        for length in range(1, most + 1):
            np.maximum(second, (forward[: top - length + 1] + off[length - 1] + backward[length:]).max(axis=0), out=second)
        row, place, piece = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((place, row))
        row, place, piece = row[order], place[order], piece[order]
        cut = np.searchsorted(row, np.arange(n + 1)) * np.dtype(self.width).itemsize
        flat = np.maximum(piece, 0).astype(self.width).tobytes()
        ids = [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        for r in np.unique(row[piece < 0]).tolist():
            own = row == r
            spelled = ([p] if p >= 0 else self.spelled(units[r][i]) for p, i in zip(piece[own].tolist(), place[own].tolist()))
            ids[r] = np.array(list(itertools.chain.from_iterable(spelled)), dtype=self.width).tobytes()
        return list(zip(ids, total.tolist(), (total - second).tolist()))

    def edges(self, unit: str, end: int) -> list[tuple[int, float, list[int]]]:
        """(start, score, ids) of the pieces that end at end."""
        out = []
        for start in range(max(0, end - self.longest), end):
            i = self.id.get(unit[start:end])
            if i is not None:
                out.append((start, float(self.score[i]), [i]))
            elif start == end - 1:
                out.append((start, self.unknown, self.spelled(unit[start])))
        return out

    def nbest(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """The unit's n best paths, best first: backward A-star with forward
        Viterbi scores, which are exact, as heuristics."""
        forward = array("d", [0.0])  # edges are made anew where the search comes by
        for end in range(1, len(unit) + 1):
            forward.append(max(forward[a] + s for a, s, _ in self.edges(unit, end)))
        tie, out = itertools.count(), []
        heap: list = [(-forward[-1], next(tie), len(unit), 0.0, None)]
        while heap and len(out) < n:
            _, _, at, score, tail = heapq.heappop(heap)
            if at == 0:
                ids = []
                while tail:
                    ids += tail[0]
                    tail = tail[1]
                out.append((score, ids))
                continue
            for start, s, ids in self.edges(unit, at):
                heapq.heappush(heap, (-(forward[start] + s + score), next(tie), start, s + score, (ids, tail)))
        return out

    def long(self, unit: str) -> tuple[bytes, float, float]:
        paths = self.nbest(unit, 2)
        return np.array(paths[0][1], dtype=self.width).tobytes(), paths[0][0], paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf

    def learn(self, keys: set[str]) -> None:
        """Finds the keys' best paths.  A full generation becomes the older one,
        from which units in use come back; so frequent ones stay."""
        if len(self.found) + len(keys - self.found.keys()) > CACHED:
            self.older, self.found = self.found, {}
        new = keys - self.found.keys()
        again = new & self.older.keys()
        self.found.update((k, self.older[k]) for k in again)
        units = sorted(((unit_of(k), k) for k in new - again), key=lambda u: len(u[0]))
        short = bisect.bisect_right(units, SHORT, key=lambda u: len(u[0]))
        a = 0
        while a < short:  # a part's last unit is its longest
            b = min(short, a + CELLS // len(units[a][0]))
            b = a + max(1, min(b - a, CELLS // len(units[b - 1][0])))
            self.found.update(zip([k for _, k in units[a:b]], self.best([u for u, _ in units[a:b]])))
            a = b
        for u, k in units[short:]:
            self.found[k] = self.long(u)


def unit_of(key: str) -> str:
    """Keys lack the space mark that starts a unit; after a line feed is none."""
    return key if key[:1] == "\n" else MARK + key


def keys_of(text: str) -> list[str]:
    """The keys of a text's units; runs of spaces stay in one unit."""
    if not text:
        return []
    parts = text.replace("\n", " \n").split(" ")
    if "" not in parts:
        return parts
    out, marks = [], 0
    for i, p in enumerate(parts):
        if p[:1] == "\n":
            if marks:
                out.append(MARK * (marks - 1))
            out.append(p)
            marks = 0
        elif p or i == len(parts) - 1:
            out.append(MARK * marks + p)
            marks = 0
        else:
            marks += 1
    return out


def combined(lattice: Lattice, keys: list[str], n: int) -> tuple[bytes, list[tuple[float, int]], list]:
    """The best path's ids, the n best paths' (score, pieces) and, for each of
    these, what it changes: (place, cut, ids) for cut ids of the best path from
    place on, which these ids replace."""
    if not keys:
        return b"", [(0.0, 0)], [()]
    ids, scores, gaps = zip(*map(lattice.found.__getitem__, keys))
    total, best, wide = sum(scores), b"".join(ids), np.dtype(lattice.width).itemsize
    near, left = [], list(gaps)
    for _ in range(min(n - 1, len(keys))):
        gap = min(left)
        if gap == np.inf:
            break
        near.append(at := left.index(gap))
        left[at] = np.inf
    lists = []
    for at in near:
        paths = lattice.paths.get((keys[at], n))
        if paths is None:
            if len(lattice.paths) >= CACHED // 4:
                lattice.paths.clear()
            paths = [(s, np.array(i, dtype=lattice.width).tobytes()) for s, i in lattice.nbest(unit_of(keys[at]), n)]
            # of equal ones, the path that the batch search calls best comes first
            paths = [(scores[at], ids[at]), *(p for p in paths if p[1] != ids[at])][:n]
            lattice.paths[keys[at], n] = paths
        lists.append([(s - scores[at], at, i) for s, i in paths])
    ways = sorted(itertools.product(*lists), key=lambda way: -sum(c[0] for c in way))[:n]
    paths = [(total + sum(c[0] for c in way), (len(best) + sum(len(c[2]) - len(ids[c[1]]) for c in way)) // wide) for way in ways]
    place = {at: sum(map(len, ids[:at])) // wide for at in near}
    return best, paths, [[(place[at], len(ids[at]) // wide, i) for _, at, i in sorted(way, key=lambda c: c[1]) if i != ids[at]] for way in ways]


def path_ids(ids: list[int], changes: list) -> list[int]:
    """A path's ids: the best path's with the path's changes."""
    out, at = [], 0
    for place, cut, new in changes:
        out += [*ids[at:place], *new]
        at = place + cut
    return out + list(ids[at:])


def decode(lattice: Lattice, ids: np.ndarray) -> str:
    raw = b"".join(map(lattice.text.__getitem__, ids.tolist()))
    text = raw.decode("utf-8", "surrogatepass")
    return text[1:] if text[:1] == " " else text


_known: dict[str, Lattice] = {}
SCHEMA = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, score double, nbest_scores array<double>, nbest_pieces array<bigint>, round_trip boolean"
#: The best path's ids and each path's changes of them, as path_ids takes them.
IDS = ", ids array<bigint>, nbest_changes array<array<struct<place: bigint, cut: bigint, ids: array<bigint>>>>"


def encode(docs: DataFrame, path: str, best: int = BEST, with_ids: bool = False, keep: tuple = ()) -> DataFrame:
    """Each text's best paths: counts, scores and whether decoding restores it
    (and the best path's ids, with what each of the paths changes in them; and
    the columns named by keep)."""
    kept = docs.select(*keep).schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _known.get(path) or _known.setdefault(path, Lattice(path))
        names = [f.split(" ")[0] for f in SCHEMA.split(", ")] + ["ids", "nbest_changes"] * with_ids + [*keep]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_()]
        changed = pa.list_(pa.list_(pa.struct([("place", pa.int64()), ("cut", pa.int64()), ("ids", pa.list_(pa.int64()))])))
        gc.disable()  # the kept units are no garbage, and hold no cycles
        try:
            for batch in batches:
                for part in common.pieces(batch, "text", 2 << 20):
                    texts = common.texts_of(part)
                    keys = [keys_of(t) for t in texts]
                    lattice.learn(set().union(*keys))
                    out, best_ids, changes = [], [], []
                    for doc, text, own in zip(part.column("doc_id").to_pylist(), texts, keys):
                        raw, paths, ways = combined(lattice, own, best)
                        ids = np.frombuffer(raw, dtype=lattice.width)
                        out.append((doc, len(ids), zlib.crc32(ids.astype("<u4")), paths[0][0], [s for s, _ in paths], [k for _, k in paths], decode(lattice, ids) == text))
                        if with_ids:
                            best_ids.append(ids)
                            changes.append([[(place, cut, np.frombuffer(i, dtype=lattice.width).tolist()) for place, cut, i in way] for way in ways])
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                    if with_ids:
                        cuts = np.cumsum([0, *map(len, best_ids)], dtype=np.int32)
                        columns += [pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(best_ids).astype(np.int64))), pa.array(changes, changed)]
                    yield pa.RecordBatch.from_arrays([*columns, *(part.column(c) for c in keep)], names=names)
        finally:
            gc.enable()

    return docs.select("doc_id", "text", *keep).mapInArrow(run, SCHEMA + IDS * with_ids + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)
