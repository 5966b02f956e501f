"""Operator 10, n-gram Jaccard join by universe partition and pigeonhole.

A document's set holds its distinct 4-word shingles (64-bit hashes; other
lengths and shares by parameter).  Sizes fall into bands whose bounds grow by 1/0.85, so linked sets lie in one band or
in neighbours.  For a band the hash universe is cut into m segments, one more
than the largest symmetric difference of linked sets in it: at least one
segment of a linked pair is equal.

Allocation: the larger set probes.  With difference bound H it must spend H+1
on segments: 1 on one matched as a whole, 2 on one matched up to one deletion,
0 on one it leaves out.  It leaves out the costliest (empty and small segments,
which many sets share) first; if the rest can't add up, the spare segment 0 is
matched by one-deletion neighbourhoods, and only then empty segments are.

Candidates of a key become links only after both texts are read again and
compared exactly.  Copies are one class; within a key each set is first
compared with a hub, then in crowded keys with the one whose sketch is nearest,
then all pairs that still lie in different components are compared.
Parity sketches first drop pairs that provably differ too much; in crowded keys
blocks of sketches are compared in place, so that only pairs that pass become
rows.  So near copies don't multiply and no link between components is lost.

Defined cases: null, empty and blank texts have no shingles and stand alone;
rows with a null id have a null component and link nothing; rows that repeat
an id are one document with all their links; a text of any length counts whole
(its set is held by one worker, and to verify a candidate both texts'); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The query's words per shingle.
WORDS = 4
#: Linked in the query: 100 x intersection >= 85 x union.
PERCENT = 85
#: Ids sent to every executor at once, at most; beyond that they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Bits of a set's parity sketch; shingles gathered before they are signed.
SKETCH, HELD = 2048, 500_000
#: Sets from which a key counts as crowded; sets per block of sketches there.
CROWD, BLOCK = 48, 4096
#: Edges that one task contracts to a forest.
TREE = 250_000
#: Bytes of texts that are hashed at once; of one text, at most.
PART, LONG = 1 << 18, 1 << 22

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.ones(size, dtype=np.uint64)
        done = 1
        while done < size:
            have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have
    return have[:n]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; texts above LONG bytes are
    hashed slice by slice."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes: A-Z only
    long = [i for i, r in enumerate(raw) if len(r) > LONG]
    if not long:
        return _hashed(raw, words)
    out = _hashed([b"" if len(r) > LONG else r for r in raw], words)
    for i in long:
        out[i] = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(_hashed([part], words)[0] for part in _slices(raw[i], words))]))
    return out


def _slices(raw: bytes, words: int) -> Iterator[bytes]:
    """Slices at white space, each with the next words - 1 words: every shingle
    is in one, none is made up."""
    following = re.compile(rb"[\t-\r ]*(?:[^\t-\r ]+[\t-\r ]*){%d}" % (words - 1))
    at = 0
    while at < len(raw):
        gap = re.compile(rb"[\t-\r ]").search(raw, min(at + LONG, len(raw)))
        cut = gap.start() if gap else len(raw)
        if not raw[at:cut].strip(b" \t\n\v\f\r"):  # no word begins here
            at = cut
            continue
        more = following.match(raw, cut)
        if more is None or more.end() == len(raw):  # the last, with all that's left
            yield raw[at:]
            return
        yield raw[at : more.end()]
        at = cut


def _hashed(raw: list[bytes], words: int) -> list[np.ndarray]:
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)))
    word = mixed((sums[end - 1] - sums[start - 1]) * powers(_INVERSE, len(data))[start])
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    first = np.searchsorted(start, bounds)
    n = len(word) - words + 1
    if n > 0:
        mix = word[:n] * np.uint64(_ODD[0])
        for k in range(1, words):
            mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(_ODD[k % 4]) + word[k : k + n]
        gram = mixed(mix)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(gram[a : b - words + 1]))
        elif b > a:
            h = b - a
            for w in word[a:b].tolist():
                h = (h * _ODD[0] + w) % (1 << 64)
            out.append(mixed(np.array([h], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def exact_set(text: str, words: int = WORDS) -> set:
    """The shingles themselves, for exact comparison."""
    w = text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split(b" ")
    w = [x for x in w if x]
    if len(w) < words:
        return {b" ".join(w)} if w else set()
    return set(zip(*(w[k:] for k in range(words))))


_TO_SPACE = bytes(32 if _SPACE[i] else i for i in range(256))


def linked(a: set, b: set, percent: int = PERCENT) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not small or 100 * len(small) < percent * len(large):
        return False
    both = len(small & large)
    return 100 * both >= percent * (len(a) + len(b) - both)


def difference(total: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of linked sets with total elements."""
    return (100 - percent) * total // (100 + percent)


@cache
def band(n: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """(number, largest size, segments) of the band of size n >= 1."""
    k, low = 0, 1
    while True:
        high = low * 100 // percent
        if n <= high:
            return k, high, difference(high + high * 100 // percent, percent) + 1
        k, low = k + 1, high + 1


@cache
def band_below(n: int, percent: int = PERCENT) -> tuple[int, int, int] | None:
    k, low = 0, 1
    before = None
    while n > (high := low * 100 // percent):
        before = (k, high, difference(high + high * 100 // percent, percent) + 1)
        k, low = k + 1, high + 1
    return before


def _keys(number: int, segment: np.ndarray, size: np.ndarray, total: np.ndarray, reduced: bool = False) -> np.ndarray:
    tag = np.uint64((number * 2 + reduced) * _ODD[1] % (1 << 64))
    return mixed(total * np.uint64(_ODD[2]) + mixed(segment.astype(np.uint64) * np.uint64(_ODD[3]) + size.astype(np.uint64) + tag))


def allocation(sizes: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of segment sizes: which segments are probed as a whole, and in
    which rows segment 0 gets one-deletion neighbourhoods too.

    The largest (most selective) segments are taken first.
    """
    rank = np.empty_like(sizes)
    np.put_along_axis(rank, np.argsort(-sizes, axis=1, kind="stable"), np.arange(sizes.shape[1])[None, :], axis=1)
    full = (sizes > 0).sum(axis=1)
    spare = (full < need) & (sizes[:, 0] > 0)
    return rank < np.where(spare, np.maximum(full, need - 1), need)[:, None], spare


def signatures(sets: list[np.ndarray], number: int, high: int, m: int, own: bool, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set, key and role (1 indexed, 2 probes, 3 both) of what sets sign in one
    band: their own, or (probing alone) the one below."""
    lengths = np.array([len(s) for s in sets])
    every, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
    at = ((every >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    cell = row * m + at  # ascending, as the hashes are sorted
    sizes = np.bincount(cell, minlength=len(sets) * m)
    marks = mixed(every ^ np.uint64(_ODD[0]))
    total = np.zeros(len(sets) * m, dtype=np.uint64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1])
    total[cell[first]] = np.add.reduceat(marks, first)
    chosen, spare = allocation(sizes.reshape(-1, m), np.array([difference(n + min(n, high), percent) for n in lengths.tolist()]) + 1)
    role = chosen.ravel().astype(np.int8) * 2 + np.int8(own)
    signed = np.flatnonzero(role)
    out = [(signed // m, _keys(number, signed % m, sizes[signed], total[signed]), role[signed])]
    # segment 0 without one element each
    less = np.flatnonzero(at == 0)
    rows = row[less]
    zero, one, without = np.zeros(len(less), dtype=np.int64), sizes[rows * m] - 1, total[rows * m] - marks[less]
    if own:
        out.append((rows, _keys(number, zero, one, without, True), np.full(len(less), 1, dtype=np.int8)))
    if spare.any():
        mine, probing = np.flatnonzero(spare), spare[rows]
        out.append((mine, _keys(number, np.zeros(len(mine), dtype=np.int64), sizes[mine * m], total[mine * m], True), np.full(len(mine), 2, dtype=np.int8)))
        out.append((rows[probing], _keys(number, zero[probing], one[probing], without[probing]), np.full(int(probing.sum()), 2, dtype=np.int8)))
    return tuple(np.concatenate(x) for x in zip(*out))


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return int(s.sum(dtype=np.uint64)), int(mixed(s ^ np.uint64(_ODD[1])).sum(dtype=np.uint64))


def parity(s: np.ndarray) -> bytes:
    """For each of SKETCH hash classes, whether it holds an odd number of
    elements: two sketches differ in no more bits than the sets in elements."""
    return np.packbits(np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1).tobytes()


def _described(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    signed = lambda v: pa.array(np.array(v, dtype=np.uint64).view(np.int64))
    for batch in batches:
        for part in common.pieces(batch, "text", PART):
            sets = shingle_sets(common.texts_of(part), words)
            marks = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), signed([a for a, _ in marks]), signed([b for _, b in marks]), pa.array([parity(s) for s in sets], pa.binary())], names=["doc_id", "n_shingles", "one", "two", "sketch"])


def _signed(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[int, int, int]] = set()  # copies within a task sign once
    docs: list[int] = []
    sets: list[np.ndarray] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal docs, sets, held
        groups: dict[tuple, list[int]] = {}
        for i, s in enumerate(sets):
            groups.setdefault((*band(len(s), percent), True), []).append(i)
            below = band_below(len(s), percent)
            if below and 100 * below[1] >= percent * len(s):
                groups.setdefault((*below, False), []).append(i)
        ids, n = np.array(docs, dtype=np.int64), np.array([len(s) for s in sets], dtype=np.int32)
        for group, members in groups.items():
            row, key, role = signatures([sets[i] for i in members], *group, percent)
            own = np.array(members)[row]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[own]), pa.array(n[own]), pa.array(role)], names=["key", "id", "n", "role"])
        docs, sets, held = [], [], 0

    for batch in batches:
        for part in common.pieces(batch, "text", PART):
            for doc, s in zip(part.column("doc_id").to_pylist(), shingle_sets(common.texts_of(part), words)):
                if doc is None or not len(s) or (mark := (len(s), *digest(s))) in seen:
                    continue
                seen.add(mark)
                docs.append(doc)
                sets.append(s)
                held += len(s)
            if held >= HELD:
                yield from flush()
    yield from flush()


def only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) the given distinct ids."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def possible(rows: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs that their sketches don't rule out: the sets differ in as many
    elements as the sketches in bits, at least.  An id that rows repeat has
    more than one sketch; its pairs come as often as these leave them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            total = batch.column("total").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array((100 + percent) * apart <= (100 - percent) * total))

    sketch = rows.select("doc_id", "n_shingles", "sketch").where("doc_id IS NOT NULL")
    both = pairs.join(sketch.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sketch_a")), "a").join(sketch.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sketch_b")), "b")
    return both.select("a", "b", (F.col("na") + F.col("nb")).alias("total"), "sketch_a", "sketch_b").mapInArrow(run, "a bigint, b bigint")


def crowded(rows: DataFrame, groups: DataFrame, nearest: bool = False, percent: int = PERCENT) -> DataFrame:
    """The pairs within keys (of key, id, n, role, label, size) that sizes,
    roles, labels and sketches don't rule out; or of these each set's nearest.

    A key's sets are dealt into blocks and each pair of blocks is a group of its
    own, compared in memory.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    sketch = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "sketch")
    dealt = groups.withColumn("blocks", blocks).withColumn("at", F.pmod(F.xxhash64("id"), "blocks").cast("int")).join(sketch, "id")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = dealt.withColumn("other", other).select("key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "id", "n", "role", "label", "sketch")

    def run(table: pa.Table) -> pa.Table:
        at, ids, n, role, label = (table.column(c).to_numpy() for c in ("at", "id", "n", "role", "label"))
        n = n.astype(np.int64)
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
        first, second = np.flatnonzero(at == at.min()), np.flatnonzero(at == at.max())
        found_a, found_b = [], []
        if table.column("i")[0].as_py() == table.column("j")[0].as_py() or at.min() != at.max():
            for k in first.tolist():
                y = second
                y = y[(label[y] != label[k]) & (100 * np.minimum(n[y], n[k]) >= percent * np.maximum(n[y], n[k]))]
                y = y[(n[y] <= n[k]) & (role[k] >= 2) & (role[y] % 2 == 1) | (n[k] <= n[y]) & (role[y] >= 2) & (role[k] % 2 == 1)]
                if not len(y):
                    continue
                apart = np.bitwise_count(bits[y] ^ bits[k]).sum(axis=1, dtype=np.int64)
                near = (100 + percent) * apart <= (100 - percent) * (n[y] + n[k])
                y, apart = y[near], apart[near]
                if nearest and len(y):
                    y = y[[np.argmin(apart)]]
                found_a.append(np.minimum(ids[y], ids[k]))
                found_b.append(np.maximum(ids[y], ids[k]))
        none = [np.zeros(0, dtype=np.int64)]
        return pa.table({"a": np.concatenate(found_a or none), "b": np.concatenate(found_b or none)}).group_by(["a", "b"]).aggregate([])

    return paired.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def verified(docs: DataFrame, pairs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b), those that sketches leave, whose texts are linked."""
    pairs = common.stored(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = only(docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL"), ids, "left_semi")
    texts = common.stored(texts)
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x = batch.column("text_b")[i].as_py()
                if x != last:
                    last, own = x, exact_set(x, words)
                keep.append(linked(own, exact_set(batch.column("text_a")[i].as_py(), words), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(left, "a").join(right, "b")
    out = common.stored(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint"))
    common.discard(pairs, texts)
    return out


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's edges: each node but the smallest with the
    smallest node of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for k in range(0, len(nodes), 1 << 16):
        part = [(x, r) for x in nodes[k : k + (1 << 16)] if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable, for every node with a smaller
    one; edges is a stored table, which is read twice.

    Each task first contracts TREE edges or so to a forest.  If that was all in
    one task, its trees are the components; else labels go over the forests'
    edges, with pointer jumping, until none changes.
    """
    tasks = max(1, -(-edges.count() // TREE))
    forest = edges.select("a", "b").where("a != b").coalesce(tasks).mapInArrow(_forest, "a bigint, b bigint")
    if tasks == 1:
        return common.stored(forest.select(F.col("a").alias("node"), F.col("b").alias("label")))
    both = common.stored(forest.unionAll(forest.select("b", "a")).distinct())
    labels = common.stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    last = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = common.stored(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        common.discard(last)
        last, labels = step, step.select("node", "label")
        if step.where("old != label").isEmpty():
            common.discard(both)
            return labels.where("node != label")


def sent(few: DataFrame) -> DataFrame:
    """A stored table for a join: broadcast up to BROADCAST_IDS rows."""
    return F.broadcast(few) if few.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else few


def unsettled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of keys whose sets lie in several components, with label and
    the key's size.  Keys are summed up apart, so a hot one can be split."""
    labelled = shared.join(sent(labels.withColumnRenamed("node", "id")), "id", "left").select("key", "id", "n", "role", F.coalesce("label", "id").alias("label"))
    keys = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).where("low != high").select("key", "size")
    return common.stored(labelled.join(keys, "key"))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs; sets of shingles of
    words words are linked from percent hundredths of their union on."""
    docs = docs.select("doc_id", "text")
    rows = common.stored(docs.mapInArrow(lambda batches: _described(batches, words), "doc_id bigint, n_shingles bigint, one bigint, two bigint, sketch binary"))
    known = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    mark = ["n_shingles", "one", "two"]
    classes = common.stored(known.groupBy(*mark).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    # where rows repeat an id with other texts, the id's classes are one
    repeated = known.join(classes.select(*mark, "rep"), mark).groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("z"), F.collect_set("rep").alias("reps")).where("b != z").select(F.explode("reps").alias("a"), "b")

    signed = docs.mapInArrow(lambda batches: _signed(batches, words, percent), "key bigint, id bigint, n int, role tinyint")
    by_key = Window.partitionBy("key")
    hub = F.min_by(F.struct("id", "n"), F.xxhash64("id")).over(by_key)
    shared = common.stored(signed.withColumn("c", F.count(F.lit(1)).over(by_key)).withColumn("hub", hub).where("c > 1").drop("c"))
    crowds = F.col("size") > CROWD

    # each set with one other of its key
    stars = shared.where(f"hub.id != id AND 100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)").groupBy(F.col("id").alias("a")).agg(F.min("hub.id").alias("b"))
    edges = common.stored(repeated).unionByName(verified(docs, possible(rows, stars, percent), words, percent))
    groups = unsettled(shared, components(edges))
    if not groups.where(crowds).isEmpty():  # the nearest ones first
        edges = edges.unionByName(verified(docs, crowded(rows, groups.where(crowds), True, percent), words, percent))
        common.discard(groups)
        groups = unsettled(shared, components(edges))
    common.discard(shared)
    few = groups.where(~crowds)
    probing = few.where("role >= 2").select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    indexed = few.where("role % 2 = 1").select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    rest = probing.join(indexed, "key").where(f"la != lb AND nb <= na AND 100 * nb >= {percent} * na").select("a", "b").distinct()
    rest = possible(rows, rest, percent)
    if not groups.where(crowds).isEmpty():
        rest = rest.unionByName(crowded(rows, groups.where(crowds), percent=percent)).distinct()
    edges = edges.unionByName(verified(docs, rest, words, percent))
    common.discard(groups)
    # a set signs under any of its copies' ids: tie them to the class
    signers = edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ties = known.join(signers, "doc_id", "left_semi").join(classes.where("copies > 1").select(*mark, "rep"), mark).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = components(edges.unionByName(common.stored(ties)))
    of_class = classes.join(sent(labels.withColumnRenamed("node", "rep")), "rep", "left").select(*mark, F.coalesce("label", "rep").alias("component_id"))
    return rows.join(of_class, mark, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


def oracle() -> str:
    """SQL for small tables: all pairs that share a shingle, then all labels
    that reach a document."""
    words = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    ahead = ", ".join(f"lead(word, {k}) OVER following" for k in range(1, WORDS))
    return f"""WITH RECURSIVE split AS (SELECT doc_id, {words} AS words FROM documents),
    places AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split),
    grams AS (SELECT doc_id, concat_ws(' ', word, {ahead}) AS shingle, lead(word, {WORDS - 1}) OVER following IS NOT NULL AS whole
        FROM places WINDOW following AS (PARTITION BY doc_id ORDER BY place)),
    shingles AS (SELECT DISTINCT doc_id, shingle FROM grams WHERE whole UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM split WHERE len(words) BETWEEN 1 AND {WORDS - 1}),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    paired AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (SELECT a, b FROM paired JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= {PERCENT} * (x.n + y.n - shared)),
    reached AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT links.b, reached.label FROM reached JOIN links ON links.a = reached.node)
    SELECT node AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(label) AS component_id FROM reached LEFT JOIN sizes ON sizes.doc_id = node GROUP BY node"""
