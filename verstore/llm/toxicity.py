"""Operator 3, toxicity: a counterfactual-regularised linear classifier.

A document's score is the logistic function of a sum over its distinct words;
a word adds its own weight and those of its first 4, 5 and 6 letters.  Training
minimises log loss + L1 + COUNTERFACTUAL x the squared score change between a
labelled text and the same text with its identity terms swapped for others of
their kind, so that a neutral mention of a group moves no score.

Labels come from at most SAMPLE rows per class (a documented bound; the rows
with the smallest id hashes); scores cover every whole text.  One executor task
gathers the sample's features and fits; the driver gets the weights alone.

Defined cases: a text of any length is scored and trained on whole, by its
distinct words; null and empty texts get the score of a text without words;
labels that are null count as none, of repeated labels the greatest holds;
null doc_ids are scored and held out; without labels of both classes the score
is 0 for all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows per class used for training, at most.
SAMPLE = {1: 4000, 0: 8000}
#: Feature buckets; the penalty on score changes; the L1 and L2 weights; the threshold.
BUCKETS, COUNTERFACTUAL, LASSO, RIDGE, THRESHOLD = 1 << 20, 4.0, 2e-4, 1e-4, 0.3
#: Buckets chosen by their difference between the classes, at most; words a worker keeps.
STRONGEST, CACHED = 20_000, 400_000

#: Identity terms by kind; a swap stays within its kind.
IDENTITIES = {
    "religion": "muslim christian jewish hindu buddhist atheist catholic protestant sikh musulman chrétien juif musulmán cristiano judío muslimisch christlich jüdisch",
    "religious": "muslims christians jews hindus buddhists atheists catholics protestants sikhs",
    "origin": "african american asian european mexican chinese indian arab latino black white african-american",
    "nation": "french german spanish english italian polish turkish russian japanese korean",
    "gender": "woman man female male girl boy femme homme mujer hombre frau mann",
    "genders": "women men females males girls boys femmes hommes mujeres hombres frauen männer",
    "orientation": "gay straight lesbian bisexual heterosexual homosexual transgender queer",
    "age": "young old teenage elderly",
    "ability": "disabled blind deaf paralyzed",
}
SWAP = {w: words[(i + 1) % len(words)] for words in (v.split() for v in IDENTITIES.values()) for i, w in enumerate(words)}
WORDS = re.compile(r"\w+").findall


def features(word: str) -> list[int]:
    """Buckets of a word: itself and its openings."""
    raw = word.encode("utf-8", "surrogatepass")
    return [zlib.crc32(raw) % BUCKETS, *(zlib.crc32(b"^" + word[:k].encode("utf-8", "surrogatepass")) % BUCKETS for k in (4, 5, 6) if len(word) >= k)]


class Buckets(dict):
    def __missing__(self, word: str) -> list[int]:
        if len(self) >= CACHED:
            self.clear()
        found = self[word] = features(word)
        return found


def labelled(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """toxic, and the buckets of the text and of its swapped twin (if any)."""
    ids = labels.where(F.col("toxic").isNotNull() & ~common.held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    picked = [ids.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in sample.items()]
    # a broadcast of at most sum(sample) ids
    rows = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionAll(picked[1])), "doc_id").where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            for part in common.pieces(batch, "text"):
                own, twins = [], []
                for text in common.texts_of(part):
                    words = set(WORDS(text.lower()))
                    own.append([b for w in sorted(words) for b in buckets[w]])
                    named = words & SWAP.keys()
                    twins.append([b for w in sorted(words - named | {SWAP[w] for w in named}) for b in buckets[w]] if named else None)
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(own, pa.list_(pa.int32())), pa.array(twins, pa.list_(pa.int32()))], names=["toxic", "own", "twin"])

    return rows.mapInArrow(run, "toxic int, own array<int>, twin array<int>")


class Sparse:
    """Rows of counted features, for products with weights."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(r) for r in rows])
        self.col = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, dtype=np.int32)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, r[self.row], width)


def strongest(y: np.ndarray, own: list[np.ndarray]) -> np.ndarray:
    """Buckets whose shares of the two classes' rows differ, and the identity terms'."""
    df = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for label, row in zip(y, own):
        df[label][np.unique(row)] += 1
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    share = (df[1] + df[0]) / len(y)
    z = (df[1] / n1 - df[0] / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    strong = np.flatnonzero((np.abs(z) >= 4) & (df[1] + df[0] >= 5))
    return np.union1d(strong[np.argsort(-np.abs(z[strong]), kind="stable")[:STRONGEST]], np.unique([b for w in SWAP for b in features(w)]))


def objective(y: np.ndarray, x: Sparse, here: Sparse, there: Sparse, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
    """Log loss + ridge + COUNTERFACTUAL x mean squared score change of the swapped
    rows (here) and their twins (there), with its gradients by w and b."""
    s = x.dot(w) + b
    r = (1 / (1 + np.exp(-np.clip(s, -40, 40))) - y) / len(y)
    loss = float((np.logaddexp(0, s) - y * s).mean()) + RIDGE / 2 * float(w @ w)
    g = x.back(r, len(w)) + RIDGE * w
    if here.n:
        change = here.dot(w) - there.dot(w)
        loss += COUNTERFACTUAL * float((change**2).mean())
        g += 2 * COUNTERFACTUAL / here.n * (here.back(change, len(w)) - there.back(change, len(w)))
    return loss, g, float(r.sum())


def fit(y: np.ndarray, own: list[np.ndarray], twins: list[np.ndarray | None], prior: float, steps: int = 400) -> tuple[np.ndarray, np.ndarray, float]:
    """Chosen buckets, their weights and the intercept at the true share prior."""
    if not len(y) or y.min() == y.max():
        return np.zeros(0, dtype=np.int64), np.zeros(0), -np.inf
    chosen = strongest(y, own)
    slot = np.full(BUCKETS, -1, dtype=np.int32)
    slot[chosen] = np.arange(len(chosen))
    narrow = lambda r: (s := slot[r])[s >= 0]
    pairs = [i for i, t in enumerate(twins) if t is not None]
    x, here, there = Sparse([narrow(r) for r in own]), Sparse([narrow(own[i]) for i in pairs]), Sparse([narrow(twins[i]) for i in pairs])
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    w, b, width = np.zeros(len(chosen)), float(np.log(n1 / n0)), len(chosen)
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam, then the L1 shrinkage
        _, g, gb = objective(y, x, here, there, w, b)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 * (1 - t / (steps + 1))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * LASSO * 10, 0)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    b += float(np.log(prior / (1 - prior)) - np.log(n1 / n0))
    return chosen[w != 0], w[w != 0], b


def _fitted(batches: Iterator[pa.RecordBatch], prior: float) -> Iterator[pa.RecordBatch]:
    """The weights of the rows of labelled, with the intercept as bucket -1."""
    y, own, twins = [], [], []
    for batch in batches:
        y += batch.column("toxic").to_pylist()
        for into, name in ((own, "own"), (twins, "twin")):
            lists = batch.column(name)
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            into += [values[a:b].copy() if ok else None for a, b, ok in zip(ends[:-1], ends[1:], lists.is_valid().to_numpy(zero_copy_only=False))]
    order = sorted(range(len(y)), key=lambda i: (y[i], own[i].tobytes()))  # sums don't depend on the order of arrival
    chosen, weights, intercept = fit(np.array(y, dtype=np.int64)[order], [own[i] for i in order], [twins[i] for i in order], prior)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *chosen.tolist()], pa.int64()), pa.array([intercept, *weights.tolist()], pa.float64())], names=["bucket", "weight"])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, weights and intercept; at most STRONGEST rows (and the identity
    terms') come to the driver."""
    share = labels.where(F.col("toxic").isNotNull() & ~common.held_out()).agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    if not 0 < (share or 0) < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0), -np.inf
    # one partition: at most sum(SAMPLE) rows
    rows = labelled(docs, labels).repartition(1).mapInArrow(lambda batches: _fitted(batches, share), "bucket bigint, weight double").collect()
    got = {r.bucket: r.weight for r in rows}
    intercept = got.pop(-1, -np.inf)  # none: no labelled row has a text
    chosen = np.array(sorted(got), dtype=np.int64)
    return chosen, np.array([got[b] for b in chosen.tolist()], dtype=np.float64), intercept


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with the score and the prediction, in columns that replace any of
    the same names; reads text alone of its columns."""
    chosen, weights, intercept = model
    docs = docs.drop(*into)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = dict(zip(chosen.tolist(), weights.tolist()))

        class Weights(dict):
            def __missing__(self, word: str) -> float:
                if len(self) >= CACHED:
                    self.clear()
                w = self[word] = sum(by_bucket.get(b, 0.0) for b in features(word))
                return w

        weigh = Weights().__getitem__
        for batch in batches:
            for part in common.pieces(batch, "text"):
                # sorted by value: equal texts get equal sums in any process
                sums = np.array([intercept + sum(sorted(map(weigh, set(WORDS(t.lower()))))) for t in common.texts_of(part)], dtype=np.float64)
                p = np.where(np.isfinite(sums), 1 / (1 + np.exp(-np.clip(sums, -500, 500))), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[*names, *into])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{into[0]}` double, `{into[1]}` int"])
    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", common.held_out().alias("held_out"), "text"), train(docs, labels))
    return scored.select("doc_id", "held_out", "score", "predicted")
