"""Operator 9, nearest neighbours by an adaptive dimension scan.

Vectors are grouped into lists around k-means centres; a query scans the lists
nearest to it.  Inner products become distances by one more coordinate,
sqrt(M^2 - |x|^2).  All vectors are turned by one random rotation; within a
list the distance grows by blocks of columns, and after each block a
hypothesis test drops candidates: were the whole distance within the query's
k-th one, the rotation would give a partial distance as long as this one in a
share of ERROR cases only (a quantile of the Beta distribution).  What
survives is measured in double precision on the original vectors.

The limit adapts: it falls while a list is scanned, chunk by chunk, and a
query's NEAR nearest lists are scanned first, so that the others begin with the
k-th score found there.

Equal vectors are one class: it is searched once and carries its k+1 smallest
ids, which is all that ties to smaller ids can ask for, so copies never
multiply.  Large lists and many queries of one list are split.

Defined cases: vectors that are null, zero or hold null or non-finite numbers
take no part, nor do those of another length than the commonest; rows with a
null id neither; repeated rows with one id are one candidate; other columns
are ignored; without queries or candidates there are no rows.  Components keep
their type: a column of doubles is scored on doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from . import common

#: Neighbours; vectors the index is fitted on, at most; columns per block; share of true neighbours a test may drop.
K, SAMPLE, BLOCK, ERROR = 20, 16_384, 16, 0.01
#: Share of true neighbours the probed lists must hold on the sample; vectors and queries in one task's group.
RECALL, GROUP = 0.95, 4096
#: Lists per square root of the vectors, sampled vectors per list at least, share of the probed lists that are scanned first.
LISTS, PER_LIST, NEAR = 2, 8, 1 / 8
#: Vectors and queries compared at once; share of live pairs from which whole blocks are multiplied.
CHUNK, AT_ONCE, DENSE = 1024, 256, 0.2
CELLS = 1 << 21


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half, step = 0.5 * (centres**2).sum(axis=1), max(1, CELLS // len(centres))
    return np.concatenate([np.zeros(0, dtype=np.int64), *((x[a : a + step] @ centres.T - half).argmax(axis=1) for a in range(0, len(x), step))])


def allowed(width: int, error: float = ERROR, seed: int = 23) -> np.ndarray:
    """For d = 0..width: the share of a squared distance that d of width turned
    coordinates exceed in a share error of cases, Beta(d/2, (width-d)/2)."""
    rng, out = np.random.default_rng(seed), np.ones(width + 1)
    for d in range(BLOCK, width, BLOCK):
        seen = rng.chisquare(d, 1 << 16)
        out[d] = np.quantile(seen / (seen + rng.chisquare(width - d, 1 << 16)), 1 - error)
    return out


class Index:
    """Rotation, centres, tests and number of lists to probe, fitted on a sample."""

    def __init__(self, sample: np.ndarray, longest: float, lists: int, k: int = K, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.longest = longest
        x = self.lift(sample)
        self.rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
        self.allowed = allowed(x.shape[1])
        x = x @ self.rotation
        lists = max(1, min(lists, len(x) // PER_LIST))
        self.centres = x[rng.choice(len(x), lists, replace=False)].copy()
        for _ in range(8):
            own = nearest_centres(x, self.centres)
            n = np.bincount(own, minlength=lists)
            sums = np.stack([np.bincount(own, x[:, j], lists) for j in range(x.shape[1])], axis=1)
            self.centres[n > 0] = sums[n > 0] / n[n > 0, None]
        self.probes = self.enough(sample, nearest_centres(x, self.centres), k)
        self.near = max(1, int(self.probes * NEAR))

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.longest**2 - (x**2).sum(axis=1), 0))[:, None]], axis=1)

    def turned(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated vectors; queries get the length M and no further coordinate."""
        if query:
            x = np.concatenate([x * (self.longest / np.linalg.norm(x, axis=1, keepdims=True)), np.zeros((len(x), 1))], axis=1)
        else:
            x = self.lift(x)
        return x @ self.rotation

    def order(self, queries: np.ndarray) -> np.ndarray:
        """The lists of each rotated query, nearest first."""
        half, step = 0.5 * (self.centres**2).sum(axis=1), max(1, CELLS // len(self.centres))
        return np.concatenate([np.zeros((0, len(half)), dtype=np.int64), *(np.argsort(half - queries[a : a + step] @ self.centres.T, axis=1, kind="stable") for a in range(0, len(queries), step))])

    def enough(self, sample: np.ndarray, own: np.ndarray, k: int) -> int:
        asked = np.arange(0, len(sample), max(1, len(sample) // 400))
        near = sample[asked] @ sample.T
        near[np.arange(len(asked)), asked] = -np.inf
        best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        place = np.argsort(self.order(self.turned(sample[asked], query=True)), axis=1)
        needed = np.sort(place[np.arange(len(asked))[:, None], own[best]].ravel())
        return int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) + 1 if len(needed) else 1

    def limit(self, queries: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The squared distance of vectors with these scores (inner products)."""
        return 2 * self.longest**2 - 2 * self.longest / np.linalg.norm(queries, axis=1) * scores


def survivors(index: Index, x: np.ndarray, q: np.ndarray, limit: np.ndarray, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (query, vector) that no test drops; left gets the pairs alive
    after each block added."""
    width = x.shape[1]
    stop = lambda d: limit * index.allowed[d] + 1e-9 * index.longest**2
    block = lambda a, b: (q[:, a:b] ** 2).sum(axis=1)[:, None] + (x[:, a:b] ** 2).sum(axis=1)[None, :] - 2 * q[:, a:b] @ x[:, a:b].T
    seen = min(BLOCK, width)
    dense = block(0, seen)
    alive = dense <= stop(seen)[:, None]
    qi = xi = d = None
    while True:
        n = int(alive.sum()) if qi is None else len(qi)
        if left is not None:
            left[(seen - 1) // BLOCK] += n
        if seen == width:
            return np.nonzero(alive) if qi is None else (qi, xi)
        to = min(seen + BLOCK, width)
        if qi is None and n > DENSE * alive.size:
            dense += block(seen, to)
            alive &= dense <= stop(to)[:, None]
        else:
            if qi is None:
                qi, xi = np.nonzero(alive)
                d = dense[qi, xi]
            d += ((q[qi, seen:to] - x[xi, seen:to]) ** 2).sum(axis=1)
            keep = d <= stop(to)[qi]
            qi, xi, d = qi[keep], xi[keep], d[keep]
        seen = to


def scan(index: Index, k: int, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray | None = None, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, class, score) of up to k classes for each query of one group;
    floor has the k-th score that each query has found elsewhere."""
    x, q = index.turned(vectors), index.turned(queries, query=True)
    limit = np.full(len(q), np.inf) if floor is None else index.limit(queries, floor)
    out = ([], [], [])
    for a in range(0, len(q), AT_ONCE):
        part, own = slice(a, a + AT_ONCE), limit[a : a + AT_ONCE]
        top_q, top_x, top_s = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        for b in range(0, len(x), CHUNK):
            qi, xi = survivors(index, x[b : b + CHUNK], q[part], own, left)
            xi = xi + b
            score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", queries[a + qi[c : c + CELLS // 64]], vectors[xi[c : c + CELLS // 64]]) for c in range(0, len(qi), CELLS // 64))])
            qi, xi, score = np.concatenate([top_q, qi]), np.concatenate([top_x, xi]), np.concatenate([top_s, score])
            at = np.lexsort((ids[xi], -score, qi))
            qi, xi, score = qi[at], xi[at], score[at]
            rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
            top_q, top_x, top_s = qi[rank < k], xi[rank < k], score[rank < k]
            last = rank == k - 1
            own[qi[last]] = np.minimum(own[qi[last]], index.limit(queries[a + qi[last]], score[last]))
        for into, v in zip(out, (query_ids[a + top_q], ids[top_x], top_s)):
            into.append(v)
    return tuple(np.concatenate(v) for v in out)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found."""
    spark = vectors.sparkSession
    kind = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "double"
    good = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = float('inf')) AND exists(embedding, x -> x != 0)")
    sizes = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    good = good.where(F.size("embedding") == sizes[0]["d"]).withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))).distinct()
    firsts = good.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    # at most k+1 ids per class
    classes = common.stored(firsts.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.col("ids")[0]))
    asked = common.stored(good.where(is_query).join(classes.select("embedding", "cid"), "embedding").select("vec_id", "cid"))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, longest = classes.agg(F.count(F.lit(1)), F.max(F.sqrt(square))).first()
    picked = classes.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("embedding").toArrow()
    index = Index(matrix(picked.column("embedding").combine_chunks()), longest * (1 + 1e-9), int(LISTS * np.sqrt(n)), k)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = nearest_centres(index.turned(matrix(b.column("embedding"))), index.centres)
                yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("embedding"), pa.array(own, pa.int32())], names=["cid", "embedding", "list"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists = index.order(index.turned(matrix(b.column("embedding")), query=True))[:, : index.probes]
                yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("embedding"), pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32()))], names=["cid", "embedding", "lists"])

    placed = common.stored(classes.select("cid", "embedding").mapInArrow(listed, f"cid bigint, embedding array<{kind}>, list int"))
    asking = classes.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "embedding")
    asking = common.stored(asking.mapInArrow(probed, f"cid bigint, embedding array<{kind}>, lists array<int>"))
    xs = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("xs"))
    order = [F.desc("score"), "vec_id"]

    def group(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"asked": pd.Series(dtype="int64"), "cid": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        a, b = a.sort_values("cid"), b.sort_values("cid")
        got = scan(index, k + 1, stacked(a["embedding"]), a["cid"].to_numpy(), stacked(b["embedding"]), b["cid"].to_numpy(), b["floor"].to_numpy(dtype=np.float64))
        return pd.DataFrame(dict(zip(("asked", "cid", "score"), got)))

    def scanned(probes: DataFrame) -> DataFrame:
        """What queries (cid, embedding, floor, list) find in their lists; lists
        and their queries are dealt into parts, and only then shuffled."""
        qs = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("qs"))
        parts = F.broadcast(xs.join(qs, "list"))  # a row per list: SAMPLE / PER_LIST at most
        spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        salt = lambda c: F.pmod(F.xxhash64("cid"), F.col(c)).cast("int")
        left = placed.join(parts, "list").select("list", "cid", "embedding", salt("xs").alias("x"), spread("qs").alias("q"))
        right = probes.join(parts, "list").select("list", "cid", "embedding", "floor", spread("xs").alias("x"), salt("qs").alias("q"))
        keys = ["list", "x", "q"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(group, "asked bigint, cid bigint, score double")

    def best_of(found: DataFrame) -> DataFrame:
        return found.withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "cid"))).where(F.col("n") <= k + 1)

    near = asking.select("cid", "embedding", F.lit(float("-inf")).alias("floor"), F.explode(F.slice("lists", 1, index.near)).alias("list"))
    first = common.stored(best_of(scanned(near)))
    floors = first.where(F.col("n") == k + 1).select(F.col("asked").alias("cid"), F.col("score").alias("floor"))
    far = asking.join(floors, "cid", "left").select("cid", "embedding", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), F.explode(F.slice("lists", index.near + 1, index.probes)).alias("list"))
    best = best_of(first.drop("n").unionByName(scanned(far)))
    best = best.join(classes.select("cid", "ids"), "cid").select("asked", "score", F.explode("ids").alias("vec_id"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy(*order))).where(F.col("n") <= k + 1)
    rows = asked.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("asked")).join(best, "asked").where("query_id != vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
