import numpy as np
from pyspark.sql import functions as F

from verstore.llm import vector_search


def test_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 32))
    x = (centres[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 32))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:400] = x[100]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    bad = [(5000, None, ""), (5020, [0.0] * 32, ""), (5040, [float("nan")] * 32, ""), (5060, [1.0] * 7, ""), (5080, [None] * 32, ""), (None, x[0].tolist(), "")]
    d = spark.createDataFrame([*rows, *bad, rows[7]], "vec_id bigint, embedding array<float>, score string")
    got = {}
    for r in vector_search.search(d, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r["score"]))
    assert sorted(got) == list(range(0, 3000, 20))
    wide, hits = x.astype(np.float64), 0
    for q, found in got.items():
        s = wide @ wide[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -np.round(s, 10)))[:20]
        hits += len(set(best.tolist()) & {v for v, _ in found})
        assert len(found) == 20 and np.allclose([s[v] for v, _ in found], [v for _, v in found])
    assert hits >= 0.9 * 20 * len(got)
    assert [v for v, _ in got[100]] == list(range(101, 121))


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = vector_search.search(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2]
    assert vector_search.search(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
