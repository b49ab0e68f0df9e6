import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, vector string"


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok.setdefault(i, set()).add(tuple(np.float32(v).astype(float)))
    out = {}
    for i, vs in ok.items():
        if i % 5:
            continue
        q = np.array(min(vs))
        found = {}
        for j, ws in ok.items():
            for w in ws:
                if j != i and len(w) == len(q):
                    w = np.array(w)
                    found[j] = max(found.get(j, -2), float(q @ w / np.sqrt(q @ q) / np.sqrt(w @ w)))
        out[i] = sorted(found.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


@pytest.mark.parametrize("factor,shard_rows", [(1.0, 50), (1.0, 10_000)])
def test_factor_one_is_exact(spark, factor, shard_rows):
    g = np.random.default_rng(3)
    rows = [(i, g.normal(size=6).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]  # one common vector
    rows += [(2000, None), (2005, [0.0] * 6), (2010, [float("nan")] * 6), (2015, [1.0, None]), (2020, [float("inf"), 1.0]), (None, [1.0] * 6),
             (2025, [1.0, 2.0]), (2030, [2.0, 1.0]), (5, [9.0] * 6), rows[10], rows[10]]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 5 == 0, 5, factor, shard_rows).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, 5)
    assert set(got) == {i for i in want if want[i]}
    for i, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, len(want[i]) + 1))
        assert [x[1] for x in found] == [x[0] for x in want[i]]
        assert np.allclose([x[2] for x in found], [x[1] for x in want[i]], atol=1e-12)


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        c = v @ v[q]
        c[q] = -2
        top = ids[np.argsort(-c)[:5]]
        hit += sum((ids[q], j) in got for j in top)
        total += 5
    assert hit / total >= 0.9


def test_empty(spark):
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
