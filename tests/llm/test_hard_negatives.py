import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id string, score string"


def brute(rows, is_anchor, low=30, high=90):
    best = {}
    for i, v, c in rows:
        if i is None or v is None or c is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (str(c), [float(np.float32(x)) for x in v])
        best[i] = min(best.get(i, row), row)
    whole = {i: (c, [math.floor(256 * x) for x in v]) for i, (c, v) in best.items()}
    out = []
    for a, (c, v) in whole.items():
        if not is_anchor(a):
            continue
        pairs = sorted((-sum(x * y for x, y in zip(v, w)), i, d == c) for i, (d, w) in whole.items() if i != a and len(w) == len(v))
        for s, p, same in [x for x in pairs if x[2]][:5]:
            fit = [(n, -t) for t, n, other in pairs if not other and low * -s <= 100 * -t <= high * -s][:10]
            out += [(a, p, k + 1, n, -s, t) for k, (n, t) in enumerate(fit)]
    return sorted(out)


def some_rows():
    g = np.random.default_rng(2)
    rows = [(i, (g.normal(size=8) + (i % 4 == 1)).tolist(), int(g.integers(0, 4))) for i in range(600)]
    rows += [(1000 + i, [1.0] * 8, 1 + i % 2) for i in range(120)]  # ties: one vector under two labels
    rows += [(2000 + 10 * i, [0.0] * 8, i % 2) for i in range(4)] + [(1990, [0.0] * 8, 1)]  # scores of zero
    rows += [(3000, None, 1), (3010, [1.0] * 8, None), (3020, [float("nan")] * 8, 1), (3030, [None] * 8, 1), (None, [1.0] * 8, 1),
             (3040, [2.0, 3.0], 1), (3041, [2.0, 3.5], 1), (3042, [1.0, 1.0], 2), (3050, [], 1), (3051, [], 1), (3052, [], 2),
             (20, [9.0] * 8, 0), rows[30], rows[30]]
    return rows


@pytest.mark.parametrize("shard_rows", [40, 100_000])
def test_against_all_pairs(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(hard_negatives, "CELLS", 5000)
    rows = some_rows()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, shard_rows=shard_rows)
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 1000 and any(w[4] == 0 for w in want)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_large_products_stay_exact():
    a, b = np.array([[1 << 25, 1, (1 << 25) - 1]]), np.array([[1 << 25, 1, 1 << 25], [1 << 25, 0, 1 << 25]])
    got = hard_negatives.products(a, b, 1 << 25)
    assert got.tolist() == [[(1 << 50) + 1 + ((1 << 25) - 1 << 25), (1 << 50) + ((1 << 25) - 1 << 25)]]
    wide = np.full((1, 64), (1 << 25) - 1)
    assert hard_negatives.products(wide, wide, 1 << 25).tolist() == [[64 * ((1 << 25) - 1) ** 2]]


def test_best_takes_earlier_columns_of_equals():
    score = np.array([[3, 5, 5, 5, 1], [1, 1, 1, 1, 1]])
    wanted = np.array([[True, True, True, True, True], [False, True, False, True, True]])
    assert hard_negatives.best(score, wanted, 2).tolist() == [[False, True, True, False, False], [False, True, False, True, False]]


def test_empty_and_lonely(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1, "x", "y"), (1, [0.5], 2, "x", "y")], SCHEMA)
    assert hard_negatives.mine(one, F.lit(True)).count() == 0
    assert hard_negatives.mine(one, F.lit(None).cast("boolean")).count() == 0
