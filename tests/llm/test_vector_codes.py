import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide.llm import vector_codes
from voltide.llm.queries import op11_hilbert_vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, part string, code string"


def brute(rows, entries, rounds, parts=4):
    """Codes by plain integer loops over all entries; rows are (id, vector, label)."""
    kept = [(i, [float(np.float32(x)) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    vectors = [[math.floor(1024 * x) for x in v] + [0] * (width * parts - len(v)) for _, v, _ in kept]
    cut = lambda v, p: tuple(v[p * width:(p + 1) * width])
    books = [[cut(v, p) for v in vectors[:entries]] for p in range(parts)]

    def closest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in vectors:
                own[closest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [tuple(sum(c) // len(own[k]) for c in zip(*own[k])) if k in own else e for k, e in enumerate(books[p])]
    out, by_label = [], defaultdict(int)
    for (i, _, c), v in zip(kept, vectors):
        found = [closest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, c, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        by_label[c] += out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((*r, by_label[r[1]]) for r in out), key=str), digest


def some_rows():
    g = np.random.default_rng(5)
    centres = g.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + 0.2 * g.normal(size=16)).tolist(), i % 5 or None) for i in range(700)]
    rows += [(1000 + i, [0.5] * 16, 9) for i in range(300)]  # one vector that many rows share
    rows += [(None, [0.25] * 16, 3), rows[3], rows[3], (4, [-1.0] * 16, 1), (2000, None, 1), (2001, [float("nan")] * 16, 1),
             (2002, [None] * 16, 1), (2003, [float("inf")] + [0.0] * 15, 1), (2004, [1.0, -2.0, 3.0], None), (2005, [], 2), (2006, [-0.0] * 16, 2)]
    return rows


@pytest.mark.parametrize("entries,block_rows", [(32, 16), (256, 256)])
def test_codes_are_those_of_plain_k_means(spark, entries, block_rows):
    rows = some_rows()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    codes, books = vector_codes.compress(df, entries=entries, block_rows=block_rows)
    want, digest = brute(rows, entries, 4)
    assert sorted((tuple(r) for r in codes.collect()), key=str) == want
    assert books.sha256() == digest


def test_shortlists_keep_the_nearest_entry_and_drop_far_ones(spark):
    g = np.random.default_rng(1)
    book = g.integers(-2000, 2000, size=(256, 4))
    x = g.integers(-2000, 2000, size=(60, 1, 4)) + g.integers(0, 40, size=(60, 100, 4))
    lists = vector_codes.shortlists(x.min(axis=1), x.max(axis=1), book)
    for rows, mask in zip(x, lists):
        assert mask[vector_codes.nearest(rows, book)].all()
    assert lists.sum(axis=1).mean() < 20


def test_large_components_stay_exact():
    x = np.array([[(1 << 27) - 1, -(1 << 27), 5]])
    book = np.array([[(1 << 27) - 3, -(1 << 27), 5], [(1 << 27) - 2, -(1 << 27), 5], [(1 << 27) - 2, -(1 << 27), 5]])
    assert vector_codes.nearest(x, book).tolist() == [1]
    assert vector_codes.integers(np.array([[1e30, -1e300, 0.5, -0.0001]]), 1024).tolist() == [[1 << 29, -(1 << 29), 512, -1]]


@pytest.mark.parametrize("width,bits", [(2, 3), (3, 2), (1, 4)])
def test_neighbours_on_the_curve_are_neighbours(width, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * width, indexing="ij"), -1).reshape(-1, width)
    key = vector_codes.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_restored_vectors_are_near(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    codes, books = vector_codes.compress(df)
    back = {r.id: np.array(r.restored) for r in vector_codes.restore(codes, books).collect()}
    given = {r.vec_id: np.array(r.embedding) for r in df.collect()}
    off = np.mean([np.sum((back[i] - v) ** 2) for i, v in given.items()])
    assert set(back) == set(given) and off < 0.3 * np.mean([np.sum(v ** 2) for v in given.values()])


def test_query_on_the_given_vectors(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, digest = brute(rows, 256, 4)
    got = op11_hilbert_vector_codes(spark, folder).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == sorted(((w[0], *w[2:]) for w in want), key=str)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    codes, books = vector_codes.compress(none)
    assert codes.count() == 0 and codes.columns == ["id", "label", "code", "error", "label_error"] and len(books.sha256()) == 64
    one = spark.createDataFrame([(1, [0.5, 0.25], None, "x", "y"), (2, None, 1, "x", "y")], SCHEMA)
    codes, _ = vector_codes.compress(one)
    assert [tuple(r) for r in codes.collect()] == [(1, None, "00000000", 0, 0)]
    hollow = spark.createDataFrame([(1, [], 3, "x", "y")], SCHEMA)
    assert [tuple(r) for r in vector_codes.compress(hollow)[0].collect()] == [(1, 3, "00000000", 0, 0)]
    assert none.select(F.lit(1)).count() == 0
