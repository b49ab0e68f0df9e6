import math
import random
from collections import Counter

import numpy as np
import pytest

from voltide.llm import minhash

SCHEMA = "doc_id long, text string, class_id string, a int, v long"


def sets(texts, words, floor):
    out = []
    for t in texts:
        w = t.split()
        out.append(Counter(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else Counter([tuple(w)] if w else []))
    df = Counter(s for c in out for s in c)
    return [{s: k * (1 - math.log(max(df[s] / len(texts), floor))) for s, k in c.items()} for c in out]


def jaccard(x, y):
    both = sum(min(v, y.get(s, 0)) for s, v in x.items())
    return both / (sum(x.values()) + sum(y.values()) - both) if x and y else 0.0


def brute(rows, similarity, words, floor):
    texts = sorted({t or "" for _, t in rows})
    w = sets(texts, words, floor)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(w[i], w[j]) >= similarity:
                parent[find(i)] = find(j)
    of = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for i, t in rows:
        if i is not None:
            c = of[t or ""]
            least[c] = min(least.get(c, i), i)
    return {(i, t): least.get(of[t or ""]) for i, t in rows}


def corpus():
    g = random.Random(7)
    word = lambda: "".join(g.choice("abcde") for _ in range(3))
    line = [word() for _ in range(12)]
    rows = []
    for i in range(40):
        text = [word() for _ in range(g.randint(60, 160))] + line  # a line that all share
        rows.append((10 * i, " ".join(text)))
        for k in range(g.choice([0, 0, 1, 3])):  # near copies
            copy = list(text)
            for _ in range(max(1, len(copy) // 100)):
                copy[g.randrange(len(copy))] = "zz"
            rows.append((10 * i + k + 1, " ".join(copy)))
    base = [word() for _ in range(120)]
    for k in range(30):  # a star: every copy near the original, copies further from each other
        copy = list(base)
        for p in g.sample(range(120), 2):
            copy[p] = f"y{k}"
        rows.append((1000 + k, " ".join(copy)))
    rows += [(2000, " ".join(base)), (2001, " ".join(base)), (2001, " ".join(base)), (None, " ".join(base)), (3000, None), (3001, ""), (3002, "  "),
             (3003, "a b"), (3004, "a  b"), (3005, "b a"), (3006, None)]
    g.shuffle(rows)
    return rows


@pytest.mark.parametrize("group_shingles", [4_000_000, 1000])
def test_classes_against_brute_force(spark, group_shingles):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    got = minhash.near_duplicates(df, bands=24, rows=2, group_shingles=group_shingles).collect()
    want = brute(rows, 0.8, 5, 0.1)
    assert len(got) == len(rows)
    for r in got:
        assert r.class_id == want[r.doc_id, r.text], (r.doc_id, r.class_id)
        assert r.is_first == (r.doc_id == r.class_id) and r.a == 1 and r.v == 2


def test_large_buckets_lose_no_link(spark):
    """One bucket in many pieces: several classes, none with one of the bucket's first texts."""
    g = random.Random(11)
    word = lambda: "".join(g.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(minhash.HEADS + 50):
        body = [word() for _ in range(150)]
        for k in range(1 if i < minhash.HEADS + 10 else 2):
            copy = list(body)
            for p in g.sample(range(150), 2 * k):
                copy[p] = "zz"
            rows.append((10 * i + k, " ".join(["aa"] * 3000 + copy)))
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    want = brute(rows, 0.8, 5, 0.1)
    assert len(set(want.values())) == minhash.HEADS + 50
    got = minhash.near_duplicates(df, bands=3, rows=1, group_shingles=60_000).collect()
    assert {(r.doc_id, r.text): r.class_id for r in got} == want


def test_samples_agree_as_often_as_weights_overlap():
    g = np.random.default_rng(2)
    x = {int(h): w for h, w in zip(g.integers(0, 2**62, 200), g.uniform(0.5, 5, 200))}
    y = {h: w * g.choice([1, 1, 2]) for h, w in list(x.items())[:150]} | {int(h): 1.0 for h in g.integers(0, 2**62, 40)}
    flat = [(0, h, w) for h, w in sorted(x.items())] + [(1, h, w) for h, w in sorted(y.items())]
    drawn = minhash.samples(np.array([f[1] for f in flat], np.uint64), np.array([f[2] for f in flat]), np.array([0, len(x), len(flat)]), 3000)
    assert abs((drawn[:, 0] == drawn[:, 1]).mean() - jaccard(x, y)) < 0.03


def test_common_shingles_are_exact(spark):
    rows = corpus()
    texts = sorted({t or "" for _, t in rows})
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    common, weight, other = minhash.common_shingles(df, 5, 0.1, len(texts))
    df_ = Counter(s for c in sets(texts, 5, 0.1) for s in c)
    want = sorted(1 - math.log(n / len(texts)) for n in df_.values() if n > 0.1 * len(texts))
    assert np.allclose(sorted(weight), want) and abs(other - 1 + math.log(0.1)) < 1e-12 and len(common) == len(want)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_shingle_weighs_by_its_own_share(spark):
    """Texts that share boilerplate of a tenth of all texts, and texts that share as many rarer words."""
    g = random.Random(5)
    part = lambda n: ["".join(g.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    rows = []
    for k in range(20):
        boilerplate, rare = part(100), part(100)
        rows += [(100 * k + i, " ".join(boilerplate + part(60))) for i in range(8)]
        rows += [(100 * k + 10 + i, " ".join(rare + part(60))) for i in range(2)]
    rows += [(10_000 + i, t) for i, t in enumerate([None, "", "one two", "one two", rows[0][1]])]
    # eight of 203 texts and two of 203 are both below a tenth: one weight with the floor, two without it
    want = brute(rows, 0.41, 5, 0.0)
    assert want != brute(rows, 0.41, 5, 0.1)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(5)
    for group_shingles in (4_000_000, 500):
        got = minhash.near_duplicates(df, 0.41, bands=40, rows=1, floor=0.0, bucket_bytes=20_000, group_shingles=group_shingles).collect()
        assert {(r.doc_id, r.text): r.class_id for r in got} == want


def test_counts_of_buckets_are_those_of_all_texts(spark):
    rows = corpus()
    texts = sorted({t or "" for _, t in rows})
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(6)
    dealt = minhash.dealt_texts(df, 9, "doc_id", "text")
    assert sorted(r.text for r in dealt.collect()) == texts
    share = Counter(s for c in sets(texts, 5, 0.1) for s in c)
    found = [r.counts for r in minhash.shingle_counts(dealt, 5, 4).collect()]
    # a shingle of n texts is counted once in each of its buckets
    assert set(np.concatenate([np.frombuffer(c, np.int32) for c in found]).tolist()) == set(share.values())
    one = minhash.shingle_counts(minhash.dealt_texts(df, 1, "doc_id", "text"), 5, 4).orderBy("part").collect()
    assert sorted(np.concatenate([np.frombuffer(r.counts, np.int32) for r in one]).tolist()) == sorted(share.values())
