import hashlib
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voltide.llm import fingerprints
from voltide.llm.queries import op13_simhash_fingerprints

SCHEMA = "doc_id long, text string, fp string, id string"


def chained(hashes):
    seed = 42
    for h in hashes:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", h), seed=seed)
    return seed


def simhash(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if len(words) < 5:
        seed = 42
        for w in words:
            seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
        terms = [seed] if words else []
    else:
        w1 = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
        w2 = [chained(p) for p in zip(w1, w1[1:])]
        w4 = [chained(p) for p in zip(w2, w2[2:])]
        terms = [chained(p) for p in zip(w4, w1[4:])]
    ones = [sum(t >> b & 1 for t in terms) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(terms))


def brute(rows, radius=3):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    prints = [simhash(t) for _, t in rows]
    out = []
    for k, (i, text) in enumerate(rows):
        follow, third = rows[(k + 1) % len(rows)][1], len(text) // 3
        edited = text[:len(text) - third] + follow[:third]
        mine, changed, after = prints[k], simhash(edited), prints[(k + 1) % len(rows)]
        within = sum((mine ^ p).bit_count() <= radius for p in prints) - 1 if i is not None and i % 50 == 0 else None
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{mine:016x}", f"{changed:016x}",
                    1 - (mine ^ changed).bit_count() / 64, 1 - (mine ^ after).bit_count() / 64, within))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_rows():
    g = np.random.default_rng(4)
    vocabulary = ["über", "ein", "wort", "日本語", "😀", "a", "bb", "the", "x\x00y", "nbsp in"]
    texts = [" ".join(g.choice(vocabulary, size=int(g.integers(0, 60)))) for _ in range(240)]
    texts += ["", None, " \n\t ", "one", "one two three four", "one two three four five", "no-space-" * 500, "line\r\nline\r\n" * 300, "same text of more than five words"] * 2
    base = [f"w{i}" for i in range(3000)]
    texts += [" ".join(base)] + [" ".join(base[:k] + ["new"] + base[k + 1:]) for k in (100, 500, 900)] + [" ".join(base)] * 30
    ids = [None, None] + [int(x) for x in g.permutation(40 * len(texts))[:len(texts) - 4]] + [7, 7]
    ids[10:30] = range(0, 1000, 50)
    return list(zip(ids, texts)) + [(7, "one"), (0, "one")]


@pytest.mark.parametrize("range_bytes", [300, 5000, 1 << 30])
def test_against_brute_force(spark, range_bytes):
    rows = some_rows()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(4)
    assert found(fingerprints.simhash_documents(df, F.col("id") % 50 == 0, range_bytes=range_bytes)) == brute(rows)


@pytest.mark.parametrize("radius,blocks", [(0, 1), (3, 4), (3, 5), (6, 8)])
def test_block_tables_find_all_within_the_radius(spark, radius, blocks):
    g = np.random.default_rng(radius)
    centres = g.integers(-2 ** 63, 2 ** 63, size=12)
    values = [int(c) ^ sum(1 << int(b) for b in g.choice(63, size=int(g.integers(0, 8)), replace=False)) for c in centres for _ in range(25)]
    held, asked = Counter(values + values[:20]), set(values[::7])
    entries = spark.createDataFrame([(v,) for v in held.elements()] + [(None,)], "fp long")
    got = fingerprints.within_radius(spark.createDataFrame([(v,) for v in values[::7]] + [(None,)], "fp long"), entries, radius, blocks).collect()
    off = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = {(q, v, off(q, v), n) for q in asked for v, n in held.items() if off(q, v) <= radius}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_fingerprint_of_any_frame(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "keep", "y"), (2, None, None, "z"), (1, "a b c d e f", "keep", "y")], SCHEMA)
    got = fingerprints.fingerprint(df).collect()
    assert [r.fp & (1 << 64) - 1 for r in sorted(got)] == [simhash("a b c d e f")] * 2 + [0] and sorted(r.id for r in got) == ["y", "y", "z"]


def test_range_of(spark):
    bounds = [3, 7, 7, 20, 21]
    got = spark.createDataFrame([(v,) for v in [None, -5, 3, 6, 7, 19, 20, 21, 99]], "v long").select(fingerprints.range_of(F.col("v"), bounds)).collect()
    assert [r[0] for r in got] == [0, 0, 1, 1, 3, 3, 4, 5, 5]


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = op13_simhash_fingerprints(spark, folder)
    assert found(got) == brute(rows)
    assert got.where("near_edited > near_next").count() > 0.9 * len(rows)


def test_empty_and_single(spark):
    assert fingerprints.simhash_documents(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    one = [(50, "abc def ghi jkl mno pqr stu")]
    assert found(fingerprints.simhash_documents(spark.createDataFrame([(*r, None, None) for r in one], SCHEMA), F.col("id") % 50 == 0)) == brute(one)
