import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from voltide.llm import quality_rules as rules

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, _g int"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def texts():
    g = random.Random(2)
    out = [None, "", "  \n\t", "a", "a " * 400, "\x0b\x0cx y\x0b", "one\n\n one\none\n", "日本 語\n" * 5, "a b c d e f g h i a b c d e f g h", "x y z"]
    for _ in range(150):
        out.append("".join(g.choice("ab") + g.choice([" ", " ", "\n", "c", "#", "  "]) for _ in range(g.randint(0, 80))))
    return out


def test_counts_against_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, None, "s", "x", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in rules.judge(df).collect()}
    for i, t in rows:
        want = counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r._g == 1 and (not r.base_failed or r.kept is False)


def quantile(values, q, scale):
    k = np.sort(np.floor(np.abs(values) * scale + 0.5) * np.sign(values))
    return k[math.ceil(q * len(k)) - 1]


def brute_distances(z, floors, steps, share):
    d = z.shape[1]
    m = np.array([quantile(z[:, i], 0.5, 64) / 64 for i in range(d)])
    s = np.array([(quantile(z[:, i], 0.75, 64) - quantile(z[:, i], 0.25, 64)) / 64 / 1.349 for i in range(d)])
    c = np.diag(s ** 2 + np.array(floors) ** 2)
    for _ in range(steps):
        x = z - m
        k = np.round(np.log(np.einsum("ij,ij->i", x @ np.linalg.inv(c), x) + 1e-9) * 32)
        order = np.argsort(k, kind="stable")
        classes, n = np.unique(k, return_counts=True)
        upto = np.cumsum(n)
        use = np.isin(k, classes[upto - n < share * len(z)])
        m = z[use].mean(axis=0)
        c = np.cov(z[use].T, bias=True) + np.diag(np.array(floors) ** 2)
        assert len(order) == len(z)
    x = z - m
    return np.einsum("ij,ij->i", x @ np.linalg.inv(c), x)


def test_concentration_against_numpy(spark):
    g = np.random.default_rng(4)
    z = g.normal(size=(400, 4)) @ g.normal(size=(4, 4)) + 3
    z[:60] += 25  # far rows, less than the part that may be left out
    rows = [(i, "a" if i % 2 else None, *map(float, v)) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "id long, g string, a double, b double, c double, e double").cache()
    out = rules.outlier_distances(df, F.col("g"), [F.col(x) for x in "abce"], F.lit(True), (0.1,) * 4).orderBy("id").collect()
    widen = 0.75 / rules.chi2_cdf(rules.chi2_quantile(0.75, 4), 6)
    for part in (0, 1):
        want = brute_distances(z[part::2], (0.1,) * 4, 4, 0.75) / widen
        got = np.array([r.distance2 for r in out[part::2]])
        assert np.allclose(got, want, rtol=1e-6)
    got = np.array([r.distance2 for r in out])
    cut = rules.chi2_quantile(1 - 1e-9, 4)
    assert (got[:60] > cut).all() and (got[60:] < cut).mean() > 0.99


def test_given_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = rules.judge(docs).join(labels, "doc_id").select("base_failed", "kept", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.995 and np.mean(bad) < 0.05


def test_empty_table(spark):
    assert rules.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chi2():
    assert abs(rules.chi2_quantile(0.95, 4) - 9.487729) < 1e-5
