import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from voltide.llm import repeats, suffix_array, suffix_tree

SCHEMA = "doc_id long, text string, n_units string, h long, a int, lang string"
EMPTY = hashlib.sha256(b"").hexdigest()


def units_of(text, kind):
    raw = (text or "").encode()
    return [raw[i:i + 1] for i in range(len(raw))] if kind == "bytes" else re.findall(rb"[^\x20\x09-\x0D]+", raw)


def brute(rows, kind, size, keep):
    docs = sorted(((i, units_of(t, kind), t or "") for i, t in rows), key=lambda x: x[0])
    if keep == "first":  # text order is by smallest id, a later copy of a whole text loses all windows
        first = {}
        for i, _, t in docs:
            first.setdefault(t, i)
    places = defaultdict(set)
    for k, (i, u, t) in enumerate(docs):
        if keep == "first" and first[t] != i:
            continue
        for s in range(len(u) - size + 1):
            places[tuple(u[s:s + size])].add((k, s))
    out = []
    for k, (i, u, t) in enumerate(docs):
        gone = np.zeros(len(u), bool)
        for s in range(len(u) - size + 1):
            at = places[tuple(u[s:s + size])]
            hit = len(at) > 1 if keep == "none" else (first[t] != i or min(at) < (k, s))
            if hit:
                gone[s:s + size] = True
        kept = (b"" if kind == "bytes" else b" ").join(x for x, g in zip(u, gone) if not g)
        out.append((i, len(u), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(u) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    g = random.Random(seed)
    word = lambda: "".join(g.choice("abé") for _ in range(g.randint(1, 3)))
    sep = lambda: g.choice([" ", "  ", "\n", "\t "])
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(120):
        words = [word() for _ in range(g.randint(0, 60))]
        if g.random() < 0.5:
            a = g.randint(0, 30)
            at = g.randint(0, len(words))
            words[at:at] = passage[a:a + g.randint(3, 40)]
        rows.append((i, "".join(w + sep() for w in words)))
    rows += [(200 + i, rows[i][1]) for i in range(6)] + [(300, None), (301, ""), (302, "  \n"), (303, "ab" * 400), (304, "a b " * 300), (305, "xyz")]
    rows += [(400 + i, rows[7][1][:40] + f" q{i} " + rows[7][1][40:]) for i in range(8)]
    return rows


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("most,index_bytes", [(4096, 1 << 21), (3, 1 << 21), (4096, 100)])
@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_against_brute_force(spark, monkeypatch, kind, most, index_bytes, keep):
    monkeypatch.setattr(repeats, "INDEX_BYTES", index_bytes)
    rows = corpus(len(kind))
    df = spark.createDataFrame([(i, t, "x", 0, 0, "l") for i, t in rows], SCHEMA)
    if kind == "bytes":
        out = suffix_array.remove_repeats(df, 20, 9, keep, most)
    else:
        out = suffix_tree.remove_repeats(df, 9, 4, keep, most)
    got = out.collect()
    assert sorted((r.doc_id, r.n_units, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, kind, 20 if kind == "bytes" else 9, keep)
    for r in got:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and r.lang == "l" and r.a == 0
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "abcdefghij" * 3
    df = spark.createDataFrame([(1, text), (1, text), (None, "0123456789" + text)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_array.remove_repeats(df, 20, 9, "none").collect()}
    assert got[1].n_removed == 30 and got[None].n_removed == 30
    assert suffix_tree.remove_repeats(df.limit(0), 9, 4).count() == 0


def test_smaller_positions_on_both_sides():
    g = np.random.default_rng(1)
    for _ in range(50):
        order = g.permutation(40)
        linked = g.random(40) < 0.8
        linked[0] = False
        want = []
        for i in range(40):
            j = i
            while linked[j]:
                j -= 1
            k = i
            while k + 1 < 40 and linked[k + 1]:
                k += 1
            want.append(order[j:k + 1].min() < order[i])
        assert suffix_array.previous_factor(order, linked).tolist() == want


@pytest.mark.parametrize("size", [287, 288, 400, 600])
def test_long_windows(spark, size):
    g = random.Random(size)
    passage = "".join(g.choice("abcdé ") for _ in range(1500))
    rows = []
    for i in range(30):
        a, n = g.randint(0, 700), g.randint(size - 60, size + 90)
        rows.append((i, "".join(g.choice("xyz ") for _ in range(g.randint(0, 300))) + passage[a:a + n] + str(i)))
    rows += [(100, passage), (101, "q" * 2000), (102, "pq" * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in ("none", "first"):
        got = suffix_array.remove_repeats(df, size, 32, keep, with_text=False).collect()
        assert sorted((r.doc_id, r.n_units, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, "bytes", size, keep)
        words = [(i, re.sub("(?s)(.)", r"\1 ", t.replace(" ", "_"))) for i, t in rows]
        got = suffix_tree.remove_repeats(spark.createDataFrame(words, "doc_id long, text string"), size, 8, keep, with_text=False).collect()
        assert sorted((r.doc_id, r.n_units, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(words, "words", size, keep)
