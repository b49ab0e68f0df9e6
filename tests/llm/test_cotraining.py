import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from voltide.llm import cotraining as c

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score string, id int"


def test_features_count_word_beginnings():
    import pyarrow as pa

    from voltide.llm.common import text_buffers

    data, offsets = text_buffers(pa.array(["Écoute Écoute écoutes", None, "b!B", ""]))
    row, feature, value = c.text_features(data, offsets)
    assert (np.diff(row) >= 0).all() and set(row.tolist()) == {0, 1, 2, 3}
    hashed = feature < 1 << c.TEXT_BITS
    # beginnings of four and six bytes, and whole words: three words share the first two, two the last
    assert sorted(np.round(np.expm1(value[hashed & (row == 0)])).astype(int).tolist()) == [1, 2, 3, 3]
    assert np.expm1(value[hashed & (row == 2)]).round().tolist() == [2.0]
    assert not (hashed & (row == 1)).any()


def test_regression_separates():
    g = np.random.default_rng(1)
    x = g.normal(size=(500, 3))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    row = np.repeat(np.arange(500), 3)
    w = c.fit(c.Sparse(500, row, np.tile(np.arange(3), 500), x.ravel(), 3), y, np.ones(500), 0)
    assert ((x @ w > 0) == y).mean() > 0.97 and abs(w[2]) < 0.2 * w[0]
    v = c.newton(x, y)
    assert ((x @ v[:3] + v[3] > 0) == y).mean() > 0.97


def test_views_teach_each_other():
    """Few labels in one view, a clean signal in the other: pseudo-labels carry it over."""
    g = np.random.default_rng(3)
    n = 600
    truth = g.integers(0, 2, n)
    target = np.where(np.arange(n) < 100, truth, -1)
    one = c.Sparse(n, np.arange(n), truth + 2 * g.integers(0, 2, n), np.ones(n), (1 << c.TEXT_BITS) + c.DENSE)
    two = c.Sparse(n, np.arange(n), truth * 300 + g.integers(0, 300, n), np.ones(n), (1 << c.META_BITS) + 1)
    alone = c.cotrain(one, two, target, 0, 0.9)
    taught = c.cotrain(one, two, target, 3, 0.9)
    right = lambda m: ((two.times(m.meta) > 0) == truth)[100:].mean()
    assert right(taught) > right(alone) + 0.1


@pytest.mark.parametrize("kind", ["both", "good only", "none"])
def test_odd_inputs(spark, kind):
    rows = [(i, "fine words here" if i % 2 else "bad bad bad", "en", "s", 10, "r", "x", 1) for i in range(40)]
    rows += [(100, None, None, None, None, None, None, None), (101, "", "en", "s", 0, "r", "x", 1), (None, "fine", "en", "s", 4, "r", "x", 1), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = [(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (100, None, 1), (3, 1, None)]
    labels = {"both": labels, "good only": [x for x in labels if x[1] == 1], "none": []}[kind]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = c.classify(docs, c.train(docs, labels)).collect()
    assert len(got) == len(rows) and {r.row for r in got} == {"r", None} and got[0].id == 1
    if kind == "both":
        assert all(r.kept == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 40)
    else:
        assert all(r.kept and r.score == 1.0 for r in got)
    assert c.classify(docs.limit(0), c.train(docs.limit(0), labels)).count() == 0


def test_held_out_documents(spark):
    """Trained on some labels of the given documents, judged on the others."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = c.train(docs, labels.where("doc_id % 5 != 0"))
    rows = c.classify(docs, model).join(labels.where("doc_id % 5 = 0"), "doc_id").select("kept", "quality", "toxic").collect()
    clean = np.mean([r.kept for r in rows if r.quality == 1 and r.toxic == 0])
    foul = np.mean([r.kept for r in rows if r.quality == 0 or r.toxic == 1])
    assert clean > 0.97 and foul < 0.12


def test_training_in_tasks_is_training_in_memory(spark):
    """The model of the distributed rounds against the same rounds over one array of all documents."""
    import pyarrow as pa

    from voltide.llm.common import text_buffers

    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    model = c.train(docs.repartition(7), labels, max_labelled=60)
    rows = docs.select("doc_id", *c.inputs(docs, "text", ("lang", "source"), ("n_chars",))).orderBy("doc_id").collect()
    text = c.Sparse(len(rows), *c.text_features(*text_buffers(pa.array([r.text for r in rows]))), (1 << c.TEXT_BITS) + c.DENSE)
    hashes = np.array([r.hashes for r in rows], np.int64)
    meta = c.Sparse(len(rows), *c.meta_features(hashes, np.array([r.sizes for r in rows])), (1 << c.META_BITS) + 1)
    good = {}
    for r in labels.collect():
        good[r.doc_id] = min(good.get(r.doc_id, 1), int(r.quality == 1 and not r.toxic))
    known = docs.where(docs.doc_id.isin(list(good))).selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h", "doc_id").limit(60).collect()
    sample = {r.doc_id: good[r.doc_id] for r in known}
    target = np.array([sample.get(r.doc_id, -1) for r in rows])
    want = c.cotrain(text, meta, target, 2, 0.97)
    assert np.allclose(model.meta, want.meta, atol=1e-3) and np.allclose(model.text, want.text, atol=1e-3)
    scores = [m.score(text.times(m.text), meta.times(m.meta))[0] for m in (model, want)]
    assert np.abs(scores[0] - scores[1]).max() < 1e-2
    alone = c.cotrain(text, meta, target, 0, 0.97)
    assert not np.allclose(alone.meta, want.meta, atol=1e-3)  # the rounds taught something


def peak_of(work) -> int:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_fit_and_of_a_batch():
    """Temporary arrays do not grow with the labelled sample, nor with the texts of a batch."""
    n = 3_000_000
    x = c.Sparse(3000, np.repeat(np.arange(3000, dtype=np.int32), 1000), np.arange(n, dtype=np.int32) % 5000, np.ones(n, np.float32), 5000)
    assert np.array_equal(x.times(np.ones(5000)), np.full(3000, 1000.0)) and np.array_equal(x.back(np.ones(3000)), np.full(5000, 600.0))
    assert peak_of(lambda: x.times(np.ones(5000))) < 16 << 20 and peak_of(lambda: x.back(np.ones(3000))) < 16 << 20
    text = "some words of a text that is as long as others, 1 2 3! " * 400
    batch = pa.record_batch({"text": [text] * 200, "hashes": [[1, 2]] * 200, "sizes": [[3.0]] * 200})
    assert peak_of(lambda: [None for _ in c.sparse_views(batch, 1, 2, 0)]) < 48 << 20
