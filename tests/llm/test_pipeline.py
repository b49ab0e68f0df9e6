import hashlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from test_packing import PATH, check
from test_repeats import brute

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_order_and_columns(spark, steps):
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "language_id", "near_dedup", "substring_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert all(s.schema.names == docs.schema.names for s in steps[:4])


def test_filters_keep_clean_documents(spark, steps):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[0].select("doc_id").collect()}
    clean = [i in kept for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    foul = [i in kept for i, r in labels.items() if r.quality == 0 or r.toxic == 1]
    assert np.mean(clean) > 0.95 and np.mean(foul) < 0.15
    assert steps[1].count() > 0.99 * len(kept)


def test_one_document_of_each_class_stays(steps):
    before = {r.doc_id: r.text for r in steps[1].select("doc_id", "text").collect()}
    after = {r.doc_id for r in steps[2].select("doc_id").collect()}

    def grams(text):
        w = text.split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: grams(t) for i, t in before.items()}
    ids = sorted(before)
    near = {i: [j for j in ids if j < i and len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j])] for i in ids}
    for i in ids:
        if not near[i]:
            continue
        assert i not in after  # an earlier near copy is there or stands for it
    assert all(before[i] is not None for i in after) and len(after) < len(ids)


def test_passages_stay_once(steps):
    docs = [(r.doc_id, r.text) for r in steps[2].select("doc_id", "text").collect()]
    want = {w[0]: w for w in brute(docs, "bytes", 200, "first")}
    for r in steps[3].collect():
        text = dict(docs)[r.doc_id]
        if want[r.doc_id][2] == 0:
            assert r.text == text
        else:
            whole = len(text.encode()) - want[r.doc_id][2]
            assert 0 <= whole - len(r.text.encode()) <= 6 * want[r.doc_id][3]
            if len(r.text.encode()) == whole:
                assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][4]
        assert r.n_chars == len(r.text)


def test_everything_is_packed(steps):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in steps[3].collect()}
    rows = steps[4].collect()
    assert {r.doc_id for r in rows} == set(texts)
    bins, least = check(rows, texts, tokenizer, 2048)
    assert bins <= least + 2
