"""The stages on documents as no one wants them."""

import pytest

import corpus_pipeline as pipeline

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, score string, row int, is_first string, class_text string, "
          "id string, spans int, good int, rank string, h long")
EXTRA = (True, "s", 1, "f", "c", "i", 2, 3, "r", 4)
WORDS = "the quick brown fox jumps over a lazy dog and runs through old woods near some quiet river "
TEXTS = [
    None, "", " \n\t ", "12345 ... !!!", "word", WORDS * 4, WORDS * 4, WORDS.upper() + "\r\n" + WORDS, "日本語の文章はここにあります。" * 20, "x\x00y " * 50,
    "😀 emoji words here " * 10, WORDS * 2000, "a" * 200_000, "<|endoftext|> literal " * 5, "tail passage that follows " + WORDS * 3,
]


def rows():
    out = [(i, t, [None, "en", "de"][i % 3], [None, "s1"][i % 2], None if t is None else len(t), *EXTRA) for i, t in enumerate(TEXTS)]
    out += [out[5], out[5], (None, "text without an id but with some words in it", None, None, None, *[None] * 10), (None, None, None, None, None, *[None] * 10)]
    more = [f"{WORDS}{i} number {i * i} and more of it {WORDS[i:]}" for i in range(30)]
    return out + [(100 + i, t, "en", "s2", len(t), *EXTRA) for i, t in enumerate(more)]


@pytest.fixture(scope="module", params=["both", "none"])
def folder(request, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    labels = [(100 + i, i % 2, 0) for i in range(20)] + [(100, 1, 0), (None, 1, 0), (5, None, None)] if request.param == "both" else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_odd_documents(spark, folder, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert out.columns == docs.columns and out.count() <= docs.count()
        seen[name], docs = out.collect(), out
    assert not any(r.text is None or not any(c.isalpha() for c in r.text) for r in seen["language_id"])
    ids = [r.doc_id for r in seen["near_dedup"]]
    assert len(ids) == len(set(ids)) and not {5, 6} <= set(ids)
    assert {r.doc_id for r in seen["best_fit_packing"]} == {r.doc_id for r in seen["substring_dedup"]}
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in seen["substring_dedup"])


def test_odd_documents_at_each_stage(spark, folder):
    """Every stage also takes the documents that earlier ones would have dropped."""
    docs = spark.createDataFrame(rows(), SCHEMA)
    for name, stage in pipeline.STAGES:
        found = stage(spark, docs, folder).collect()
        assert found and (name == "best_fit_packing" or len(found) <= docs.count())


def test_empty_documents(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)
