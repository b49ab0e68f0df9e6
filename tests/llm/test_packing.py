import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voltide.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_ids_are_those_of_the_tokenizer(tokenizer):
    random.seed(5)
    parts = list("  \n\t ab'sAé×÷中д\xa0\x85\x1c　1²_,.!<|>") + ["<|endoftext|>", "'s", " the", "'ll", "É", "—", "\r\n"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(5000)]
    import pyarrow as pa

    from voltide.llm.common import text_buffers

    tokens = packing.ChunkTokens(packing.merge_ranks(open(PATH, encoding="utf-8").read()), entries=100)
    for at in range(0, 5000, 1000):
        ids, counts = tokens.encode(*text_buffers(pa.array(texts[at:at + 1000])))
        want = [e.ids for e in tokenizer.encode_batch(texts[at:at + 1000], add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_ids_are_those_of_the_tokenizer_by_default():
    import pyarrow as pa

    from voltide.llm.common import text_buffers

    random.seed(6)
    tokenizer, spec = Tokenizer.from_file(PATH), open(PATH, encoding="utf-8").read()
    parts = list("  \n\t ab'sé中\xa0\x85　1<|>") + ["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", " the", "'ll", "\r\n"]
    texts = ["x <|endoftext|> y"] + ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(4999)]
    tokens = packing.ChunkTokens(packing.merge_ranks(spec), entries=100, added=packing.added_tokens(spec))
    for at in range(0, 5000, 1000):
        ids, counts = tokens.encode(*text_buffers(pa.array(texts[at:at + 1000])))
        want = [e.ids for e in tokenizer.encode_batch(texts[at:at + 1000], add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]
    # added tokens with white space inside, one the beginning of another
    tokens = packing.ChunkTokens(packing.merge_ranks(spec), added={"a b": 60000, "a b c": 60001})
    ids, counts = tokens.encode(*text_buffers(pa.array(["a b ca b", "a b", " c", None])))
    assert counts.tolist() == [2, 1, 1, 0] and ids[:3].tolist() == [60001, 60000, 60000]


def test_query_and_pipeline_keep_added_tokens(spark, tmp_path):
    import corpus_pipeline
    from voltide.llm.queries import QUERIES

    texts = {1: "x <|endoftext|> y", 2: "<|endoftext|>" * 3, 3: "plain", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for rows in (QUERIES["op9_bin_slack_packing"](spark, str(tmp_path)), corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path))):
        check(rows.collect(), texts, Tokenizer.from_file(PATH), 2048)


def check(rows, texts, tokenizer, capacity):
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // capacity)))
        at = 0
        for k, p in enumerate(pieces):
            assert p.start == at and (k == 0 or p.length == capacity)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    total = 0
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        total += at
    return len(bins), -(-total // capacity)


def test_pack_documents(spark, tokenizer):
    random.seed(1)
    texts = {i: " ".join(random.choice(["one", "two", "three", "Überfall", "<|endoftext|>"]) for _ in range(int(random.expovariate(0.02)))) for i in range(300)}
    texts |= {900: None, 901: "", 902: "   ", 903: "x" * 3000, 904: "word " * 5000}
    docs = spark.createDataFrame([(k, v, "a") for k, v in texts.items()], "doc_id long, text string, length string")
    rows = packing.pack_documents(docs, PATH, 64).collect()
    bins, least = check(rows, texts, tokenizer, 64)
    assert bins <= least + 2
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (None, None)], "doc_id long, text string")
    rows = packing.pack_documents(docs, PATH, 8, with_ids=True).collect()
    assert len(rows) == 4 and sorted(len(r.ids) for r in rows) == [1, 2, 3, 3]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4


def test_bin_slack_is_full_where_it_can_be():
    rows, bins = packing.bin_slack_plan({7: 10, 3: 10, 5: 4, 6: 1}, 10)
    assert bins == 13 and sum(n for *_, n in [(0, 1)]) == 1
    assert packing.fullest([0, 0, 1, 0, 0, 3], [5, 2], 12) == {5: 2, 2: 1}
