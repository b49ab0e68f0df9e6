import random
import re

import public_tokenizers
import pytest
import sentencepiece

from voltide.llm import sentencepiece_lattice as lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, bucket string, unit int, ids string, decoded string"
TEXTS = [None, "", " ", "a", "The cat sat.", "  two  spaces ", "line\nbreak\n\n x", "ñandú über 中文字 \U0001f600 ▁x", "<s> </s> <unk> <0x41>", "x" * 600,
         " " * 200 + "y", "tab\tand\rreturn", "\x00 \x7f �", "2021-01-25 1,234.5"]


def viterbi(text, rows):
    """The cheapest segmentation of a whole text, without units; ties to the longer last piece."""
    cost = {t: (c, i) for t, i, c in rows}
    text = " " + text
    best = [(0, 0, None)]
    for end in range(1, len(text) + 1):
        ways = []
        for start in range(max(0, end - 40), end):
            part = text[start:end]
            if part in cost:
                ways.append((best[start][0] + cost[part][0], start, [cost[part][1]]))
            elif end - start == 1:
                ways.append((best[start][0] + lattice.NO_PIECE * len(part.encode()), start, [3 + b for b in part.encode()]))
        best.append(min(ways, key=lambda w: (w[0], w[1])))
    ids, at = [], len(text)
    while at:
        ids = best[at][2] + ids
        at = best[at][1]
    return ids


@pytest.fixture(scope="module")
def rows():
    return lattice.pieces(PATH)[0]


def test_table(rows):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert model.id_to_piece(3) == "<0x00>" and lattice.pieces(PATH)[2] == 3
    assert len(rows) > 31_000 and max(c for *_, c in rows) < lattice.NO_PIECE < 1 << 20
    # no piece that the units rule out is anything but spaces
    used = {i for _, i, _ in rows}
    out = [model.id_to_piece(i) for i in range(259, model.get_piece_size()) if i not in used]
    assert all(re.search("[^▁]▁|\n|\t|\r", p) for p in out)


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 300])
def test_ids_and_round_trip(spark, rows, bucket_bytes):
    g = random.Random(4)
    texts = TEXTS + ["".join(g.choice(["the", "ing", " ", " ", "é", "\n", "qz", "Über", "st"]) for _ in range(g.randint(0, 60))) for _ in range(120)]
    df = spark.createDataFrame([(i, t, "b", 1, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    df = df.unionByName(df.where("doc_id = 4"))
    out = lattice.decode(lattice.encode(df, PATH, bucket_bytes=bucket_bytes), PATH).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        text = texts[r.doc_id] or ""
        assert bytes(r.decoded) == text.encode(), r.doc_id
        assert r.bucket == "b" and r.unit == 1
        if len(text) < 400 and "   " not in text:
            assert r.ids == (viterbi(text, rows) if text else [])


def test_empty_and_odd_ids(spark):
    assert lattice.encode(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    df = spark.createDataFrame([(1, None), (2, []), (3, [-1, 99999, 0, 1, 2])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in lattice.decode(df, PATH).collect()}
    assert got[1] is None and got[2] == b"" and got[3] == b""


def test_texts_stay_in_their_tasks(spark):
    """Neither texts nor edges are sorted or shuffled: memory and disk do not grow with them."""
    df = spark.createDataFrame([(1, "some text", "b", 1, "x", "y")], SCHEMA)
    plan = lattice.encode(df, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Aggregate" not in plan


def test_paths_of_many_units(rows, monkeypatch):
    g = random.Random(5)
    units = [" " + "".join(g.choice(["a", "the", "ing", "é", "中", "\U0001f600", "qz", "1"]) for _ in range(g.randint(1, 40))) for _ in range(300)]
    units += ["\n", " ", "x" * 448, " " * 64, "\x00"]
    monkeypatch.setattr(lattice, "LATTICE_CHARS", 500)
    ids, start, n = lattice.solved(units, lattice.PrefixTree(rows), 3)
    for unit, s, k in zip(units, start, n):
        best = viterbi(unit[1:], rows) if unit[0] == " " else None
        if best is not None:
            assert ids[s:s + k].tolist() == best
