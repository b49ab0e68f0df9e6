import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from voltide.llm import language
from voltide.llm.queries import op3_marginal_language_id

SCHEMA = "doc_id long, text string, lang string, score string, _text string"


@pytest.fixture(scope="module")
def table():
    return language.piece_table(public_tokenizers.path("piece_bpe_32k.model"))


def pieces_of(table):
    return {int(k).to_bytes(n, "little"): int(v) for n, (ks, vs) in enumerate(zip(*table[:2]), 1) for k, v in zip(ks, vs)}


def marginal(word, pieces, p):
    """By recursion over all segmentations."""
    word = b" " + word

    def rest(at):
        if at == len(word):
            return 1.0
        return sum(p[pieces[word[at:at + n]]] * rest(at + n) for n in range(1, min(8, len(word) - at) + 1) if word[at:at + n] in pieces)

    return rest(0)


def uses(word, pieces, p):
    out, total = {}, 0.0
    word = b" " + word

    def walk(at, path, chance):
        nonlocal total
        if at == len(word):
            total += chance
            for x in path:
                out[x] = out.get(x, 0.0) + chance
            return
        for n in range(1, min(8, len(word) - at) + 1):
            x = pieces.get(word[at:at + n])
            if x is not None:
                walk(at + n, [*path, x], chance * p[x])

    walk(0, [], 1.0)
    return {k: v / total for k, v in out.items()}


def test_sums_over_all_segmentations(table):
    pieces = pieces_of(table)
    words = [b"the", b"a", "ñándu".encode(), b"Testing1", "für".encode(), b"\x00z"]
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    lattice = language.Lattice(data, np.cumsum(lengths) - lengths, lengths, table)
    p = table[2]
    alpha = lattice.forward(language.scaled_by_length(p[None]))[..., 0]
    got = np.log(alpha[lattice.lengths, np.arange(len(words))]) - language.SCALE * lattice.lengths
    for k, w in zip(lattice.order, got):
        assert abs(w - np.log(marginal(words[k], pieces, p))) < 1e-9
    counts = np.arange(1.0, 13).reshape(6, 2)
    total = lattice.expected(language.scaled_by_length(p[None]), counts, len(p))
    want = np.zeros_like(total)
    for w, c in zip(words, counts):
        for k, v in uses(w, pieces, p).items():
            want[:, k] += v * c
    assert np.allclose(total, want)


def test_text_score_is_the_posterior(spark, table):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "the end", "en"), (4, "x", None)], "doc_id long, text string, lang string")
    model = language.train(train, table)
    langs, p, shares = model
    assert langs == ["en", "fr"] and np.allclose(np.exp(shares), [2 / 3, 1 / 3])
    rows = [(1, "the chat", None, "s", "t"), (2, None, "en", "s", "t"), (3, " 12 !", "en", "s", "t"), (4, "", "en", "s", "t"), (5, "a" * 70, "en", "s", "t"), (5, "a" * 70, "en", "s", "t")]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(rows, SCHEMA), model, table).collect()}
    pieces = pieces_of(table)
    logs = shares + sum(np.log([marginal(w, pieces, q) for q in p]) for w in (b"the", b"chat"))
    chance = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
    assert got[1].lang_pred == langs[int(chance.argmax())] and abs(got[1].score - chance.max()) < 1e-9 and got[1]._text == "t"
    assert all(got[i].lang_pred == "und" and got[i].score == 0.0 for i in (2, 3, 4)) and got[5].lang_pred in langs
    none = language.train(train.where("lang IS NULL"), table)
    assert {r.lang_pred for r in language.predict(train, none, table).collect()} == {"und"}
    assert language.predict(train.limit(0), model, table).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = op3_marginal_language_id(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    assert len(rows) == docs.count()
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.99


def long_pieces(table):
    """All pieces as bytes, those of the trie's steps spelled out."""
    keys, values, _, heads = table
    out, before = pieces_of((keys[:language.PACKED], values[:language.PACKED])), [int(h).to_bytes(8, "little") for h in heads]
    for ks, vs in zip(keys[language.PACKED:], values[language.PACKED:]):
        before = [before[int(k) >> 8] + bytes([int(k) & 255]) for k in ks]
        out.update({p: int(v) for p, v in zip(before, vs) if v < len(table[2])})
    return out


def test_every_piece_counts_and_words_are_whole(table):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = long_pieces(table)
    wanted = {model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    assert wanted | {bytes([b]) for b in range(256)} == set(pieces) and len(pieces) == len(table[2])
    longest = max(map(len, pieces))
    words = sorted((p.strip() for p in wanted if len(p) > 8 and b" " not in p.strip()), key=len)[-5:]
    words += [b"international", b"internationalisation" * 9, "ñandú".encode() * 60, b"z" * 700, bytes(range(128, 250)), b"the"]
    data, lengths = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    q = np.random.default_rng(7).dirichlet(np.full(len(table[2]), 0.5), 2) + 1e-12
    got = language.Lattice(data, np.cumsum(lengths) - lengths, lengths, table)
    logs = got.logs(language.scaled_by_length(q))
    p = table[2]
    counts = np.arange(1.0, 2 * len(words) + 1).reshape(-1, 2)
    want = np.zeros((2, len(p)))
    for place, k in enumerate(got.order):
        word = b" " + words[k]
        ends = [[(n, pieces[word[t - n:t]]) for n in range(1, min(longest, t) + 1) if word[t - n:t] in pieces] for t in range(len(word) + 1)]

        def forward(chances):
            log = [0.0]
            for t in range(1, len(word) + 1):
                log.append(np.logaddexp.reduce([log[t - n] + np.log(chances[x]) for n, x in ends[t]]))
            return log

        for g in range(2):
            assert abs(logs[place, g] - forward(q[g])[-1]) < 1e-6 * len(word)
        log, back = forward(p), np.full(len(word) + 1, -np.inf)
        back[-1] = 0.0
        for t in range(len(word), 0, -1):
            for n, x in ends[t]:
                back[t - n] = np.logaddexp(back[t - n], back[t] + np.log(p[x]))
                want[:, x] += np.exp(log[t - n] + np.log(p[x]) + back[t] - log[-1]) * counts[k]
    assert np.allclose(got.expected(language.scaled_by_length(p[None]), counts, len(p)), want)
