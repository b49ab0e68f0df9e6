"""Language identification with segmentation-marginalised unigrams.

The vocabulary is fixed and public: all pieces of a SentencePiece file, and
all single bytes, so every text has a segmentation. A
language is a probability for each piece. The probability of a word, with a
space before it, is the sum over all its segmentations, which a forward pass
gives; a text's is the product over its words.

Training is one expectation step over all training texts: a forward and a
backward pass under a common prior (pieces by rank, as in Zipf's law) give the
expected number of times each piece is used, summed per language in Spark. What
reaches the driver is one number per piece and language.

A task scores each distinct word of a block of text once, many words of like
length at a time. Pieces of at most eight bytes are looked up at every place;
longer ones are followed byte by byte from the few places where one can begin.
A word is scored whole, whatever its length: every sixteen bytes the sums are
brought back to about 1 and the factor is kept.

Defined results: null text, text without letters, and any text if nothing was
learned: ``und`` with score 0; ties go to the first language in order; the score
is the posterior probability among the learned languages; rows with a null
language are not learned from; repeated rows count as often as they are there;
an empty table gives no rows; a column of the input that has the name of a
result column is replaced by it.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from voltide.llm.common import blocks, byte_codes, packed, prefix_hash, ranges, span_hash, text_buffers
from voltide.llm.repeats import WordUnits

# pieces of up to so many bytes are packed into a number
PACKED = 8
# bytes of words, each as long as the longest, that are scored at a time
CELLS = 1 << 20
# bytes after which sums are brought back to about 1
STEP = 16
# probabilities are kept in range by this factor for each byte
SCALE = 8.0
PSEUDO = 2000.0


def piece_table(path: str) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """For each length the sorted keys of pieces and their numbers; the prior of all pieces; the heads of long pieces.

    A key is a piece's bytes up to ``PACKED`` bytes. Beyond that keys are the
    steps of a trie: the place of all bytes but the last among the keys before
    (at first among the heads, the first ``PACKED`` bytes of longer pieces), and
    the last byte. A step that only leads on has no piece's number.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]): 1e-7 for b in range(256)}
    rank = 0
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        rank += 1
        pieces[model.id_to_piece(i).replace("▁", " ").encode()] = 1.0 / (rank + 50.0)
    numbers = {p: k for k, p in enumerate(pieces)}
    prior = np.array(list(pieces.values()))
    keys, values = [], []
    for n in range(1, PACKED + 1):
        own = sorted((int.from_bytes(p, "little"), numbers[p]) for p in pieces if len(p) == n)
        keys.append(np.array([k for k, _ in own], np.uint64))
        values.append(np.array([v for _, v in own], np.int32))
    before = sorted({p[:PACKED] for p in pieces if len(p) > PACKED}, key=lambda p: int.from_bytes(p, "little"))
    heads = np.array([int.from_bytes(p, "little") for p in before], np.uint64)
    for n in range(PACKED + 1, max(map(len, pieces)) + 1):
        place = {p: k for k, p in enumerate(before)}
        before = sorted({p[:n] for p in pieces if len(p) >= n}, key=lambda p: (place[p[:-1]], p[-1]))
        keys.append(np.array([place[p[:-1]] << 8 | p[-1] for p in before], np.uint64))
        values.append(np.array([numbers.get(p, len(pieces)) for p in before], np.int32))
    return keys, values, prior / prior.sum(), heads


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and whether they are there."""
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


class Lattice:
    """All pieces in some words: for each length and place, the piece's number or that of no piece."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table):
        keys, values, prior, heads = table
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order] + 1
        self.longest_piece = len(keys)
        n, longest = len(lengths), int(self.lengths[0])
        letters = np.zeros((longest, n), np.uint64)
        letters[0] = 32
        row = np.repeat(np.arange(n), self.lengths - 1)
        letters[ranges(np.ones(n, np.int64), self.lengths - 1), row] = data[ranges(starts[self.order], self.lengths - 1)]
        # words of at least t bytes come first
        self.active = np.searchsorted(-self.lengths, -np.arange(longest + 1), side="right").tolist()
        self.pieces = []
        packed = np.zeros_like(letters)
        begun = []
        for k in range(1, PACKED + 1):
            found = np.full((max(longest - k + 1, 0), n), len(prior), np.int32)
            for at in range(longest - k + 1):
                m = self.active[at + k]
                packed[at, :m] |= letters[at + k - 1, :m] << np.uint64(8 * (k - 1))
                if len(keys[k - 1]):
                    place, hit = find(keys[k - 1], packed[at, :m])
                    found[at, :m] = np.where(hit, values[k - 1][place], len(prior))
                if k == PACKED and len(heads):
                    state, hit = find(heads, packed[at, :m])
                    word = np.flatnonzero(hit)
                    begun.append((np.full(len(word), at), word, state[word]))
            self.pieces.append(found)
        # last byte -> (length, words, pieces) of the pieces of more than PACKED bytes that end there
        self.long = [[] for _ in range(longest + 1)]
        if not begun:
            return
        at, word, state = (np.concatenate(x) for x in zip(*begun))
        for k in range(PACKED + 1, len(keys) + 1):
            on = np.flatnonzero(at + k <= self.lengths[word])
            place, hit = find(keys[k - 1], state[on].astype(np.uint64) << np.uint64(8) | letters[at[on] + k - 1, word[on]])
            on = on[hit]
            at, word, state = at[on], word[on], place[hit]
            piece = values[k - 1][state]
            whole = np.flatnonzero(piece < len(prior))
            cuts = np.flatnonzero(np.diff(at[whole])) + 1
            for part in np.split(whole, cuts) if len(whole) else ():
                self.long[int(at[part[0]]) + k].append((k, word[part], piece[part]))

    def sums(self, scaled: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all segmentations of the first t bytes (t, words, languages) and what to add to their logarithms
        (t // STEP, words, languages); ``scaled`` is by piece length."""
        longest, n = len(self.active) - 1, len(self.lengths)
        alpha = np.zeros((longest + 1, n, scaled[0].shape[1]))
        shift = np.zeros((longest // STEP + 1, *alpha.shape[1:]))
        alpha[0] = 1.0
        recent = [alpha[0]]  # the last sums, in the present scale
        for t in range(1, longest + 1):
            m = self.active[t]
            if t % STEP == 0:
                peak = np.maximum.reduce([r[:m] for r in recent])
                peak[peak == 0.0] = 1.0
                recent = [r[:m] / peak for r in recent]
                shift[t // STEP, :m] = shift[t // STEP - 1, :m] + np.log(peak)
            for k in range(1, min(PACKED, t) + 1):
                alpha[t, :m] += recent[-k][:m] * scaled[k - 1][self.pieces[k - 1][t - k, :m]]
            for k, word, piece in self.long[t]:
                alpha[t, word] += recent[-k][word] * (scaled[0][piece] * np.exp(SCALE * (k - 1)))
            recent = [*recent[1 - self.longest_piece:], alpha[t]]
        return alpha, shift

    def forward(self, scaled: list[np.ndarray]) -> np.ndarray:
        """Sums over all segmentations of the first t bytes (t, words, languages), without what is kept apart for long words."""
        return self.sums(scaled)[0]

    def logs(self, scaled: list[np.ndarray]) -> np.ndarray:
        """Logarithm of the probability of every word (words, languages), in ``order``."""
        alpha, shift = self.sums(scaled)
        word = np.arange(len(self.lengths))
        return np.log(alpha[self.lengths, word]) + shift[self.lengths // STEP, word] - SCALE * self.lengths[:, None]

    def expected(self, scaled: list[np.ndarray], counts: np.ndarray, n_pieces: int) -> np.ndarray:
        """Expected uses of each piece (languages, pieces) for words that occur ``counts`` (words, languages) times."""
        alpha, shift = (x[..., 0] for x in self.sums(scaled))
        longest, n = len(self.active) - 1, len(self.lengths)
        beta = np.zeros((longest + 1, n))
        beta[self.lengths, np.arange(n)] = 1.0 / alpha[self.lengths, np.arange(n)]
        numbers, uses, words = [], [], []

        def step(t, k, hit, chance):
            back = chance * beta[t, hit]
            if t // STEP != (t - k) // STEP:
                back *= np.exp(shift[(t - k) // STEP, hit] - shift[t // STEP, hit])
            beta[t - k, hit] += back
            uses.append(back * alpha[t - k, hit])
            words.append(hit)

        for t in range(longest, 0, -1):
            m = self.active[t]
            for k in range(1, min(PACKED, t) + 1):
                piece = self.pieces[k - 1][t - k, :m]
                hit = np.flatnonzero(piece < n_pieces)
                numbers.append(piece[hit])
                step(t, k, hit, scaled[k - 1][piece[hit], 0])
            for k, word, piece in self.long[t]:
                numbers.append(piece)
                step(t, k, word, scaled[0][piece, 0] * np.exp(SCALE * (k - 1)))
        numbers, uses, words = np.concatenate(numbers), np.concatenate(uses), np.concatenate(words)
        counts = counts[self.order]
        return np.stack([np.bincount(numbers, uses * counts[words, g], n_pieces) for g in range(counts.shape[1])])


def scaled_by_length(probabilities: np.ndarray) -> list[np.ndarray]:
    """Rows for pieces (and a last one for none), times the scale of each length up to ``PACKED``."""
    rows = np.concatenate([probabilities.T, np.zeros((1, len(probabilities)))])
    return [rows * np.exp(SCALE * k) for k in range(1, PACKED + 1)]


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """Words: text of each, first byte, length, and which distinct one it is with its first place."""
    units = WordUnits(1, 1)
    at, starts, ends = units.of(data, offsets)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if len(starts) == 0:
        return None
    hashes = span_hash(prefix_hash(byte_codes(data)), starts, ends)
    _, first, index = np.unique(hashes, return_index=True, return_inverse=True)
    return row, starts[first], (ends - starts)[first], index


def lattices(data: np.ndarray, begin: np.ndarray, length: np.ndarray, table):
    """(words, their lattice) of a bounded number of bytes at a time, the longest words first."""
    order = np.argsort(length, kind="stable")
    cells = length[order] + 1
    last = len(order)
    while last:
        some = order[max(0, last - max(1, CELLS // int(cells[last - 1]))):last]
        yield some, Lattice(data, begin[some], length[some], table)
        last -= len(some)


def train(docs: DataFrame, table, text_column: str = "text", lang_column: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, their piece probabilities (languages, pieces) and the log share of texts of each."""
    rows = docs.select(F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang")).where("lang IS NOT NULL")
    shares = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    langs = [r.lang for r in shares]
    n_pieces, prior = len(table[2]), table[2]
    if not langs:
        return [], np.zeros((0, n_pieces)), np.zeros(0)
    number = {g: k for k, g in enumerate(langs)}

    def count(batches):
        scaled, total = scaled_by_length(prior[None]), np.zeros((len(langs), n_pieces))
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            lang = np.array([number[g] for g in batch.column(1).to_pylist()], np.int64)
            for x, y in blocks(offsets):
                part = data[offsets[x]:offsets[y]]
                spans = word_spans(part, offsets[x:y + 1] - offsets[x])
                if spans is None:
                    continue
                row, begin, length, index = spans
                times = np.bincount(index * len(langs) + lang[x:y][row], minlength=len(begin) * len(langs)).reshape(-1, len(langs))
                for some, lattice in lattices(part, begin, length, table):
                    total += lattice.expected(scaled, times[some], n_pieces)
        lang, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[lang, piece])], ["g", "p", "n"])

    counts = np.zeros((len(langs), n_pieces))
    for r in rows.mapInArrow(count, "g int, p int, n double").groupBy("g", "p").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.g, r.p] = r.n
    counts += PSEUDO * prior
    share = np.array([r.n for r in shares], float)
    return langs, counts / counts.sum(axis=1, keepdims=True), np.log(share / share.sum())


def predict(docs: DataFrame, model, table, text_column: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    langs, probabilities, shares = model
    own = packed(docs, *[c for c in ("lang_pred", "score") if c != text_column])
    text = F.col(text_column).cast("string")
    rows = docs.select(own, F.when(text.rlike(r"\p{L}"), text).alias("text"))
    if not langs:
        return rows.select("row.*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches):
        scaled = scaled_by_length(probabilities)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            letters = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for x, y in blocks(offsets):
                part = data[offsets[x]:offsets[y]]
                total = np.tile(shares, (y - x, 1))
                spans = word_spans(part, offsets[x:y + 1] - offsets[x])
                if spans is not None:
                    row, begin, length, index = spans
                    logs = np.empty((len(begin), len(langs)))
                    for some, lattice in lattices(part, begin, length, table):
                        logs[some[lattice.order]] = lattice.logs(scaled)
                    for g in range(len(langs)):
                        total[:, g] += np.bincount(row, logs[index, g], y - x)
                best = total.argmax(axis=1)
                chance = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                known = letters[x:y]
                out = [batch.column(0).slice(x, y - x)]
                out += [pa.array([langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())]), pa.array(np.where(known, chance, 0.0))]
                yield pa.RecordBatch.from_arrays(out, ["row", "lang_pred", "score"])

    return rows.mapInArrow(score, schema).select("row.*", "lang_pred", "score")
