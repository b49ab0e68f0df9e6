"""Best-fit packing of token sequences by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. The packer sees only
how many pieces there are of each length, a table of at most ``capacity``
counts whatever the input. For each bin, a bitset subset-sum dynamic program
over the lengths still available finds the fullest feasible combination around
the longest one; the combination is then taken out as often as the counts
allow. Pieces are numbered within their length in parallel and look up their
place in the list of combinations.

Defined results: null or empty text is a document of the closing id alone;
null ids and repeated rows are packed like any other row; ties between pieces
of one length fall by (doc_id, piece, start); an empty table gives no rows.
"""

import json
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from voltide.llm.common import blocks, byte_codes, materialize, prefix_hash, ranges, span_hash, text_buffers

SALTS = 1024
# --- fixed value: how byte-level BPE splits text ----------------------------------------------
TOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut without changing their tokens.

    No token of the byte-level pattern reaches from a word into the white space
    after it, or from a run of letters that follows white space into an ASCII
    character that is no letter. Characters that may be white space beyond
    ASCII, or letters beyond Latin-1, are never cut off.
    """
    n = len(data)
    at = np.zeros(n + 1, bool)
    at[offsets[:-1]] = True
    if n > 3:
        white = (data == 32) | ((data >= 9) & (data <= 13))
        ascii_ = data < 128
        lower = data | 32
        letter = ascii_ & (lower >= 97) & (lower <= 122)
        latin = np.zeros(n, bool)
        latin[:-1] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter |= latin
        letter[1:] |= latin[:-1]
        # the character before may be white space in two or three bytes
        wide = np.zeros(n + 1, bool)
        wide[2:] = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        wide[3:] |= (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3) & (data[1:-1] >= 0x80) & (data[1:-1] <= 0x9A)
        at[1:n] |= white[1:] & ~white[:-1] & ~wide[1:n]
        # runs of letters right after white space or at the start of a text
        place = np.arange(n)
        begins = letter.copy()
        begins[1:] &= ~letter[:-1] | at[1:n]
        run = np.maximum.accumulate(np.where(begins, place, 0))
        before = np.ones(n, bool)
        before[1:] = white[:-1]
        before |= at[:n]
        ends = letter[:-1] & ~letter[1:] & ascii_[1:]
        at[1:n] |= ends & before[run[:-1]]
    return np.flatnonzero(at[:n])


def merge_ranks(spec: str) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE file as bytes and merge order; fails if ids are not that order."""
    model = json.loads(spec)
    vocab, merges = model["model"]["vocab"], model["model"]["merges"]
    if model["model"]["type"] != "BPE" or model["pre_tokenizer"]["type"] != "ByteLevel" or model.get("normalizer"):
        raise ValueError("a byte-level BPE file without normalizer is needed")
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    if [vocab["".join(p)] for p in pairs] != list(range(256, 256 + len(pairs))):
        raise ValueError("the ids of the file must be the order of its merges")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    special = {t["content"] for t in model["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}


def added_tokens(spec: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` file and their ids; fails if they take more than their own characters."""
    tokens = json.loads(spec)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError("added tokens must match wherever they stand, without the white space around them")
    return {t["content"]: t["id"] for t in tokens}


class ChunkTokens:
    """Token ids of texts, with a bounded memory of chunks seen before.

    ``ranks`` is the vocabulary of a ``tokenizers`` file. Chunks are merged by
    tiktoken, which gives the ids of ``tokenizers`` in a fifth of the time.
    Where a text holds one of the ``added`` tokens, that is one id, and the text
    before and behind it is split as if it stood alone.
    """

    def __init__(self, ranks: dict[bytes, int], entries: int = 400_000, added: dict[str, int] | None = None):
        import tiktoken

        self.added = {token: [i] for token, i in (added or {}).items()}
        # the longest of those that begin at one place
        longest = sorted((token.encode() for token in self.added), key=len, reverse=True)
        self.find = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        self.encode_chunk = tiktoken.Encoding(
            "chunks", pat_str=TOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={}
        )._core_bpe.encode_ordinary
        self.entries = entries
        self.clear()

    def clear(self):
        self.known, self.ids, self.ends = {}, np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64)

    def learn(self, hashes: list[int], chunks: list[str]) -> None:
        # a chunk that reads like an added token is one: all places of it are cut out
        ids = [self.added.get(c) or self.encode_chunk(c) for c in chunks]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        at = int(self.ends[-1])
        end = at + int(lengths.sum())
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(max(end, 2 * len(self.ids)) - at, np.uint32)])
        self.ids[at:end] = np.fromiter(chain.from_iterable(ids), np.uint32, end - at)
        self.known.update(zip(hashes, range(len(self.ends) - 1, len(self.ends) - 1 + len(chunks))))
        self.ends = np.concatenate([self.ends, at + np.cumsum(lengths)])

    def starts(self, raw: bytes, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks begin: cuts inside texts, and both ends of every added token."""
        if self.find is None or not self.find.search(raw):
            return chunk_starts(data, offsets)
        texts = zip(offsets[:-1].tolist(), offsets[1:].tolist())
        spans = np.array([m.span() for a, b in texts for m in self.find.finditer(raw, a, b)], np.int64).reshape(-1, 2)
        out = chunk_starts(data, np.sort(np.concatenate([offsets, spans.ravel()])))
        if len(spans) == 0:
            return out
        before = np.searchsorted(spans[:, 0], out) - 1  # the last token that begins before a cut
        return out[(before < 0) | (out >= spans[before, 1])]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        raw = data.tobytes()
        starts = self.starts(raw, data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = span_hash(prefix_hash(byte_codes(data)), starts, ends)
        unique, first, index = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.entries:
            self.clear()
        keys, known = unique.tolist(), self.known
        new = [k for k, h in enumerate(keys) if h not in known]
        if new:
            at = first[new]
            self.learn([keys[k] for k in new], [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
        place = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[index]
        lengths = self.ends[place + 1] - self.ends[place]
        out = self.ids[ranges(self.ends[place], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        at = np.searchsorted(starts, offsets)
        return out, total[at[1:]] - total[at[:-1]]


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, closing_id: int = 0, with_ids: bool = False,
    id_column: str = "doc_id", text_column: str = "text", encode_special_tokens: bool = True,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``.

    Only documents of more than ``capacity`` tokens are cut; their first piece
    takes what is left over, the others are full. ``encode_special_tokens`` is
    that of ``tokenizers``, where it is False by default: added tokens that a
    text holds are their own ids then, and plain characters otherwise.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    ranks, added = merge_ranks(spec), {} if encode_special_tokens else added_tokens(spec)
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches):
        tokens = ChunkTokens(ranks, added=added)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in blocks(offsets):
                part = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                yield pieces(batch.column(0).slice(a, b - a), *tokens.encode(*part))

    def pieces(ids_of_docs, ids, counts):
        totals = counts + 1
        ends = np.cumsum(totals)
        full = np.full(int(totals.sum()), closing_id, np.uint32)
        full[ranges(ends - totals, counts)] = ids
        n = -(-totals // capacity)
        row = np.repeat(np.arange(len(totals)), n)
        piece = ranges(np.zeros(len(n), np.int64), n)
        head = totals[row] - (n[row] - 1) * capacity
        start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
        length = np.where(piece == 0, head, capacity)
        at = (ends - totals)[row] + start
        raw = memoryview(full.astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
        out = [ids_of_docs.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
               pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(full.astype(np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, schema)


def fullest(counts: list[int], lengths: list[int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        most = min(counts[length], room // length)
        if not most:
            continue
        before, step = reach, 1
        while most > 0:
            take = min(step, most)
            reach |= (reach << (length * take)) & mask
            most -= take
            step *= 2
        if reach != before:
            steps.append((length, before))
        if reach >> room:
            break
    target, found = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        taken = 0
        while not (before >> target) & 1:
            target -= length
            taken += 1
        if taken:
            found[length] = taken
    return found


def bin_slack_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Rows (length, first rank, copies per bin, first bin, offset) and the number of bins."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = int(n)
    lengths = [k for k in range(capacity, 0, -1) if counts[k]]
    used, rows, bins = [0] * (capacity + 1), [], 0
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        combination = fullest(counts, lengths, capacity - seed)
        counts[seed] += 1
        combination[seed] = combination.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in combination.items())
        offset = 0
        for length in sorted(combination, reverse=True):
            n = combination[length]
            rows.append((length, used[length], n, bins, offset))
            offset += n * length
            used[length] += n * times
            counts[length] -= n * times
        bins += times
        lengths = [k for k in lengths if counts[k]]
    return rows, bins


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored ``pieces`` (see ``token_pieces``)."""
    # only the counts of the lengths reach the driver: at most ``capacity`` rows
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, _ = bin_slack_plan(histogram, capacity)
    rows.sort()
    plan = np.array(rows, np.int64).reshape(-1, 5)
    bits = 44
    keys = (plan[:, 0] << bits) | plan[:, 1]

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(SALTS)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_at", F.row_number().over(within) - 1).join(sizes, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_at") + F.col("_before")).drop("_salt", "_at", "_before")
    names = pieces.columns

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            row = plan[np.searchsorted(keys, (length << bits) | rank, side="right") - 1] if len(plan) else plan
            behind = rank - row[:, 1]
            bin_, copy = row[:, 3] + behind // row[:, 2], behind % row[:, 2]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(bin_), pa.array(row[:, 4] + copy * length)],
                [*names, "sequence_id", "offset"],
            )

    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, closing_id: int = 0, **columns) -> DataFrame:
    """Tokenize, cut and pack documents; the pieces are stored in the shared folder, so texts are tokenized once."""
    pieces = token_pieces(docs, tokenizer_path, capacity, closing_id, **columns)
    return pack(materialize(pieces, "pieces"), capacity)
