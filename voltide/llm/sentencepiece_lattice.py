"""SentencePiece encoding and decoding over a lattice.

Texts get a space in front and fall into units that no piece crosses: spaces
and what follows them, and line breaks. Texts stay where they are read: a task
takes some of them at a time, solves the distinct units that it has not seen
yet, and looks up all units. All places of some units at once walk down the
prefix tree of the pieces; the pieces found on the way are the edges of the
lattice. Sorted by their end, they are folded place by place, for all these
units together, to the cheapest path to each character (Viterbi), which is then
read back.

A piece costs ``ln(rank + 50)`` in thousandths, by its place in the file, plus
the logarithm of their sum over all pieces; a character that is no piece costs
20 per byte and becomes byte pieces. Costs are whole numbers, so results are the
same everywhere; among equal paths the longer last piece wins. (Files of
kind BPE give merge order instead of probabilities; their own merging is another
segmentation of the same text into the same pieces.)

A task holds about ``bucket_bytes`` of text, or one text, the lattice of
``LATTICE_CHARS`` characters, and the paths of ``KNOWN_UNITS`` units and those
of the texts at hand.

Defined results: null text encodes like empty text, to no ids; units longer than
448 characters, and runs of more than 64 spaces, are cut there; repeated rows are
encoded each; an empty table gives no rows; a column of the input that has the
name of a result column is replaced by it. Decoding ids of a text gives the text
back, byte by byte; null ids decode to null, ids outside the table to nothing.
"""

import collections
import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from voltide.llm.common import blocks, packed, ranges, text_buffers

UNIT = r" {0,64}[^ \n\t\r]{1,448}| {1,64}|[\n\t\r]"
NO_PIECE = 20_000
# characters whose lattice is held at once; units whose paths a task keeps
LATTICE_CHARS = 1 << 18
KNOWN_UNITS = 1 << 18


def pieces(path: str) -> tuple[list[tuple[str, int, int]], list[bytes], int]:
    """(piece, id, cost) of all usable pieces, the bytes of every id, and the id of byte 0."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows, content, first_byte, rank = [], [], -1, 0
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            first_byte = i if first_byte < 0 else first_byte
            content.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            content.append(b"")
        else:
            rank += 1
            text = piece.replace("\u2581", " ")
            content.append(text.encode())
            # units end before a space and at breaks: a piece that goes on there is never used
            if re.fullmatch(UNIT, text):
                rows.append((text, i, math.log(rank + 50.0)))
    base = math.log(sum(math.exp(-c) for *_, c in rows))
    return [(t, i, round(1000 * (c + base))) for t, i, c in rows], content, first_byte


class PrefixTree:
    """The pieces as steps from state to state, each by one character; state 0 is the root."""

    def __init__(self, rows: list):
        steps, piece, cost = {}, [0], [0]
        for text, i, c in rows:
            state = 0
            for char in text:
                state = steps.setdefault(state << 21 | ord(char), len(piece))
                if state == len(piece):
                    piece.append(0)
                    cost.append(0)
            piece[state], cost[state] = i + 1, c
        self.steps = np.array(sorted(steps), np.int64)
        self.to = np.array([steps[k] for k in self.steps.tolist()], np.int64)
        self.piece, self.cost = np.array(piece, np.int64), np.array(cost, np.int64)  # by state; piece is id + 1, or 0

    def edges(self, codes: np.ndarray, stop: np.ndarray, size: np.ndarray):
        """(start, length, id + 1, cost) of all pieces in units; ``stop`` is the end of each character's unit, ``size`` its bytes.

        A character without a piece of its own is an edge with 0 for id + 1.
        """
        at, state, length, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0, []
        alone = np.ones(len(codes), bool)
        while len(at):
            key = state << 21 | codes[at + length]
            place = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            hit = self.steps[place] == key
            at, state, length = at[hit], self.to[place[hit]], length + 1
            whole = self.piece[state] > 0
            starts, ends = at[whole], state[whole]
            if length == 1:
                alone[starts] = False
            found.append((starts, np.full(len(starts), length), self.piece[ends], self.cost[ends]))
            go = at + length < stop[at]
            at, state = at[go], state[go]
        odd = np.flatnonzero(alone)
        found.append((odd, np.ones(len(odd), np.int64), np.zeros(len(odd), np.int64), NO_PIECE * size[odd]))
        return [np.concatenate(x) for x in zip(*found)]


def best_paths(units: list, tree: PrefixTree, first_byte: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids along the best path of every unit, one after the other, and how many each has.

    Place p of unit u is a node; the best way to it is one number: cost, start 10 bits, id + 1 16 bits.
    """
    text = "".join(units)
    codes, raw = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64), np.frombuffer(text.encode(), np.uint8)
    size = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    raw_at = np.cumsum(size) - size
    count = np.fromiter(map(len, units), np.int64, len(units))
    ends = np.cumsum(count)
    unit = np.repeat(np.arange(len(units)), count)
    start, length, piece, cost = tree.edges(codes, ends[unit], size)
    begin = start - (ends - count)[unit[start]]  # place in the unit
    place, node = begin + length, start + length + unit[start]
    order = np.argsort(place * (len(codes) + len(units)) + node)
    begin, place, node = begin[order], place[order], node[order]
    source = node - place + begin
    way = (cost[order] << 26) + (begin << 16) + piece[order]
    groups = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    levels = np.searchsorted(place, np.arange(1, int(count.max()) + 2))
    own = np.searchsorted(groups, levels)
    best, tokens = np.zeros(len(codes) + len(units), np.int64), np.zeros(len(codes) + len(units), np.int64)
    first = ends - count  # of a unit's characters; its first node is that and its number
    number = np.arange(len(units))
    unit_at = np.repeat(number, count + 1)  # by node
    for k in range(1, len(levels)):
        low, high, here = levels[k - 1], levels[k], groups[own[k - 1]:own[k]]
        to = node[here]
        best[to] = found = np.minimum.reduceat((best[source[low:high]] >> 26 << 26) + way[low:high], here - low)
        origin = to - k + (found >> 16 & 1023)
        tokens[to] = tokens[origin] + np.where(found & 65535, 1, size[np.minimum(origin - unit_at[origin], len(size) - 1)])
    made = tokens[ends + number]
    ids_at = np.cumsum(made) - made
    ids = np.zeros(int(made.sum()), np.int32)
    unit, node = number, ends + number
    while len(unit):
        found = best[node]
        begin, piece = found >> 16 & 1023, found & 65535
        node = first[unit] + unit + begin
        put = ids_at[unit] + tokens[node]
        ids[put[piece > 0]] = piece[piece > 0] - 1
        odd = piece == 0
        if odd.any():
            char = node[odd] - unit[odd]
            ids[ranges(put[odd], size[char])] = first_byte + raw[ranges(raw_at[char], size[char])]
        go = begin > 0
        unit, node = unit[go], node[go]
    return ids, made


def solved(units: list, tree: PrefixTree, first_byte: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all units, where each unit's begin, and how many there are; units of like length are solved together."""
    count = np.fromiter(map(len, units), np.int64, len(units))
    order = np.argsort(count, kind="stable")
    parts = [best_paths([units[u] for u in order[x:y]], tree, first_byte)
             for x, y in blocks(np.concatenate([[0], np.cumsum(count[order])]), LATTICE_CHARS)]
    ids, made = (np.concatenate(x) for x in zip(*parts))
    start, n = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
    start[order], n[order] = np.cumsum(made) - made, made
    return ids, start, n


def encode(docs: DataFrame, model_path: str, text_column: str = "text", bucket_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with ids; the text comes last but one."""
    pieces_of_file, _, first_byte = pieces(model_path)
    tree = PrefixTree(pieces_of_file)
    rows = docs.select(packed(docs, "ids", text_column), F.col(text_column).cast("string").alias("text"))

    def look_up(batches):
        split = re.compile(UNIT).findall
        number = collections.defaultdict(itertools.count().__next__)  # of a unit, by first appearance
        ids, start, n = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for x, y in blocks(text_buffers(batch.column(1))[1], bucket_bytes):
                if len(number) > KNOWN_UNITS:
                    number = collections.defaultdict(itertools.count().__next__)
                    ids, start, n = ids[:0], start[:0], n[:0]
                part = batch.slice(x, y - x)
                places, counts = [], np.zeros(y - x, np.int64)
                for k, text in enumerate(part.column(1)):
                    text = text.as_py()
                    if text:
                        places.append(np.fromiter(map(number.__getitem__, split(" " + text)), np.int64))
                        counts[k] = len(places[-1])
                fresh = list(itertools.islice(number, len(n), None))
                if fresh:
                    more, at, times = solved(fresh, tree, first_byte)
                    start, n = np.concatenate([start, at + len(ids)]), np.concatenate([n, times])
                    ids = np.concatenate([ids, more])
                each = np.concatenate(places) if places else np.zeros(0, np.int64)
                length = n[each]
                total = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(counts)])]
                found = pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(ids[ranges(start[each], length)]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], ["row", "text", "ids"])

    schema = T.StructType([rows.schema["row"], rows.schema["text"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(look_up, schema).select("row.*", F.col("text").alias(text_column), "ids")


def decode(docs: DataFrame, model_path: str, ids_column: str = "ids") -> DataFrame:
    """``docs`` with decoded, the bytes that ``ids`` stand for without the space in front."""
    _, content, _ = pieces(model_path)
    sizes = np.array([len(c) for c in content] + [0], np.int64)
    ends = np.cumsum(sizes)
    table = np.frombuffer(b"".join(content), np.uint8)
    rows = docs.select(packed(docs, *[c for c in ("decoded",) if c != ids_column]), F.col(ids_column).cast("array<int>").alias("ids"))

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                lists = part.column(1)
                known = lists.is_valid().to_numpy(zero_copy_only=False)
                counts = np.where(known, np.diff(lists.offsets.to_numpy()), 0)
                ids = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
                ids = np.where((ids >= 0) & (ids < len(content)), ids, len(content))
                length = sizes[ids]
                data = table[ranges(ends[ids] - length, length)]
                at = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(counts)])]
                out = [data[s:e].tobytes() if k else None for s, e, k in zip(at[:-1], at[1:], known)]
                out = [x[1:] if x and x[:1] == b" " else x for x in out]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["row", "decoded"])

    schema = T.StructType([rows.schema["row"], T.StructField("decoded", T.BinaryType())])
    return rows.mapInArrow(run, schema).select("row.*", "decoded")
