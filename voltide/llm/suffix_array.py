"""Suffix-array dedup of byte strings by longest-previous-factor arrays.

Candidate stretches of text (see ``repeats``) are gathered by content. A task
builds the suffix array of a bounded number of them by prefix tripling down to
``size`` bytes. In suffix order, the nearest suffixes with a smaller text
position on either side, the previous and next smaller values, give the longest
earlier match: a window whose longest previous factor has ``size`` bytes
occurred before. The mirror image, with larger positions, tells first copies
that occur again.

Defined results: null and empty texts keep nothing and lose nothing; matches
never cross texts; equal texts under several ids are copies of each other, the
first being the smallest id (rows that repeat id and text are one document and
agree); an empty table gives no rows; a column of the input that has the name
of a result column is replaced by it.
"""

import numpy as np
from pyspark.sql import DataFrame

from voltide.llm.repeats import ByteUnits, remove


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys, equal for equal keys."""
    order = np.argsort(keys)
    ranked = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
    return rank


def ahead(values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros_like(values)
    out[:len(values) - n] = values[n:]
    return out


def prefix_ranks(data: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Ranks of all suffixes by their first ``depth`` bytes, depth at least a third of ``size``."""
    key = data.astype(np.uint64)
    for k in (1, 2, 4):
        key = (key << np.uint64(8 * k)) | ahead(key, k)
    rank, depth = dense(key), 8
    while 3 * depth < size:
        rank = dense((rank << 42) | (ahead(rank, depth) << 21) | ahead(rank, 2 * depth))
        depth *= 3
    return rank, depth


def smaller_before(position: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """For each entry the nearest one before it with a smaller position, through linked entries only; -1 for none."""
    at = np.arange(len(position)) - 1
    at[~linked] = -1
    todo = np.flatnonzero(at >= 0)
    while len(todo):
        todo = todo[position[at[todo]] > position[todo]]
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
    return at


def previous_factor(order: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Whether each suffix, in suffix order, has a linked one at a smaller position: its longest previous factor is long."""
    before = smaller_before(order, linked) >= 0
    back = np.zeros(len(linked), bool)
    back[1:] = linked[:0:-1]
    after = smaller_before(order[::-1], back)[::-1] >= 0
    return before | after


def suffix_index(size: int):
    if size < 8:
        raise ValueError("windows have at least 8 bytes")

    def index(data: np.ndarray, at: np.ndarray, n: np.ndarray):
        if len(data) >= 1 << 21:
            raise ValueError("too many bytes for one suffix array")
        rank, depth = prefix_ranks(data, size)
        first = np.cumsum(n) - n
        starts = np.repeat(at[:-1] - first, n) + np.arange(int(n.sum()))
        # ranks of the whole window, from three that cover it
        key = (rank[starts] << 42) | (rank[starts + min(depth, size - depth)] << 21) | rank[starts + size - depth]
        order = np.argsort(key)
        linked = np.zeros(len(order), bool)
        linked[1:] = key[order][1:] == key[order][:-1]
        earlier, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
        earlier[order] = previous_factor(order, linked)
        later[order] = previous_factor(-order, linked)
        return earlier, later

    return index


def remove_repeats(
    docs: DataFrame, size: int = 200, gram: int = 32, keep: str = "first", most: int = 65_536,
    id_column: str = "doc_id", text_column: str = "text", with_text: bool = True,
) -> DataFrame:
    """Documents without the bytes of windows that occur before (``keep="first"``) or anywhere else (``keep="none"``).

    Adds n_units (bytes), n_removed, n_spans, kept_sha256, spans (removed byte
    ranges) and, with ``with_text``, kept (the remaining bytes).
    """
    return remove(docs, ByteUnits(size, gram), suffix_index(size), keep, most, id_column, text_column, with_text)
