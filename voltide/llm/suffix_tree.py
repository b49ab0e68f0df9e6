"""Substring dedup of word sequences with prefix-partitioned suffix trees.

Suffixes are split into groups that fit a task by prefixes of variable length.
The prefix of a suffix reaches to the end of the minimiser of its window (see
``repeats``), 8 to 35 words; suffixes whose prefixes end in one minimiser travel
together as one stretch of text. Where more stretches share a prefix than a
task should hold, the prefix grows to the whole window, and a group is a single
node that needs a count only.

In a group the tree is built from the top: each level splits the suffixes of a
node by their next words. A node with one suffix is a leaf and is done; the
internal nodes that are left at ``size`` words are the repeats, and their leaves
the places where they occur.

Defined results: null and empty texts have no words; matches never cross
texts; equal texts under several ids are copies of each other, the first being
the smallest id (rows that repeat id and text are one document and agree); an
empty table gives no rows; a column of the input that has the name of a result
column is replaced by it.
"""

import numpy as np
from pyspark.sql import DataFrame

from voltide.llm.repeats import WordUnits, remove
from voltide.llm.suffix_array import ahead, dense

STEP = 5


def deep_nodes(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes below internal nodes of depth ``size`` and their nodes; ``words`` are ranks, ``starts`` suffixes."""
    step = min(STEP, size)
    block = words
    for k in range(1, step):
        block = dense((block << 32) | ahead(words, k))
    alive, node = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in [*range(0, size - step, step), size - step]:
        node = dense((node << 32) | block[starts[alive] + depth])
        stay = np.bincount(node, minlength=1)[node] > 1
        alive, node = alive[stay], node[stay]
    return alive, node


def tree_index(size: int):
    units = WordUnits(size)

    def index(data: np.ndarray, at: np.ndarray, n: np.ndarray):
        in_units, starts, ends = units.of(data, at)
        words = dense(units.codes(data, starts, ends, 0, len(starts)))
        first = np.cumsum(n) - n
        suffixes = np.repeat(in_units[:-1] - first, n) + np.arange(int(n.sum()))
        leaf, node = deep_nodes(words, suffixes, size)
        order = np.lexsort((leaf, node))
        leaf, node = leaf[order], node[order]
        again = np.concatenate([[False], node[1:] == node[:-1]])[:len(leaf)]
        earlier, later = np.zeros(len(suffixes), bool), np.zeros(len(suffixes), bool)
        earlier[leaf] = again
        later[leaf] = np.append(again[1:], False)[:len(leaf)]
        return earlier, later

    return index


def remove_repeats(
    docs: DataFrame, size: int = 35, gram: int = 8, keep: str = "first", most: int = 65_536,
    id_column: str = "doc_id", text_column: str = "text", with_text: bool = True,
) -> DataFrame:
    """Documents without the words of windows that occur before (``keep="first"``) or anywhere else (``keep="none"``).

    Adds n_units (words), n_removed, n_spans, kept_sha256, spans (removed word
    ranges) and, with ``with_text``, kept (the remaining words joined by a space).
    """
    return remove(docs, WordUnits(size, gram), tree_index(size), keep, most, id_column, text_column, with_text)
