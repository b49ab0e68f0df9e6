"""Chat formatting by columnar byte assembly.

Rows of one conversation, ordered by turn, become formatted text

    <|turn|>role\\ntext</s>\\n<|turn|>role\\ntext</s>\\n...

with the places of the assistant's texts as the loss mask. A task turns a batch
of rows into escaped role and text columns, computes segment lengths,
cumulative offsets and scatter indices in numpy and copies headers and contents
into one preallocated buffer that becomes the Arrow column.

Control strings inside roles and texts are escaped: a backslash goes before
every backslash, and after the first character of every control string (and
before a line break inside a role). Dropping one backslash before each
character restores the original.

A conversation is one row (``part`` 0). Only one longer than ``part_bytes``
spans several rows, in order, cut between turns, so no task holds a whole
conversation whatever its length.

Defined results: null role or text is empty; a null conv_id is a conversation
of its own; rows of one turn are ordered by role, then text, and repeated rows
stay; an empty table gives no rows; other columns are ignored.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from voltide.llm.common import ranges, text_buffers

TURN, END = "<|turn|>", "</s>"
CONTROLS = (TURN, END, "<s>", "[INST]", "[/INST]", "<|", "|>")
FORMATTED = "conv_id bigint, part int, formatted string, loss array<struct<start: bigint, end: bigint>>"
UNESCAPE = re.compile(r"\\(.)", re.S).sub
HEADER = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S).match


def escape(column: pa.Array, role: bool = False) -> pa.Array:
    out = pc.replace_substring(column, "\\", "\\\\")
    for control in CONTROLS:
        out = pc.replace_substring(out, control, control[0] + "\\" + control[1:])
    return pc.replace_substring(out, "\n", "\\\n") if role else out


def unescape(text: str) -> str:
    return UNESCAPE(r"\1", text)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all rows, row offsets, and the first and last byte of each text."""
    role, role_at = text_buffers(escape(roles, role=True))
    text, text_at = text_buffers(escape(texts))
    role_len, text_len = np.diff(role_at), np.diff(text_at)
    head, tail = (np.frombuffer(x.encode(), np.uint8) for x in (TURN, END + "\n"))
    length = len(head) + role_len + 1 + text_len + len(tail)
    at = np.concatenate([[0], np.cumsum(length)])
    role_to = at[:-1] + len(head)
    text_to = role_to + role_len + 1
    out = np.empty(int(at[-1]), np.uint8)
    out[(at[:-1, None] + np.arange(len(head))).ravel()] = np.tile(head, len(role_len))
    out[ranges(role_to, role_len)] = role
    out[text_to - 1] = 10
    out[ranges(text_to, text_len)] = text
    out[((text_to + text_len)[:, None] + np.arange(len(tail))).ravel()] = np.tile(tail, len(role_len))
    return out, at, text_to, text_to + text_len


def format_conversations(rows: DataFrame, learn_role: str = "assistant", part_bytes: int = 4 << 20) -> DataFrame:
    """One row (conv_id, part, formatted, loss) per conversation; ``loss`` holds ranges of code points of ``formatted``."""

    def emit(ids, known, roles, texts, part_of):
        """Formatted rows of consecutive turns; ``part_of`` is the part number of the first conversation."""
        data, at, first, last = assemble(roles, texts)
        begins = np.ones(len(ids), bool)
        begins[1:] = (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])
        rows_at = np.append(np.flatnonzero(begins), len(ids))
        bytes_at = at[rows_at]
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        row_part = np.repeat(np.arange(len(rows_at) - 1), np.diff(rows_at))
        learn = pc.equal(roles, learn_role).to_numpy(zero_copy_only=False).astype(bool)
        base = points[bytes_at[row_part[learn]]]
        spans = pa.StructArray.from_arrays(
            [pa.array(points[first[learn]] - base), pa.array(points[last[learn]] - base)], ["start", "end"])
        spans_at = np.concatenate([[0], np.cumsum(np.bincount(row_part[learn], minlength=len(rows_at) - 1))])
        part = np.zeros(len(rows_at) - 1, np.int32)
        part[0] = part_of
        head = rows_at[:-1]
        return pa.RecordBatch.from_arrays([
            pa.array(ids[head], mask=~known[head]), pa.array(part),
            pa.StringArray.from_buffers(len(part), pa.py_buffer(bytes_at.astype(np.int32)), pa.py_buffer(data)),
            pa.ListArray.from_arrays(pa.array(spans_at.astype(np.int32)), spans),
        ], ["conv_id", "part", "formatted", "loss"])

    def run(batches):
        held, part_of = None, 0  # rows of the last conversation so far, and how many parts of it are out
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            while table is not None and table.num_rows:
                ids = table.column(0).combine_chunks()
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                roles, texts = (pc.fill_null(table.column(k), "").combine_chunks() for k in (2, 3))
                size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
                last = np.flatnonzero((ids != ids[-1]) | (known != known[-1]))
                open_at = int(last[-1]) + 1 if len(last) else 0  # the last conversation may go on in the next batch
                upto = min(open_at or len(ids), max(1, int(np.searchsorted(size, part_bytes, side="right"))))
                if not open_at and size[-1] <= part_bytes:
                    break
                # cut at the end of a conversation if one ends in this stretch
                change = np.flatnonzero((ids[1:upto + 1] != ids[:upto][:len(ids) - 1]) | (known[1:upto + 1] != known[:upto][:len(ids) - 1])) + 1
                whole = len(change) > 0
                upto = int(change[-1]) if whole else upto
                yield emit(ids[:upto], known[:upto], roles[:upto], texts[:upto], part_of)
                single = not np.any((ids[:upto] != ids[0]) | (known[:upto] != known[0]))
                part_of = 0 if whole else (part_of + 1 if single else 1)
                table = table.slice(upto)
            held = table
        if held is not None and held.num_rows:
            ids = held.column(0).combine_chunks()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            roles, texts = (pc.fill_null(held.column(k), "").combine_chunks() for k in (2, 3))
            yield emit(ids.fill_null(0).to_numpy(), known, roles, texts, part_of)

    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"),
                       F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    out = []
    for turn in formatted.split(TURN)[1:]:
        body = turn[:-len(END) - 1]
        head = HEADER(body)
        out.append((unescape(head.group(1)), unescape(body[head.end():])))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests per conversation, read from formatted rows in the order ``format_conversations`` gives them."""

    def run(batches):
        now, state = None, None

        def close():
            return {"conv_id": now[0], "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2],
                    "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

        for batch in batches:
            done = []
            for conv, part, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv or part == 0:
                    if now is not None:
                        done.append(close())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"]:span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=out)
        if now is not None:
            yield pa.RecordBatch.from_pylist([close()], schema=out)

    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                     "loss_sha256 string, formatted_chars bigint")
