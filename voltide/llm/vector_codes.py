"""Vector code compression: product codes learnt by integer k-means over Hilbert-sorted blocks.

Components become integers, and every vector is cut into equal parts. The parts
of one position are sorted along a Hilbert curve and stored as flat blocks:
their components as one buffer, the smallest box around them and their sums. A
round compares the codebook with boxes first. An entry whose least distance to
a box is above another entry's greatest distance cannot be nearest to anything
in it; what is left is the block's shortlist. A shortlist of one takes the
block's sums as they are; otherwise an exact integer kernel assigns the rows of
the block to the entries of the shortlist. Blocks are written once and read in
every round; a round brings back sums per entry, and the codebooks are all that
travels to the tasks.

The sort key ends with the row's own number, so equal parts, however many,
spread over tasks and blocks.

Defined results: rows whose vector is null or holds null or non-finite
components take no part; a null id is the largest; every row counts, repeated
ones too; starting entries of one id are in the order of their vectors; with
fewer rows than entries the codebooks are shorter; shorter vectors are filled
up with zeros to the longest one, and that to a multiple of the number of
parts; integers beyond 2**27 (for 64 components; the bound keeps squared
distances within 62 bits) count as that bound; an empty table gives no rows.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voltide.llm.common import materialize

KEYS = "part int, key bigint, row bigint, id bigint, label string, body binary"
BLOCKS = ("part int, n int, low array<bigint>, high array<bigint>, total array<bigint>, rows array<bigint>, ids array<bigint>, "
          "labels array<string>, body binary")
# products and sums of integers below this are exact in double precision
EXACT = 1 << 53


@dataclass
class Codebooks:
    """Entries of every part: an integer array (parts, entries, width)."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def restored(self, code: str) -> list[float]:
        """The vector that a code stands for: the middle of its integers' cells."""
        index = np.frombuffer(bytes.fromhex(code), np.uint8)
        return ((self.entries[np.arange(len(index)), index].ravel() + 0.5) / self.scale).tolist()


def finite(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of an array, shorter ones filled up with zeros."""
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), flat.dtype)
    out[np.arange(width) < size[:, None]] = flat
    return out


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), kept within the bound that makes squared distances fit."""
    bound = 1 << (30 - (max(x.shape[1] - 1, 0).bit_length() + 1) // 2)
    return np.clip(np.floor(x.astype(np.float64) * scale), -bound, bound).astype(np.int64)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place of every row of whole numbers below 2**bits on a Hilbert curve through all of them."""
    axes = [c.astype(np.int64) for c in x.T]
    for level in range(bits - 1, 0, -1):  # undo the turns of the cells, the largest first
        q, p = 1 << level, (1 << level) - 1
        for i in range(len(axes)):
            upper = (axes[i] & q) != 0
            swap = np.where(upper, 0, (axes[0] ^ axes[i]) & p)
            axes[0] = np.where(upper, axes[0] ^ p, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        turn = np.where(axes[-1] & (1 << level) != 0, turn ^ ((1 << level) - 1), turn)
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ turn) >> level) & 1)
    return key


def curve_keys(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hilbert places of integer rows; cells divide [low, high], what lies outside goes to the rim."""
    x, low, high = x[:, :63], low[:63], high[:63]
    if x.shape[1] == 0:
        return np.zeros(len(x), np.int64)
    bits = max(1, 63 // x.shape[1])
    bits = min(bits, 16)
    cell = ((x - low) << bits) // (high - low + 1)
    return hilbert(np.clip(cell, 0, (1 << bits) - 1), bits)


def box_distances(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance of every entry to every box, as (boxes, entries)."""
    under, over = low[:, None] - book[None], book[None] - high[:, None]
    gap = np.maximum(np.maximum(under, over), 0)
    reach = np.maximum(-under, -over)
    return np.einsum("bew,bew->be", gap, gap), np.einsum("bew,bew->be", reach, reach)


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries can be nearest to a point of each box."""
    step = max(1, (1 << 19) // max(1, book.size))
    out = np.zeros((len(low), len(book)), bool)
    for a in range(0, len(low), step):
        near, far = box_distances(low[a:a + step], high[a:a + step], book)
        out[a:a + step] = near <= far.min(axis=1, keepdims=True)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Index of the nearest entry for every row; the lower one of equals."""
    most = max(1, int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < EXACT:
        x, book = x.astype(np.float64), book.astype(np.float64)
    return np.argmin(np.einsum("ij,ij->i", book, book) - 2 * (x @ book.T), axis=1)


def listed(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def write_blocks(rows: DataFrame, first: np.ndarray, parts: int, scale: int, block_rows: int) -> DataFrame:
    """Hilbert-sorted flat blocks of every part, stored. ``rows`` has id, label and vector."""
    width = first.shape[1] // parts
    cells = [first[:, p * width:(p + 1) * width] for p in range(parts)]
    cells = [(c.min(axis=0), c.max(axis=0)) for c in cells]

    def keyed(batches):
        for batch in batches:
            x = integers(matrix(batch.column(3), parts * width), scale)
            for p in range(parts):
                own = np.ascontiguousarray(x[:, p * width:(p + 1) * width])
                body = pa.Array.from_buffers(pa.binary(), len(own), [
                    None, pa.py_buffer(np.arange(len(own) + 1, dtype=np.int32) * (4 * width)), pa.py_buffer(own.astype("<i4"))])
                # ids and labels travel with the first part only
                carried = [batch.column(k) if p == 0 else pa.nulls(len(own), t) for k, t in ((1, pa.int64()), (2, pa.string()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), p, np.int32)), pa.array(curve_keys(own, *cells[p])), batch.column(0), *carried, body],
                    ["part", "key", "row", "id", "label", "body"])

    def blocks(batches):
        for batch in batches:
            part = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
            spans = [(c, min(c + block_rows, b)) for a, b in zip(cuts, cuts[1:]) for c in range(a, b, block_rows)]
            if not spans:
                continue
            _, at, data = batch.column(5).buffers()
            at = np.frombuffer(at, np.int32)[batch.column(5).offset:]
            data = np.frombuffer(data or b"", np.uint8)[at[0]:at[len(part)]]
            x = data.view("<i4").reshape(len(part), width).astype(np.int64)
            edges = pa.array(np.array([a for a, _ in spans] + [len(part)], np.int32))
            low, high, total = (np.stack([f(x[a:b], axis=0) for a, b in spans]) for f in (np.min, np.max, np.sum))
            bodies = pa.Array.from_buffers(pa.binary(), len(spans), [
                None, pa.py_buffer(edges.to_numpy() * np.int32(4 * width)), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[[a for a, _ in spans]]), pa.array([b - a for a, b in spans], pa.int32()), listed(low), listed(high), listed(total),
                 *[pa.ListArray.from_arrays(edges, batch.column(k)) for k in (2, 3, 4)], bodies],
                ["part", "n", "low", "high", "total", "rows", "ids", "labels", "body"])

    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "vector")
    dealt = rows.mapInArrow(keyed, KEYS).repartitionByRange("part", "key", "row").sortWithinPartitions("part", "key", "row")
    # the row numbers count from here on as they are stored
    return materialize(dealt.mapInArrow(blocks, BLOCKS), "vector_blocks")


def stored_blocks(batch: pa.RecordBatch, width: int, books: np.ndarray):
    """(index, part, shortlist, components) of every stored block of a batch."""
    part, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    low, high = (matrix(batch.column(k), width) for k in (2, 3))
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        lists = shortlists(low[at], high[at], books[p])
        for i, mask in zip(at.tolist(), lists):
            body = np.frombuffer(batch.column(8)[i].as_py(), "<i4")
            yield i, int(p), np.flatnonzero(mask), body.reshape(n[i], width).astype(np.int64)


def entry_sums(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, place, value): sums of the parts nearest to each entry; the last place counts them."""
    parts, entries, width = books.shape

    def run(batches):
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            sums = matrix(batch.column(4), width)
            for i, p, mask, x in stored_blocks(batch, width, books):
                if len(mask) == 1:
                    total[p, mask[0], :width] += sums[i]
                    total[p, mask[0], width] += len(x)
                    continue
                index = mask[nearest(x, books[p][mask])]
                np.add.at(total[p], index, np.column_stack([x, np.ones(len(x), np.int64)]))
        p, e = np.nonzero(total[:, :, width])
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), listed(total[p, e])], ["part", "entry", "sums"])

    found = blocks.mapInArrow(run, "part int, entry int, sums array<bigint>")
    return found.select("part", "entry", F.posexplode("sums").alias("place", "s")).groupBy("part", "entry", "place").agg(F.sum("s").alias("value"))


def updated(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries become the floors of their parts' means; unused ones stay."""
    parts, entries, width = books.shape
    total = np.zeros((parts, entries, width + 1), np.int64)
    for r in entry_sums(blocks, books).collect():  # as many numbers as the codebooks have
        total[r.part, r.entry, r.place] = r.value
    count = total[:, :, width:]
    return np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books)


def assigned(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(row, part, id, label, entry, distance) of every part of every row."""
    width = books.shape[2]

    def run(batches):
        for batch in batches:
            for i, p, mask, x in stored_blocks(batch, width, books):
                index = mask[nearest(x, books[p][mask])] if len(mask) > 1 else np.repeat(mask, len(x))
                off = x - books[p][index]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(5)[i].values, pa.array(np.full(len(x), p, np.int32)), batch.column(6)[i].values, batch.column(7)[i].values,
                     pa.array(index.astype(np.int32)), pa.array(np.einsum("ij,ij->i", off, off))],
                    ["row", "part", "id", "label", "entry", "distance"])

    return blocks.mapInArrow(run, "row bigint, part int, id bigint, label string, entry int, distance bigint")


def compress(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, block_rows: int = 256,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> tuple[DataFrame, Codebooks]:
    """Codes (id, label, code, error, label_error) of all usable rows, and the codebooks.

    ``code`` has two hex digits for each part, ``error`` is the squared distance
    of the row's integers to its entries, ``label_error`` sums it over the rows
    of a label, null being one.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    kind = vectors.schema[label_column].dataType
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(label_column).cast("string").alias("label"),
                          F.col(vector_column).cast("array<double>").alias("vector")).where(finite(F.col("vector")))
    start = rows.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts)
    empty = pa.array([r.vector for r in start], pa.list_(pa.float64()))
    first = integers(matrix(empty, parts * width), scale)
    books = first.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    names = ["id", "label", "code", "error", "label_error"]
    if not start:
        none = vectors.sparkSession.createDataFrame([], "id bigint, label string, code string, error bigint, label_error bigint")
        return none.withColumn("label", F.col("label").cast(kind)).select(*names), Codebooks(books, scale)
    blocks = write_blocks(rows, first, parts, scale, block_rows)
    for _ in range(rounds):
        books = updated(blocks, books)
    digits = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("part") == p, F.col("entry"))))), 2, "0") for p in range(parts)]
    coded = assigned(blocks, books).groupBy("row").agg(
        F.max("id").alias("id"), F.max("label").alias("label"), F.concat(*digits).alias("code"), F.sum("distance").alias("error"))
    coded = materialize(coded.drop("row"), "vector_codes")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    coded = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left")
    return coded.withColumn("label", F.col("label").cast(kind)).select(*names), Codebooks(books, scale)


def restore(codes: DataFrame, books: Codebooks, code_column: str = "code") -> DataFrame:
    """Add ``restored``: the vector that each code stands for."""
    def run(batches):
        for batch in batches:
            vectors = [None if c is None else books.restored(c) for c in batch.column(batch.schema.get_field_index(code_column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], [*batch.schema.names, "restored"])

    codes = codes.drop("restored")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema)
    return codes.mapInArrow(run, f"{fields}, restored array<double>")
