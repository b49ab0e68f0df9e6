"""Shared frame of the two substring dedups: windows of units that start more than once.

A unit is a byte or a word; a window is ``size`` consecutive units of one text.
Every window is assigned to its minimiser, the smallest hash among its runs of
``gram`` units: equal windows have equal minimisers at equal places. One
vectorised pass over the texts finds them, so what travels is one short row for
each stretch of windows with one minimiser, not one row per position. Only
stretches whose minimiser occurs more than once can hold repeats; their text
goes, grouped by minimiser, to an index builder (a suffix array or a suffix
tree) that works on a bounded number of stretches at a time.

Equal texts are one text with a count, so copies of whole documents cost one
row each. Of equal stretches only the first and the last travel; every window
of one between them occurs earlier and later. A minimiser with more than
``most`` stretches is not gathered: after the same reduction its windows become
rows keyed by a 128-bit hash of the whole window and are counted with partial
sums, which gives the same flags for groups of any size.
"""

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from voltide.llm.common import BLOCK_BYTES, blocks, byte_codes, mix64, packed, prefix_hash, ranges, span_hash, text_buffers

EARLIER, LATER = 1, 2
# what an index builder takes at a time
INDEX_BYTES = 1 << 21


def long_enough(gram: int, size: int) -> int:
    """The length of minimisers: their place in a window, and how many windows share one, must fit into 8 bits each."""
    return max(gram, size - 255)


class ByteUnits:
    """Every byte is a unit."""

    def __init__(self, size: int = 200, gram: int = 32):
        self.size, self.gram = size, long_enough(gram, size)

    def of(self, data: np.ndarray, offsets: np.ndarray):
        """Offsets of the texts in units, and the first and last byte of units by number."""
        return offsets, None, None

    def codes(self, data, starts, ends, a, b):
        return byte_codes(data[a:b])

    def spans(self, starts, ends, first, last):
        return first, last

    def kept(self, data, starts, ends, first, last, gone) -> bytes:
        return data[first:last][~gone].tobytes()


class WordUnits:
    """Words are runs of characters other than space and the controls 9 to 13."""

    def __init__(self, size: int = 35, gram: int = 8):
        self.size, self.gram = size, long_enough(gram, size)

    def of(self, data, offsets):
        white = (data == 32) | ((data >= 9) & (data <= 13))
        begins = ~white
        begins[1:] &= white[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        begins[inner] = ~white[inner]
        stops = ~white
        stops[:-1] &= white[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        stops[last] = ~white[last]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        return np.searchsorted(starts, offsets), starts, ends

    def codes(self, data, starts, ends, a, b):
        out, at = np.empty(b - a, np.uint64), a
        while at < b:
            upto = max(at + 1, min(b, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, side="right"))))
            base = starts[at]
            out[at - a:upto - a] = span_hash(prefix_hash(byte_codes(data[base:ends[upto - 1]])), starts[at:upto] - base, ends[at:upto] - base)
            at = upto
        return out

    def spans(self, starts, ends, first, last):
        return starts[first], ends[last - 1]

    def kept(self, data, starts, ends, first, last, gone) -> bytes:
        raw = data.tobytes() if len(data) < 1 << 16 else memoryview(data)
        keep = np.flatnonzero(~gone) + first
        return b" ".join(bytes(raw[s:e]) for s, e in zip(starts[keep].tolist(), ends[keep].tolist()))


def winnow(codes, offsets: np.ndarray, size: int, gram: int, step: int = 1 << 20):
    """Stretches of window starts with one minimiser: (text, first start, minimiser's place after it, starts, hash, content).

    ``codes(a, b)`` gives the codes of units a to b. The minimiser of a window
    depends on the window alone, so cutting a long text into steps changes
    nothing but where stretches end.
    """
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    width, total = size - gram + 1, int(offsets[-1])
    bits = np.uint64(22)
    for p in range(0, total - size + 1, step):
        q = min(total, p + step + size - 1)
        prefix = prefix_hash(codes(p, q))
        n = q - p - gram + 1
        grams = span_hash(prefix, np.arange(n), np.arange(gram, gram + n))
        least = (grams >> bits << bits) | np.arange(n, dtype=np.uint64)
        reach = 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[:len(least) - (width - reach)], least[width - reach:])
        place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        start = np.arange(p, p + len(place))
        text = text_of[start]
        inside = offsets[text + 1] - start >= size
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new & inside)
        if len(first) == 0:
            continue
        ends = np.append(np.flatnonzero(new | ~inside), len(place))
        n_starts = ends[np.searchsorted(ends, first, side="right")] - first
        content = span_hash(prefix, first, first + n_starts - 1 + size)
        yield text[first], start[first] - offsets[text[first]], place[first] - first, n_starts, mix64(grams[place[first]]), content


def distinct_texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Texts with two 64-bit hashes as key and the smallest id: one aggregate, so that all uses are one shuffle."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_column).alias("id"), text.alias("text")).select("id", "text", *text_keys("text"))
    one = keyed.groupBy("a", "b").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text")).alias("x"))
    return one.select("a", "b", F.col("x.id").alias("first"), F.col("x.text").alias("text"))


def text_keys(text):
    return F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")


def stretches(texts: DataFrame, units) -> DataFrame:
    """(h, s, a, b, first, place): minimiser and content hash; ``place`` packs first start, minimiser's place and number of starts."""
    kind = texts.schema["first"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(3))
            for x, y in blocks(offsets):
                part = data[offsets[x]:offsets[y]]
                in_units, starts, ends = units.of(part, offsets[x:y + 1] - offsets[x])
                for text, lo, to, n, h, s in winnow(lambda p, q: units.codes(part, starts, ends, p, q), in_units, units.size, units.gram):
                    row = pa.array(text + x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), *[batch.column(k).take(row) for k in range(3)],
                         pa.array((lo << 16) | (to << 8) | (n - 1))], ["h", "s", "a", "b", "first", "place"])

    # without nulls no filter on them tells the uses of these rows apart: they are shuffled once
    schema = f"h bigint NOT NULL, s bigint NOT NULL, a bigint NOT NULL, b bigint NOT NULL, first {kind}, place bigint NOT NULL"
    return texts.select("a", "b", "first", "text").mapInArrow(run, schema)


def gather(texts: DataFrame, found: DataFrame, units, windows: bool) -> DataFrame:
    """The text of stretches: rows (h, a, b, first, lo, n, body); or their windows: (h, g, a, b, first, lo)."""
    kind = texts.schema["first"].dataType.simpleString()
    schema = f"h bigint, a bigint, b bigint, first {kind}, lo bigint, " + ("g bigint" if windows else "n int, body binary")
    per_text = found.groupBy("a", "b").agg(F.collect_list(F.struct("place", "h")).alias("found"))
    rows = texts.select("a", "b", "first", "text").join(per_text, ["a", "b"], "left").select("a", "b", "first", "text", "found")

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column(4).is_valid())
            if batch.num_rows == 0:
                continue
            data, offsets = text_buffers(batch.column(3))
            lists = batch.column(4)
            counts = np.diff(lists.offsets.to_numpy())
            places, hashes = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            at = np.concatenate([[0], np.cumsum(counts)])
            for x, y in blocks(offsets):
                part = data[offsets[x]:offsets[y]]
                in_units, starts, ends = units.of(part, offsets[x:y + 1] - offsets[x])
                place, h = places[at[x]:at[y]], hashes[at[x]:at[y]]
                row = np.repeat(np.arange(y - x), counts[x:y])
                lo, n = place >> 16, (place & 255) + 1
                first = in_units[row] + lo
                begin, end = units.spans(starts, ends, first, first + n - 1 + units.size)
                for s, e in blocks(np.concatenate([[0], np.cumsum(end - begin)]), BLOCK_BYTES // 2):
                    keys = [batch.column(k).take(pa.array(row[s:e] + x)) for k in range(3)]
                    if not windows:
                        size = end[s:e] - begin[s:e]
                        body = pa.Array.from_buffers(pa.binary(), e - s, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                                                                          pa.py_buffer(part[ranges(begin[s:e], size)])])
                        yield pa.RecordBatch.from_arrays([pa.array(h[s:e]), *keys, pa.array(lo[s:e]), pa.array(n[s:e].astype(np.int32)), body],
                                                         ["h", "a", "b", "first", "lo", "n", "body"])
                        continue
                    each = np.repeat(np.arange(e - s), n[s:e])
                    step = ranges(np.zeros(e - s, np.int64), n[s:e])
                    b0, b1 = units.spans(starts, ends, first[s:e][each] + step, first[s:e][each] + step + units.size)
                    low, high = int(b0.min()), int(b1.max())
                    codes = byte_codes(part[low:high])
                    if starts is not None:  # white space between words does not count
                        white = (part[low:high] == 32) | ((part[low:high] >= 9) & (part[low:high] <= 13))
                        squeeze = np.concatenate([[0], np.cumsum(~white | np.append(~white[1:], True))])
                        codes = np.where(white, byte_codes(np.uint8([32]))[0], codes)[np.diff(squeeze) > 0]
                        b0, b1 = squeeze[b0 - low] + low, squeeze[b1 - low] + low
                    one = span_hash(prefix_hash(codes), b0 - low, b1 - low)
                    two = span_hash(prefix_hash(mix64(codes)), b0 - low, b1 - low)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one.view(np.int64)), *[k.take(pa.array(each)) for k in keys], pa.array(lo[s:e][each] + step), pa.array(two.view(np.int64))],
                        ["h", "a", "b", "first", "lo", "g"])

    return rows.mapInArrow(run, schema)


def indexed(segments: DataFrame, units, index) -> DataFrame:
    """Flags (a, b, lo, n, kind) from index builders run over whole groups of one minimiser.

    ``index(data, at, lo, n)`` gets the bodies of stretches in text order and
    returns for each window start, stretch by stretch, whether the window
    occurs earlier and later.
    """
    dealt = segments.repartition("h").sortWithinPartitions("h", "first", "a", "b", "lo")

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(6).nbytes
            if size >= BLOCK_BYTES // 4:
                table = pa.Table.from_batches(held)
                h = table.column(0).to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
                yield from groups(table.slice(0, cut))
                held, size = table.slice(cut).to_batches(), table.slice(cut).column(6).nbytes
        if held:
            yield from groups(pa.Table.from_batches(held))

    def groups(table):
        """Whole groups, some at a time."""
        if table.num_rows == 0:
            return
        h = table.column(0).to_numpy()
        bytes_at = np.cumsum(np.asarray(pc.binary_length(table.column(6)).combine_chunks()).astype(np.int64))
        ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
        first = 0
        while first < len(h):
            done = bytes_at[first - 1] if first else 0
            k = int(np.searchsorted(bytes_at[ends - 1], done + BLOCK_BYTES // 4, side="right"))
            last = int(ends[min(max(k - 1, int(np.searchsorted(ends, first, side="right"))), len(ends) - 1)])
            out = flags(table.slice(first, last - first))
            if out is not None:
                yield out
            first = last

    def flags(table):
        data, at = text_buffers(table.column(6))
        lo, n = table.column(4).to_numpy(), table.column(5).to_numpy().astype(np.int64)
        earlier, later = (index if len(data) < INDEX_BYTES else by_window)(data, at, n)
        kind = earlier * EARLIER + later * LATER
        if not kind.any():
            return None
        rows, starts = np.repeat(np.arange(len(n)), n), ranges(lo, n)
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (rows[1:] != rows[:-1])
        head = np.flatnonzero(new)
        length = np.diff(np.append(head, len(kind)))
        hit = kind[head] > 0
        head, length = head[hit], length[hit]
        row = pa.array(rows[head])
        return pa.RecordBatch.from_arrays(
            [table.column(1).take(row).combine_chunks(), table.column(2).take(row).combine_chunks(), pa.array(starts[head]),
             pa.array(length.astype(np.int32)), pa.array(kind[head].astype(np.int32))], ["a", "b", "lo", "n", "kind"])

    def by_window(data, at, n):
        """One group too large for an index: the same from hashes of its windows."""
        one, two = [], []
        for x, y in blocks(at):
            part = data[at[x]:at[y]]
            in_units, starts, ends = units.of(part, at[x:y + 1] - at[x])
            codes = units.codes(part, starts, ends, 0, int(in_units[-1]))
            first = np.repeat(in_units[:-1], n[x:y]) + ranges(np.zeros(y - x, np.int64), n[x:y])
            one.append(span_hash(prefix_hash(codes), first, first + units.size))
            two.append(span_hash(prefix_hash(mix64(codes)), first, first + units.size))
        one, two = np.concatenate(one), np.concatenate(two)
        order = np.lexsort((np.arange(len(one)), two, one))
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        earlier, later = np.zeros(len(one), bool), np.zeros(len(one), bool)
        earlier[order], later[order] = np.append(False, same), np.append(same, False)
        return earlier, later

    return dealt.mapInArrow(run, "a bigint, b bigint, lo bigint, n int, kind int")


def counted(windows: DataFrame) -> DataFrame:
    """The same flags for windows of crowded minimisers, by counts of whole windows."""
    where = F.struct("first", "a", "b", "lo")
    groups = windows.groupBy("h", "g").agg(F.count("*").alias("_n"), F.min(where).alias("_first"), F.max(where).alias("_last")).where("_n > 1")
    both = windows.join(groups, ["h", "g"])
    kind = F.when(where > F.col("_first"), EARLIER).otherwise(0) + F.when(where < F.col("_last"), LATER).otherwise(0)
    return both.select("a", "b", "lo", F.lit(1).alias("n"), kind.alias("kind"))


def repeats(texts: DataFrame, units, index, most: int) -> DataFrame:
    """Flags (a, b, lo, n, kind): ``n`` window starts from ``lo`` that occur earlier, later or both."""
    rows = stretches(texts, units)
    counts = rows.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1")
    found = rows.join(counts, "h")
    order = F.struct("first", "a", "b", "place")

    # the join has brought the stretches of a minimiser together: no further shuffle
    equal = Window.partitionBy("h", "s").orderBy("first", "a", "b", "place")
    few = found.where(F.col("_n") <= most)
    few = few.withColumn("_end", (F.row_number().over(equal) == 1) | F.lead("place").over(equal).isNull())

    # crowded minimisers: the same by partial minima and maxima
    crowd = found.where(F.col("_n") > most).repartition("h", "s", "a", "b")
    ends = crowd.groupBy("h", "s").agg(F.min(order).alias("_min"), F.max(order).alias("_max"))
    crowd = crowd.join(ends, ["h", "s"]).withColumn("_end", (order == F.col("_min")) | (order == F.col("_max")))

    between = [x.where(~F.col("_end")).select(
        "a", "b", F.shiftright("place", 16).alias("lo"), (F.col("place").bitwiseAND(255) + 1).cast("int").alias("n"),
        F.lit(EARLIER | LATER).alias("kind")) for x in (few, crowd)]
    return reduce(DataFrame.unionByName, [
        *between, indexed(gather(texts, few.where("_end"), units, windows=False), units, index),
        counted(gather(texts, crowd.where("_end"), units, windows=True))])


def remove(
    docs: DataFrame, units, index, keep: str, most: int, id_column: str, text_column: str, with_text: bool
) -> DataFrame:
    """One row per document: its columns, then n_units, n_removed, n_spans, kept_sha256, spans and, if asked for, kept."""
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    texts = distinct_texts(docs, id_column, text_column)
    marks = repeats(texts, units, index, most)
    if keep == "first":
        marks = marks.where(F.col("kind").bitwiseAND(EARLIER) > 0)
    per_text = marks.groupBy("a", "b").agg(F.collect_list(F.struct("lo", "n")).alias("marks"))
    rows = texts.join(per_text, ["a", "b"], "left").select("a", "b", "text", "marks")
    size = units.size

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            lists = batch.column(3)
            counts = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
            lo, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten())
            at = np.concatenate([[0], np.cumsum(counts)])
            for x, y in blocks(offsets):
                part = data[offsets[x]:offsets[y]]
                in_units, starts, ends = units.of(part, offsets[x:y + 1] - offsets[x])
                row = np.repeat(np.arange(y - x), counts[x:y])
                first = in_units[row] + lo[at[x]:at[y]]
                last = first + n[at[x]:at[y]] - 1 + size
                delta = np.zeros(int(in_units[-1]) + 1, np.int32)
                np.add.at(delta, first, 1)
                np.add.at(delta, last, -1)
                gone = np.cumsum(delta)[:-1] > 0
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                # a run that reaches a text's end does not go on in the next text
                heads = in_units[:-1][in_units[:-1] < in_units[1:]]
                edge[heads] = gone[heads]
                gone_at, edge_at = (np.concatenate([[0], np.cumsum(z)])[in_units] for z in (gone, edge))
                stop = gone.copy()
                stop[:-1] &= ~gone[1:]
                tails = in_units[1:][in_units[:-1] < in_units[1:]] - 1
                stop[tails] = gone[tails]
                span_row = np.repeat(np.arange(y - x), np.diff(edge_at))
                spans = pa.StructArray.from_arrays([pa.array(np.flatnonzero(edge) - in_units[span_row]),
                                                    pa.array(np.flatnonzero(stop) + 1 - in_units[span_row])], ["start", "end"])
                kept, digest = [], []
                for i in range(y - x):
                    u, v = in_units[i], in_units[i + 1]
                    out = units.kept(part, starts, ends, u, v, gone[u:v])
                    digest.append(hashlib.sha256(out).hexdigest())
                    if with_text:
                        kept.append(out)
                columns = [batch.column(0).slice(x, y - x), batch.column(1).slice(x, y - x), pa.array(np.diff(in_units)), pa.array(np.diff(gone_at)),
                           pa.array(np.diff(edge_at)), pa.array(digest), pa.ListArray.from_arrays(pa.array(edge_at.astype(np.int32)), spans)]
                if with_text:
                    columns.append(pa.array(kept, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["a", "b", "n_units", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * with_text
    schema = ("a bigint, b bigint, n_units bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
              "spans array<struct<start: bigint, end: bigint>>" + ", kept binary" * with_text)
    done = rows.mapInArrow(run, schema)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    results = names[2:]
    rows = docs.select(packed(docs, *[c for c in results if c not in (id_column, text_column)]), F.col(id_column).alias("id"), *text_keys(text))
    copies = rows.groupBy("a", "b").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    out = rows.join(done.join(copies, ["a", "b"]), ["a", "b"], "left")
    # several documents of one text: all its windows occur elsewhere, in all documents but the first earlier
    whole = (F.col("copies") > 1) & (F.col("n_units") >= size)
    if keep == "first":
        whole = whole & ~F.col("id").eqNullSafe(F.col("least"))
    everything = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_units").alias("end")))
    swap = {"n_removed": F.col("n_units"), "n_spans": F.lit(1).cast("bigint"), "kept_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "spans": everything}
    swap |= {"kept": F.lit(b"")} if with_text else {}
    out = out.withColumns({c: F.when(whole, v).otherwise(F.col(c)) for c, v in swap.items()})
    return out.select("row.*", *results)
