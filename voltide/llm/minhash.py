"""Near-duplicate documents by consistent weighted sampling.

Equal texts are one entry. A text is the weighted set of its five-word
shingles (a shorter text is one shingle of all its words), weighted by term
frequency times inverse document frequency, ``1 + ln(1 / share)``, with the
share of texts that hold a shingle, counted for every shingle: texts are dealt
into buckets of about ``bucket_bytes``, a bucket sends its distinct hashes and
their own counts to ranges of hashes, as sorted arrays, and gets back the sums
in the same order. With ``floor`` above 0 a share counts from there upwards, and
only shingles above it are counted: a shingle in a ``floor`` of all texts
reaches half of it in blocks that hold half of its texts, so the blocks' own
counts leave at most ``2 / floor`` times the mean text's shingles as
candidates, which a second pass counts.

Improved consistent weighted sampling draws (shingle, level) pairs that two
texts share with the probability of their weighted Jaccard similarity. Bands of
samples are buckets. Texts connected by buckets form a group; a task verifies
one group, breadth first: a text is compared with all texts that share a bucket
with it and have not been reached, and those of at least ``similarity`` are
reached from it. This finds the connected components of all verified links
among candidates without listing pairs, and one text stands for each class.

A group of more than ``group_shingles`` shingles is verified bucket by bucket,
and a bucket above that size first in parts that share its first texts; links
found there are joined to classes by label propagation. Two texts of one class
need no comparison any more. What is left, the texts outside a bucket's largest
class against each other and against that class, is dealt into pieces, and
every pair of pieces is compared in a task of its own. So all links among
candidates count at any size.

Defined results: null text is empty; texts without words are copies of equal
texts only; the smallest id of a class (nulls last) names it; rows that repeat
id and text are one document; an empty table gives no rows; a column of the
input that has the name of a result column is replaced by it.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from voltide.llm.common import blocks, materialize, mix64, packed, prefix_hash, ranges, span_hash, text_buffers
from voltide.llm.repeats import WordUnits, distinct_texts, text_keys

HEADS = 64


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, sorted within each text, and the offsets of texts."""
    units = WordUnits(words, 1)
    in_units, starts, ends = units.of(data, offsets)
    n_words = np.diff(in_units)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    prefix = prefix_hash(units.codes(data, starts, ends, 0, len(starts)))
    count = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    first = ranges(in_units[:-1], count)
    row = np.repeat(np.arange(len(count)), count)
    out = span_hash(prefix, first, first + np.minimum(n_words, words)[row])
    order = np.lexsort((out, row))
    return out[order], np.concatenate([[0], np.cumsum(count)])


def weighted(hashes: np.ndarray, offsets: np.ndarray, idf: tuple[np.ndarray, np.ndarray, float]):
    """Distinct shingles of each text with their weights: (hashes, weights, offsets).

    ``idf`` has a value for every distinct shingle of each text, or is what ``common_shingles`` gives.
    """
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(hashes)))
    hashes, row = hashes[at], row[at]
    if isinstance(idf, np.ndarray):
        weight = idf
    else:
        common, values, other = idf
        weight = np.full(len(hashes), other)
        if len(common):
            place = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
            weight = np.where(common[place] == hashes, values[place], other)
    return hashes, tf * weight, np.searchsorted(row, np.arange(len(offsets)))


def samples(hashes: np.ndarray, weights: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """``n`` consistent weighted samples of each text that has shingles, as 64-bit hashes (n, texts)."""
    unit = np.float32(2.0 ** -24)
    log_w = np.log(weights).astype(np.float32)
    starts = offsets[:-1]
    index = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64(0xFFFFFF)
    out = np.empty((n, len(starts)), np.uint64)
    for k in range(n):
        x = mix64(hashes + np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        y = mix64(x + np.uint64(0xD1B54A32D192ED03))
        one = ((x >> np.uint64(40)) + np.uint64(1)).astype(np.float32) * unit
        two = (((x >> np.uint64(16)) & low) + np.uint64(1)).astype(np.float32) * unit
        r = -np.log(one) - np.log(two) + np.float32(1e-9)
        one = ((y >> np.uint64(40)) + np.uint64(1)).astype(np.float32) * unit
        two = (((y >> np.uint64(16)) & low) + np.uint64(1)).astype(np.float32) * unit
        log_c = np.log(-np.log(one) - np.log(two) + np.float32(1e-9))
        beta = (y & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0 ** -16)
        level = np.floor(log_w / r + beta)
        log_a = log_c - r * (level - beta) - r
        bits = log_a.view(np.int32)
        key = np.where(bits < 0, ~bits.view(np.uint32), bits.view(np.uint32) | np.uint32(1 << 31)).astype(np.uint64)
        at = (np.minimum.reduceat((key << np.uint64(32)) | index, starts) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out[k] = mix64(hashes[at] ^ mix64(level[at].astype(np.int64).view(np.uint64) + np.uint64(k)))
    return out


def text_blocks(batches, column: int):
    """(batch, first row, last row, data, offsets) of a bounded number of bytes at a time."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(column))
        for x, y in blocks(offsets):
            yield batch, x, y, data[offsets[x]:offsets[y]], offsets[x:y + 1] - offsets[x]


def common_shingles(texts: DataFrame, words: int, floor: float, n_texts: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes and weights of shingles in at least ``floor`` of the texts, and the weight of all others."""
    def local(batches):
        held, n, size = [], 0, 0

        def counts():
            hashes, count = np.unique(np.concatenate(held), return_counts=True)
            many = count >= max(1.0, floor / 2 * n)
            return pa.RecordBatch.from_arrays([pa.array(hashes[many].view(np.int64)), pa.array(count[many])], ["h", "n"])

        for _, x, y, data, offsets in text_blocks(batches, 0):
            hashes, at = shingles(data, offsets, words)
            held.append(weighted(hashes, at, (np.zeros(0, np.uint64), np.zeros(0), 1.0))[0])
            n, size = n + y - x, size + len(held[-1])
            if size >= 4_000_000:
                yield counts()
                held, n, size = [], 0, 0
        if size:
            yield counts()

    found = texts.select("text").mapInArrow(local, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    # at most 2 / floor times the mean number of shingles of a text
    some = np.sort(np.array([r.h for r in found.where(F.col("n") >= floor / 2 * n_texts).select("h").collect()], np.int64).view(np.uint64))
    other = 1.0 - math.log(floor)
    if len(some) == 0:
        return some, np.zeros(0), other

    def exact(batches):
        total = np.zeros(len(some), np.int64)
        for _, _, _, data, offsets in text_blocks(batches, 0):
            hashes, at = shingles(data, offsets, words)
            hashes = weighted(hashes, at, (np.zeros(0, np.uint64), np.zeros(0), 1.0))[0]
            place = np.minimum(np.searchsorted(some, hashes), len(some) - 1)
            total += np.bincount(place[some[place] == hashes], minlength=len(some))
        yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(total)], ["h", "n"])

    rows = texts.select("text").mapInArrow(exact, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).collect()
    share = {np.int64(r.h).view(np.uint64): r.n / n_texts for r in rows}
    share = np.array([share[h] for h in some])
    return some[share > floor], 1.0 - np.log(share[share > floor]), other


def dealt_texts(docs: DataFrame, buckets: int, id_column: str, text_column: str, max_partitions: int = 10_000) -> DataFrame:
    """``distinct_texts`` with a bucket; buckets lie whole in a partition. Copies in one batch go there once."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_column).alias("id"), text.alias("text")).select("id", "text", *text_keys("text"))

    def once(batches):
        for batch in batches:
            order = pc.sort_indices(batch.select(["a", "b", "id"]), sort_keys=[(c, "ascending") for c in ("a", "b", "id")])
            a, b = (batch.column(c).to_numpy()[order.to_numpy()] for c in ("a", "b"))
            new = np.ones(len(order), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            yield batch.take(order.filter(pa.array(new)))

    dealt = keyed.mapInArrow(once, keyed.schema).withColumn("bucket", F.pmod("a", F.lit(buckets)))
    one = dealt.repartition(min(buckets, max_partitions), "bucket").groupBy("bucket", "a", "b").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text")).alias("x"))
    return one.select("bucket", "a", "b", F.col("x.id").alias("first"), F.col("x.text").alias("text"))


def shingle_counts(dealt: DataFrame, words: int, parts: int) -> DataFrame:
    """(bucket, part, counts): in how many texts of all buckets each distinct shingle of a bucket occurs.

    ``counts`` are 32-bit numbers in the order of the shingles' hashes, cut into ranges of hashes.
    """
    bounds = np.array([-(-(k << 64) // parts) for k in range(parts)], np.uint64)

    def local(texts: pa.Table) -> pa.Table:
        held = [found[0] for *_, found in bucket_shingles(texts, words)]
        hashes, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        cuts = np.append(np.searchsorted(hashes, bounds), len(hashes))
        some = np.flatnonzero(np.diff(cuts))
        bucket = texts.column("bucket")[0].as_py()
        return pa.table({
            "bucket": pa.array([bucket] * len(some), pa.int64()), "part": pa.array(some.astype(np.int32)),
            "hashes": pa.array([hashes[cuts[k]:cuts[k + 1]].tobytes() for k in some], pa.binary()),
            "counts": pa.array([count[cuts[k]:cuts[k + 1]].astype(np.int32).tobytes() for k in some], pa.binary())})

    def total(rows: pa.Table) -> pa.Table:
        hashes, counts = ([np.frombuffer(x.as_py(), kind) for x in rows.column(c)] for c, kind in (("hashes", np.uint64), ("counts", np.int32)))
        _, place = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(place, np.concatenate(counts)).astype(np.int32)[place]
        ends = np.cumsum([len(h) for h in hashes])
        out = [sums[e - len(h):e].tobytes() for h, e in zip(hashes, ends.tolist())]
        return pa.table({"bucket": rows.column("bucket"), "part": rows.column("part"), "counts": pa.array(out, pa.binary())})

    sent = dealt.groupBy("bucket").applyInArrow(local, "bucket bigint, part int, hashes binary, counts binary")
    return sent.groupBy("part").applyInArrow(total, "bucket bigint, part int, counts binary")


def bucket_shingles(texts: pa.Table, words: int):
    """(first row, rows, shingles, their offsets, (distinct shingles, term frequencies, their offsets)) of some texts at a time."""
    data, offsets = text_buffers(texts.column("text"))
    for x, y in blocks(offsets):
        hashes, at = shingles(data[offsets[x]:offsets[y]], offsets[x:y + 1] - offsets[x], words)
        yield x, y, hashes, at, weighted(hashes, at, (np.zeros(0, np.uint64), np.zeros(0), 1.0))


def reached(hashes: list[np.ndarray], keys: np.ndarray, idf, similarity: float) -> np.ndarray:
    """For each text of a group the first text of its class; ``keys`` are its buckets (texts, bands)."""
    n = len(hashes)
    offsets = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
    flat, weight, at = weighted(np.concatenate(hashes), offsets, idf)
    rank = np.unique(flat, return_inverse=True)[1]
    size = np.diff(at)
    total = np.add.reduceat(weight, at[:-1])
    own = np.zeros(int(rank.max()) + 1)
    _, bucket = np.unique(keys.ravel() ^ mix64(np.tile(np.arange(keys.shape[1], dtype=np.uint64), n)), return_inverse=True)
    bucket = bucket.reshape(keys.shape)
    order = np.argsort(bucket.ravel(), kind="stable")
    members = np.split(order // keys.shape[1], np.cumsum(np.bincount(bucket.ravel()))[:-1])
    label = np.full(n, -1)
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed], queue = seed, [seed]
        while queue:
            x = queue.pop()
            near = []
            for b in bucket[x]:
                if len(members[b]):
                    members[b] = members[b][label[members[b]] < 0]
                    near.append(members[b])
            near = np.unique(np.concatenate(near)) if near else np.zeros(0, np.int64)
            if len(near) == 0:
                continue
            own[rank[at[x]:at[x + 1]]] = weight[at[x]:at[x + 1]]
            entries = ranges(at[near], size[near])
            both = np.add.reduceat(np.minimum(weight[entries], own[rank[entries]]), np.cumsum(size[near]) - size[near])
            own[rank[at[x]:at[x + 1]]] = 0.0
            hit = near[both >= similarity * (total[near] + total[x] - both) - 1e-9]
            label[hit] = seed
            queue.extend(hit.tolist())
    return label


def connected(rows: DataFrame, name: str) -> DataFrame:
    """(v, label): the smallest vertex connected to each; ``rows`` (v, bucket) are stored, vertices of a bucket belong together."""
    labels = materialize(rows.select("v").distinct().select("v", F.col("v").alias("label")), name)
    while True:
        low = rows.join(labels, "v").groupBy("bucket").agg(F.min("label").alias("label"))
        new = rows.join(low, "bucket").groupBy("v").agg(F.min("label").alias("near"))
        # and one step along the labels, which halves what is left of a chain
        new = new.join(labels.select("v", F.col("label").alias("before")), "v")
        step = labels.select(F.col("v").alias("near"), F.col("label").alias("far"))
        new = materialize(new.join(step, "near").select("v", F.least("near", "far").alias("label"), "before"), name)
        labels = new.select("v", "label")
        if new.where(F.col("label") != F.col("before")).isEmpty():
            return labels


def across(rows: DataFrame, cut: DataFrame, classes: DataFrame, group_shingles: int) -> DataFrame:
    """(v, group): tasks in which any two texts of a bucket in ``cut`` that are of different ``classes`` meet.

    ``rows`` (v, size, bucket). The largest class of a bucket is not compared with itself, so its texts go to
    as many tasks as the others have pieces. Two pieces have about ``group_shingles`` shingles.
    """
    rows = rows.join(cut.select("bucket"), "bucket", "left_semi").join(classes, "v")
    sizes = rows.groupBy("bucket", "label").agg(F.sum("size").alias("_size"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("_size", "label")).alias("_top"), F.sum("_size").alias("_all"))
    count = lambda size: F.greatest(F.ceil(2 * size / group_shingles), F.lit(1)).cast("bigint")
    sizes = sizes.where(F.col("_all") > F.col("_top._size")).select(
        "bucket", F.col("_top.label").alias("_label"), count(F.col("_top._size")).alias("_p"), count(F.col("_all") - F.col("_top._size")).alias("_q"))
    # pieces 0 ... _p - 1 are of the largest class, _p ... _p + _q - 1 of the others
    top, deal = F.col("label") == F.col("_label"), F.xxhash64("v", "bucket")
    own = F.when(top, F.pmod(deal, F.col("_p"))).otherwise(F.col("_p") + F.pmod(deal, F.col("_q")))
    rows = rows.join(sizes, "bucket").withColumn("_own", own).withColumn(
        "_other", F.explode(F.sequence(F.when(top, F.col("_p")).otherwise(F.lit(0)), F.col("_p") + F.col("_q") - 1)))
    pair = F.least("_own", "_other") * (F.col("_p") + F.col("_q")) + F.greatest("_own", "_other")
    return rows.where("_own != _other").select("v", F.struct(
        F.lit(2).alias("kind"), F.xxhash64("bucket").alias("one"), pair.alias("two")).alias("group"))


def near_duplicates(
    docs: DataFrame, similarity: float = 0.8, words: int = 5, bands: int = 9, rows: int = 3, floor: float = 0.1,
    group_shingles: int = 4_000_000, id_column: str = "doc_id", text_column: str = "text", bucket_bytes: int = 8 << 20,
) -> DataFrame:
    """``docs`` with class_id (the smallest id of the class), class_text (a, b of its text) and is_first."""
    texts = distinct_texts(docs, id_column, text_column)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    one_each = docs.select(*text_keys(text), F.octet_length(text).alias("n")).distinct()
    n_texts, size = one_each.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = max(1, -(-size // bucket_bytes))
    idf = common_shingles(texts, words, floor, max(n_texts, 1)) if floor > 0 else None
    kind = texts.schema["first"].dataType.simpleString()

    def sign(texts: pa.Table, counts: pa.Table) -> pa.Table:
        found = list(bucket_shingles(texts, words))
        out = [pa.schema(columns).empty_table()]
        if idf is None:
            order = np.argsort(counts.column("part").to_numpy())
            held = counts.column("counts").combine_chunks()
            total = np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(held[k].as_py(), np.int32) for k in order.tolist()]])
            known = np.unique(np.concatenate([f[0] for *_, f in found])) if found else np.zeros(0, np.uint64)
        for x, _, hashes, at, (flat, tf, at_) in found:
            some = np.flatnonzero(np.diff(at))
            if len(some) == 0:
                continue
            if idf is None:
                n = total[np.searchsorted(known, flat)]
                weight, ends = tf * (1.0 - np.log(n / n_texts)), at_
            else:
                n, ends = np.zeros(0, np.int32), np.zeros(len(at_), np.int64)
                weight = weighted(hashes, at, idf)[1]
            drawn = samples(flat, weight, np.append(at_[some], len(flat)), bands * rows).reshape(bands, rows, -1)
            key = drawn[:, 0]
            for k in range(1, rows):
                key = mix64(key * np.uint64(31) + drawn[:, k])
            offsets_ = pa.array(np.arange(0, bands * len(some) + 1, bands, dtype=np.int32))
            keys = pa.ListArray.from_arrays(offsets_, pa.array(key.T.ravel().view(np.int64)))
            counted = pa.ListArray.from_arrays(pa.array(np.append(ends[some], len(n)).astype(np.int32)), pa.array(n))
            own = [texts.column(c).take(pa.array(some + x)) for c in ("a", "b", "first")]
            out.append(pa.Table.from_arrays([*own, pa.array(np.diff(at)[some]), keys, counted], schema=pa.schema(columns)))
        return pa.concat_tables(out)

    columns = [("a", pa.int64()), ("b", pa.int64()), ("first", to_arrow_type(texts.schema["first"].dataType)), ("size", pa.int64()),
               ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))]
    dealt = dealt_texts(docs, buckets, id_column, text_column)
    signature = f"a bigint, b bigint, first {kind}, size bigint, keys array<bigint>, counts array<int>"
    if idf is None:
        # both uses of ``dealt`` are one shuffle
        both = dealt.groupBy("bucket").cogroup(shingle_counts(dealt, words, buckets).groupBy("bucket"))
        signed = both.applyInArrow(sign, signature)
    else:
        signed = dealt.groupBy("bucket").applyInArrow(lambda held: sign(held, None), signature)
    vertex = F.struct(F.col("first").isNull().alias("none"), F.col("first"), F.col("a"), F.col("b")).alias("v")
    signed = materialize(signed.select(vertex, "size", "keys", "counts"), "signatures")
    each = signed.select("v", "size", F.posexplode("keys").alias("band", "key"))
    crowd = each.groupBy("band", "key").agg(F.count("*").alias("_n")).where("_n > 1")
    each = each.join(crowd, ["band", "key"]).select("v", "size", F.struct("band", "key").alias("bucket"))
    each = materialize(each, "buckets")
    parts = connected(each.select("v", "bucket"), "parts")

    # groups: whole parts, or buckets of parts that are too large for a task, or pieces of such buckets
    part_size = parts.join(signed.select("v", "size"), "v").groupBy("label").agg(F.sum("size").alias("_size"))
    parts = parts.join(part_size, "label")
    whole = parts.where(F.col("_size") <= group_shingles).select("v", F.struct(
        F.lit(0).alias("kind"), F.xxhash64("label").alias("one"), F.lit(0).cast("bigint").alias("two")).alias("group"))
    large = each.join(parts.where(F.col("_size") > group_shingles).select("v"), "v")
    pieces = large.groupBy("bucket").agg(F.ceil(F.sum("size") / group_shingles).cast("int").alias("_pieces"))
    rank = Window.partitionBy("bucket").orderBy("v")
    heads = large.withColumn("_k", F.row_number().over(rank)).where(F.col("_k") <= HEADS).join(pieces, "bucket")
    heads = heads.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    dealt = large.join(pieces, "bucket").withColumn("_piece", F.pmod(F.xxhash64("v", "bucket"), F.col("_pieces")).cast("int"))
    split = dealt.select("v", "bucket", "_piece").unionByName(heads.select("v", "bucket", "_piece")).distinct()
    split = split.select("v", F.struct(F.lit(1).alias("kind"), F.xxhash64("bucket").alias("one"), F.col("_piece").cast("bigint").alias("two")).alias("group"))
    def shingled(batches):
        for batch, x, y, data, offsets in text_blocks(batches, 3):
            hashes, at = shingles(data, offsets, words)
            rows_ = pa.array(np.arange(x, y))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(rows_) for k in (0, 1, 2, 4, 5, 6)], lists], ["a", "b", "first", "groups", "keys", "counts", "set"])

    group_type = "struct<kind: int, one: bigint, two: bigint>"
    order = ["kind", "one", "two", "none", "first", "a", "b"]

    def verify(batches):
        held, now = [], None
        for batch in batches:
            kinds, one, two = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(one)]):
                if now != (kinds[s], one[s], two[s]):
                    if held:
                        yield classes(held)
                    held, now = [], (kinds[s], one[s], two[s])
                held.append(batch.slice(s, e - s))
        if held:
            yield classes(held)

    def classes(held):
        table = pa.Table.from_batches(held).combine_chunks()
        keys, counts, sets_ = (table.column(k).combine_chunks() for k in (7, 8, 9))
        at = sets_.offsets.to_numpy() - sets_.offsets[0].as_py()
        flat = sets_.flatten().to_numpy().view(np.uint64)
        keys = keys.flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)
        own = 1.0 - np.log(counts.flatten().to_numpy() / n_texts) if idf is None else idf
        label = pa.array(reached([flat[s:e] for s, e in zip(at[:-1], at[1:])], keys, own, similarity))
        columns = [table.column(k).combine_chunks() for k in (0, 3, 4, 5, 6)]
        return pa.RecordBatch.from_arrays([*columns, *[c.take(label) for c in columns[1:]]], names)

    names = ["kind", "none", "first", "a", "b", "to_none", "to_first", "to_a", "to_b"]
    to = F.struct(F.col("to_none").alias("none"), F.col("to_first").alias("first"), F.col("to_a").alias("a"), F.col("to_b").alias("b"))

    def linked(members, name):
        """(kind, v, label) of ``members`` (v, group): the first text that a text is connected to within its group."""
        groups = members.groupBy("v").agg(F.collect_list("group").alias("groups"))
        groups = groups.join(signed.select("v", "keys", "counts"), "v").select(F.col("v.a").alias("a"), F.col("v.b").alias("b"), "groups", "keys", "counts")
        sets = texts.select("a", "b", "first", "text").join(groups, ["a", "b"], "left").where(F.col("groups").isNotNull())
        sets = sets.select("a", "b", "first", "text", "groups", "keys", "counts").mapInArrow(
            shingled, f"a bigint, b bigint, first {kind}, groups array<{group_type}>, keys array<bigint>, counts array<int>, set array<bigint>")
        sets = sets.select(F.explode("groups").alias("group"), vertex, "keys", "counts", "set").select("group.*", "v.*", "keys", "counts", "set")
        sets = sets.repartition("kind", "one", "two").sortWithinPartitions(*order)
        out = sets.mapInArrow(verify, f"kind int, none boolean, first {kind}, a bigint, b bigint, to_none boolean, to_first {kind}, to_a bigint, to_b bigint")
        return materialize(out.select("kind", F.struct("none", "first", "a", "b").alias("v"), to.alias("label")), name)

    def edges(found):
        return found.select("v", F.col("label").alias("bucket")).unionByName(found.select(F.col("label").alias("v"), F.col("label").alias("bucket")))

    links = linked(whole.unionByName(split), "links")
    final = links.where("kind = 0").select("v", "label")
    split = links.where("kind = 1")
    if not split.isEmpty():
        known = materialize(edges(split).distinct(), "edges")
        classes_ = connected(known, "classes")
        rest = across(large, pieces.where("_pieces > 1"), classes_, group_shingles)
        if not rest.isEmpty():
            more = edges(linked(rest, "rest_links"))
            classes_ = connected(materialize(known.unionByName(more).distinct(), "rest_edges"), "rest_classes")
        final = final.unionByName(classes_)
    final = final.select("v.a", "v.b", "label")

    results = ("class_id", "class_text", "is_first")
    rows_ = docs.select(packed(docs, *[c for c in results if c not in (id_column, text_column)]), F.col(id_column).alias("id"), *text_keys(text))
    firsts = rows_.groupBy("a", "b").agg(F.min("id").alias("least")).join(final, ["a", "b"], "left")
    own = F.struct(F.col("a"), F.col("b"))
    firsts = firsts.select("a", "b", F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("label.first")).alias("class_id"),
                           F.when(F.col("label").isNull(), own).otherwise(F.struct(F.col("label.a").alias("a"), F.col("label.b").alias("b"))).alias("class_text"))
    out = rows_.join(firsts, ["a", "b"], "left")
    same = (F.col("class_text.a") == F.col("a")) & (F.col("class_text.b") == F.col("b"))
    return out.withColumn("is_first", same & F.col("id").eqNullSafe(F.col("class_id"))).select("row.*", *results)
