"""Hard-negative mining with a secondary sort.

Rows are dealt into shards, and every anchor is scored against every shard as
one exact integer matrix product. Of an anchor's pairs a shard passes on only
what can be in the result: its best same-label rows, and, once the positives of
all shards are known, for each positive its best different-label rows within
the positive's score window. These pair scores are shuffled by anchor and
sorted within the partitions by the key (anchor, descending score, id); a
positive sorts before a negative of the same score. One pass over the sorted
stream opens a window at each positive and writes the negatives that fall into
open windows. It holds the open windows of one anchor and no pairs.

Defined results: rows with a null id, label or vector, or a null or non-finite
component take no part; of rows under one id the smallest by label, then
vector, counts; only vectors of the anchor's length are compared; ties go to the
smaller id; integers beyond 2**28 / the root of the length count as that bound;
an anchor without positives, or an empty table, gives no rows.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from voltide.llm.common import materialize
from voltide.llm.vector_codes import EXACT, finite

PAIR = "anchor_id bigint, score bigint, vec_id bigint"
# elements of a score matrix that a task holds at a time
CELLS = 1 << 21
# bytes of the vectors of a shard as doubles
SHARD_BYTES = 32 << 20


def products(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Exact inner products of integer rows as 64-bit integers; ``most`` bounds their components."""
    if most * most * max(1, a.shape[1]) < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def best(score: np.ndarray, wanted: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k highest wanted scores of each row; equal scores go to the earlier columns."""
    if score.shape[1] > k:
        lowest = np.iinfo(np.int64).min
        floor = np.partition(np.where(wanted, score, lowest), -k, axis=1)[:, -k, None]
        wanted = wanted & (score >= floor)
        tied = wanted & (score == floor)
        room = k - (wanted.sum(axis=1) - tied.sum(axis=1))
        wanted &= ~tied | (np.cumsum(tied, axis=1) <= room[:, None])
    return wanted


def against_shards(entries: DataFrame, anchors: DataFrame, shards: Column, pick) -> DataFrame:
    """Pairs (anchor_id, score, vec_id) that ``pick`` marks in each block of anchors by rows of a shard.

    ``anchors`` has an array ``bounds`` that is handed to ``pick`` along with
    the scores, equality of labels and equality of ids.
    """
    columns = ["dim", "shard", "kind", "vec_id", "label", "vector", "bounds"]
    rows = entries.withColumns({"shard": F.pmod(F.xxhash64("vec_id"), shards), "kind": F.lit(0), "bounds": F.lit(None).cast("array<bigint>")})
    asked = anchors.withColumns({"shard": F.explode(F.sequence(F.lit(0).cast("bigint"), shards - 1)), "kind": F.lit(1)})
    both = rows.select(*columns).unionByName(asked.select(*columns))
    dealt = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind", "vec_id")

    def run(batches):
        now, held, shard = None, [], None
        for batch in batches:
            dim, number, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((dim[1:] != dim[:-1]) | (number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(dim)]):
                if b == a:
                    continue
                part = batch.slice(a, b - a)
                data = part.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b - a, dim[a])
                if (dim[a], number[a]) != now:
                    now, held, shard = (dim[a], number[a]), [], None
                if kind[a] == 0:
                    held.append((part.column(3), part.column(4), data))
                    continue
                if not held:
                    continue
                if shard is None:
                    labels = pa.chunked_array([x[1] for x in held]).combine_chunks().dictionary_encode()
                    ids = np.concatenate([x[0].to_numpy() for x in held])
                    points = np.concatenate([x[2] for x in held])
                    shard = ids, labels.indices.to_numpy(), labels.dictionary, points, int(np.abs(points).max(initial=0))
                ids, codes, names, points, most = shard
                step = max(1, CELLS // len(ids))
                for c in range(0, b - a, step):
                    own = part.slice(c, step)
                    label = pc.fill_null(pc.index_in(own.column(4), names), -1).to_numpy()
                    x = data[c:c + step]
                    score = products(x, points, max(most, int(np.abs(x).max(initial=0))))
                    anchor = own.column(3).to_numpy()
                    at = np.nonzero(pick(score, label[:, None] == codes, anchor[:, None] == ids, own.column(6).to_pylist()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[at[0]]), pa.array(score[at]), pa.array(ids[at[1]])], ["anchor_id", "score", "vec_id"])

    return dealt.mapInArrow(run, PAIR)


def opened_windows(pairs: DataFrame, low: int, high: int, n_negatives: int) -> DataFrame:
    """Secondary sort of pair scores, and the streaming pass that pairs positives with negatives.

    ``pairs`` has anchor_id, score, vec_id and kind (0 for a positive). A
    negative belongs to a positive where low * positive <= 100 * negative <=
    high * positive.
    """
    ordered = pairs.repartition("anchor_id").sortWithinPartitions("anchor_id", F.desc("score"), "kind", "vec_id")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"

    def run(batches):
        now, windows = None, []
        for batch in batches:
            out = []
            for anchor, score, row, kind in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if anchor != now:
                    now, windows = anchor, []
                if kind == 0:
                    windows.append([row, score, 0])
                    continue
                for window in windows:
                    if window[2] < n_negatives and low * window[1] <= 100 * score <= high * window[1]:
                        window[2] += 1
                        out.append((anchor, window[0], window[2], row, window[1], score))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(zip(*out) if out else [()] * 6)],
                ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return ordered.select("anchor_id", "score", "vec_id", "kind").mapInArrow(run, schema)


def mine(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    shard_rows: int = 16384, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``is_anchor`` picks.

    An anchor's positives are its ``n_positives`` highest-scoring rows of the
    same label, a positive's negatives the ``n_negatives`` highest-scoring rows
    of other labels whose score is ``low`` to ``high`` percent of the positive's.
    ``is_anchor`` is evaluated on the input's columns; a row is an anchor where
    it holds for any row under its id.
    """
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("vec_id"), F.col(label_column).cast("string").alias("label"),
        F.col(vector_column).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r"), F.max("is_anchor").alias("is_anchor"))
    size = F.greatest(F.size("r.vector"), F.lit(1)).cast("double")
    bound = F.floor(F.lit(float(1 << 28)) / F.sqrt(size))
    whole = F.transform("r.vector", lambda x: F.greatest(F.least(F.floor(x * scale), bound), -bound).cast("int"))
    entries = one.select("vec_id", "is_anchor", F.col("r.label").alias("label"), F.size("r.vector").alias("dim"), whole.alias("vector"))
    entries = materialize(entries, "negative_rows")
    shards = F.lit(1)
    for r in entries.groupBy("dim").count().collect():  # one number per length of vectors
        own = max(1, min(shard_rows, SHARD_BYTES // (8 * max(1, r.dim))))
        shards = F.when(F.col("dim") == r.dim, F.lit(-(-r["count"] // own))).otherwise(shards)
    shards = shards.cast("bigint")
    anchors = entries.where("is_anchor").withColumn("bounds", F.lit(None).cast("array<bigint>"))

    same = against_shards(entries, anchors, shards, lambda score, label, own, _: best(score, label & ~own, n_positives))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    positives = same.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n_positives).drop("_n")
    positives = materialize(positives, "positives")
    spans = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("score").alias("bounds"))

    def in_windows(score, label, own, bounds):
        out = np.zeros(score.shape, bool)
        for k in range(max(map(len, bounds), default=0)):
            p = np.array([b[k] if k < len(b) else -1 for b in bounds], np.int64)[:, None]  # no score is in the window of -1
            out |= best(score, ~label & (low * p <= 100 * score) & (100 * score <= high * p), n_negatives)
        return out

    other = against_shards(entries, anchors.drop("bounds").join(spans, "vec_id"), shards, in_windows)
    pairs = positives.withColumn("kind", F.lit(0)).unionByName(other.withColumn("kind", F.lit(1)))
    return opened_windows(pairs, low, high, n_negatives)
