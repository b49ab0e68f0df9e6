"""Approximate nearest neighbours with vantage-point trees, one per shard.

Candidates are dealt into shards of about ``shard_rows`` vectors. A task builds
the tree of a shard and streams the queries through it; a query first visits
the leaf it falls into, then every subtree that the triangle inequality cannot
rule out. A subtree whose distances to the vantage point miss the query's by
more than ``factor`` times the distance of its k-th neighbour so far is skipped:
factor one is exact search, smaller factors skip more.

Nearness is the cosine in double precision; the chord between unit vectors is
the metric of the trees. Equal vectors are one entry with the ``k + 1`` smallest
ids, which is all that a result can hold.

Defined results: rows with a null id or vector, a null or non-finite component
or a zero vector take no part; vectors are compared with vectors of their own
dimension; rows of one id and vector count once; among different vectors under
one id the smallest is the query, and none is a candidate of its own id; ties
go to the smaller id; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voltide.llm.common import materialize

RESULT = "query_id bigint, vec_id bigint, score double"


class VantageTree:
    """Tree over unit vectors; leaves hold all points, inner nodes the bounds of their children."""

    def __init__(self, unit: np.ndarray, leaf_rows: int = 64):
        self.unit, self.leaves, self.nodes = unit, [], []
        self.root = self._build(np.arange(len(unit)), leaf_rows)

    def _build(self, rows: np.ndarray, leaf_rows: int) -> int:
        if len(rows) <= leaf_rows:
            self.leaves.append(rows)
            return -len(self.leaves)
        centre = self.unit[rows].mean(axis=0)
        point = rows[np.argmin(self.unit[rows] @ centre)]  # a vantage point at the rim
        d = chord(self.unit[rows] @ self.unit[point])
        order = np.argsort(d, kind="stable")
        rows, d, half = rows[order], d[order], len(rows) // 2
        at = len(self.nodes)
        self.nodes.append(None)
        inner, outer = self._build(rows[:half], leaf_rows), self._build(rows[half:], leaf_rows)
        self.nodes[at] = (point, d[half], (inner, d[0], d[half - 1]), (outer, d[half], d[-1]))
        return at

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows of each unit query and their cosines; -1 where there are fewer."""
        n = len(queries)
        best, score = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)
        home = np.zeros(n, np.int64)
        todo = [(self.root, np.arange(n))]
        while todo:  # down to the leaf each query falls into
            node, who = todo.pop()
            if len(who) == 0:
                continue
            if node < 0:
                home[who] = node
                self._visit(node, who, queries, best, score, k)
                continue
            point, middle, inner, outer = self.nodes[node]
            near = chord(queries[who] @ self.unit[point]) < middle
            todo += [(inner[0], who[near]), (outer[0], who[~near])]
        todo = [(self.root, np.arange(n))]
        while todo:  # everything that cannot be ruled out
            node, who = todo.pop()
            if node < 0:
                self._visit(node, who[home[who] != node], queries, best, score, k)
                continue
            point, _, *children = self.nodes[node]
            d = chord(queries[who] @ self.unit[point])
            reach = factor * chord(np.maximum(score[who, -1], -1.0)) + 1e-9
            for child, low, high in children:
                stay = who[np.maximum(low - d, d - high) <= reach]
                if len(stay):
                    todo.append((child, stay))
        return best, score

    def _visit(self, leaf, who, queries, best, score, k):
        rows = self.leaves[-leaf - 1]
        if len(who) == 0 or len(rows) == 0:
            return
        found = queries[who] @ self.unit[rows].T
        better = found.max(axis=1) >= score[who, -1]
        who, found = who[better], found[better]
        if len(who) == 0:
            return
        both = np.concatenate([score[who], found], axis=1)
        index = np.concatenate([best[who], np.broadcast_to(rows, found.shape)], axis=1)
        by_row = np.argsort(np.where(index < 0, np.iinfo(np.int64).max, index), axis=1, kind="stable")
        both, index = np.take_along_axis(both, by_row, 1), np.take_along_axis(index, by_row, 1)
        top = np.argsort(-both, axis=1, kind="stable")[:, :k]
        score[who], best[who] = np.take_along_axis(both, top, 1), np.take_along_axis(index, top, 1)


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, factor: float = 0.6, shard_rows: int = 8192,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row that ``is_query`` picks, against all rows."""
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    same = Window.partitionBy("vector").orderBy("vec_id")
    queries = rows.where("is_query").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    # a window limit keeps k + 1 rows of a vector per task, however many rows share it
    entries = rows.select("vec_id", "vector").distinct().withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1)
    entries = entries.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = materialize(entries, "vectors")
    sizes = {r.dim: r.n for r in entries.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    shards = F.lit(0)
    for dim, n in sizes.items():  # one entry per dimension of vectors
        shards = F.when(F.size("vector") == dim, F.lit(-(-n // shard_rows))).otherwise(shards)
    place = F.pmod(F.xxhash64("vector"), shards)
    entries = entries.select(F.size("vector").alias("dim"), place.alias("shard"), F.lit(0).alias("kind"), "ids", "vector")
    asked = queries.select(F.size("vector").alias("dim"), F.explode(F.sequence(F.lit(0).cast("bigint"), shards.cast("bigint") - 1)).alias("shard"),
                           F.lit(1).alias("kind"), F.array("vec_id").alias("ids"), "vector")
    both = entries.withColumn("shard", F.col("shard").cast("bigint")).unionByName(asked)
    dealt = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind", F.element_at("ids", 1))
    keep = k + 1

    def run(batches):
        now, held, tree = None, [], None
        for batch in batches:
            dim, shard, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(dim)]):
                part = batch.slice(a, b - a)
                data = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(b - a, dim[a])
                if (dim[a], shard[a]) != now:
                    now, held, tree = (dim[a], shard[a]), [], None
                if kind[a] == 0:
                    held.append((part.column(3), data))
                    continue
                if not held:
                    continue
                if tree is None:
                    ids = pa.chunked_array([x for x, _ in held]).combine_chunks()
                    points = np.concatenate([x for _, x in held])
                    norms = np.sqrt(np.einsum("ij,ij->i", points, points))
                    tree = VantageTree(points / norms[:, None])
                    at = ids.offsets.to_numpy()
                    ids = ids.flatten().to_numpy(), at - at[0]
                for c in range(0, b - a, 1024):
                    own = part.column(3).slice(c, 1024).flatten().to_numpy()
                    yield answer(tree, ids, points, norms, own, data[c:c + 1024])

    def answer(tree, ids, points, norms, own, data):
        size = np.sqrt(np.einsum("ij,ij->i", data, data))
        best, _ = tree.search(data / size[:, None], keep, factor)
        q, _ = np.nonzero(best >= 0)
        row = best[best >= 0]
        score = np.einsum("ij,ij->i", data[q], points[row]) / (size[q] * norms[row])
        count = np.diff(ids[1])[row]
        flat = np.repeat(ids[1][row] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        q, vec, score = np.repeat(q, count), ids[0][flat], np.repeat(score, count)
        other = vec != own[q]
        q, vec, score = q[other], vec[other], score[other]
        order = np.lexsort((vec, -score, q))
        q, vec, score = q[order], vec[order], score[order]
        first = np.searchsorted(q, q)
        top = np.arange(len(q)) - first < k
        return pa.RecordBatch.from_arrays([pa.array(own[q[top]]), pa.array(vec[top]), pa.array(score[top])],
                                          ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # an id with several vectors counts once, by its nearest
    once = Window.partitionBy("query_id", "vec_id").orderBy(F.desc("score"))
    found = found.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
