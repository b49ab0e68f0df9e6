"""Quality classifier by co-training a text view and a page-metadata view.

The text view sees hashed beginnings of words and a few shares of characters;
the metadata view sees hashed columns such as language and source, and sizes.
Both are logistic regressions. Their labelled documents are a bounded sample, at
most ``max_labelled``, those with the smallest hash of their id; it is fitted in
one task. In each round either view labels those of all other documents that it
is confident about, and the other view learns from them: tasks score the
documents and sum the gradient and curvature that these labels add to the other
view's loss, and the next fit adds the sums to the loss of the sample. All
pseudo-labelled documents together weigh ``taught_share`` of the labelled ones,
whatever their number. Each view is calibrated on labelled documents kept apart
(Platt scaling), and a last regression of the two calibrated logits, also
fitted there, combines them. All documents are scored in one pass over whole
texts. The driver sees weights and sums, a number for each feature.

A document is good if its quality label is 1 and it is not marked toxic.

Defined results: null text is empty, null metadata is a value of its own;
labels of null ids or null quality are ignored, null toxic counts as 0, and of
several labels of one id the worst counts; of several documents under one id
one is learned from; with labels of one kind only, or none, every document
scores that kind (none: good); an empty table gives no rows; a column of the
input that has the name of a result column is replaced by it.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from voltide.llm.common import blocks, byte_codes, materialize, mix64, packed, prefix_hash, span_hash, text_buffers

TEXT_BITS, META_BITS = 15, 12
LENGTHS = (4, 6, 32)
DENSE = 7
# bytes of text that become features at a time, and entries of sparse rows that are multiplied at a time
TEXT_BYTES, ENTRIES = 256 << 10, 1 << 18


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of texts: (text, feature, value), sorted by text; the last ``DENSE`` features are shares."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        high = np.zeros(len(data), bool)
        high[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        lower[high] += 32
    letter = ((lower >= 97) & (lower <= 122)) | (data >= 128)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    inner = offsets[:-1][size > 0]
    begins[inner] = letter[inner]
    starts = np.flatnonzero(begins)
    stop = np.append(np.flatnonzero(~letter), len(data))
    ends = stop[np.searchsorted(stop, starts)]
    text_of = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.minimum(ends, offsets[text_of + 1])
    prefix = prefix_hash(byte_codes(lower))
    found, of = [], []
    for k, n in enumerate(LENGTHS):
        long = ends - starts >= (n if k < len(LENGTHS) - 1 else 1)
        until = np.minimum(starts[long] + n, ends[long]) if k < len(LENGTHS) - 1 else ends[long]
        hashes = span_hash(prefix, starts[long], until)
        found.append((mix64(hashes + np.uint64(k + 1)) >> np.uint64(64 - TEXT_BITS)).astype(np.int64))
        of.append(text_of[long])
    key, count = np.unique((np.concatenate(of) << TEXT_BITS) | np.concatenate(found), return_counts=True)
    text, feature, value = key >> TEXT_BITS, key & ((1 << TEXT_BITS) - 1), np.log1p(count)
    words = np.bincount(text_of, minlength=rows)
    distinct = np.bincount(text, minlength=rows)
    shares = []
    row = np.repeat(np.arange(rows), size)
    for hit in ((data >= 65) & (data <= 90), data == 33, np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8))):
        shares.append(np.log1p(100.0 * np.bincount(row[hit], minlength=rows) / (size + 100.0)))
    whole = span_hash(prefix, starts, ends)
    same = np.zeros(len(starts), bool)
    same[1:] = (whole[1:] == whole[:-1]) & (text_of[1:] == text_of[:-1])
    shares.append(np.log1p(100.0 * np.bincount(text_of[same], minlength=rows) / (words + 10.0)))
    shares += [np.log1p(words), np.log1p(100.0 * distinct / (3.0 * words + 50.0)), np.ones(rows)]
    dense = np.stack(shares, 1)
    text = np.concatenate([text, np.repeat(np.arange(rows), dense.shape[1])])
    feature = np.concatenate([feature, np.tile((1 << TEXT_BITS) + np.arange(dense.shape[1]), rows)])
    value = np.concatenate([value, dense.ravel()])
    order = np.argsort(text, kind="stable")
    return text[order], feature[order], value[order]


def meta_features(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of metadata: ``hashes`` (documents, columns) and ``sizes`` (documents, numbers; nan for null)."""
    rows = len(hashes)
    steps = np.where(np.isnan(sizes), -1.0, np.round(2 * np.log2(1.0 + np.maximum(np.nan_to_num(sizes), 0.0)))).astype(np.int64).view(np.uint64)
    values = np.concatenate([hashes.astype(np.uint64), steps], axis=1)
    both = mix64(hashes.astype(np.uint64).sum(axis=1, keepdims=True, dtype=np.uint64)) if hashes.shape[1] else np.zeros((rows, 0), np.uint64)
    values = np.concatenate([values, both], axis=1)
    values = mix64(values + np.arange(values.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    feature = np.concatenate([(values >> np.uint64(64 - META_BITS)).astype(np.int64), np.full((rows, 1), 1 << META_BITS)], axis=1)
    return np.repeat(np.arange(rows), feature.shape[1]), feature.ravel(), np.ones(feature.size)


class Sparse:
    """Rows of sparse features."""

    def __init__(self, rows: int, row, feature, value, width: int):
        self.rows, self.row, self.feature, self.value, self.width = rows, row, feature, value, width  # sorted by row

    def where(self, chosen: np.ndarray) -> "Sparse":
        place = (np.cumsum(chosen) - 1).astype(self.row.dtype)
        of = chosen[self.row]
        return Sparse(int(chosen.sum()), place[self.row[of]], self.feature[of], self.value[of], self.width)

    def parts(self):
        """Some entries at a time: (row, feature, value)."""
        for first in range(0, len(self.row), ENTRIES):
            yield tuple(x[first:first + ENTRIES] for x in (self.row, self.feature, self.value))

    def times(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.rows)
        for row, feature, value in self.parts():
            out += np.bincount(row, value * weights[feature], self.rows)
        return out

    def back(self, residual: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for row, feature, value in self.parts():
            out += np.bincount(feature, value * residual[row], self.width)
        return out


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def fit(x: Sparse, target: np.ndarray, weight: np.ndarray, hashed: int, ridge: float = 1.5, steps: int = 120, rate: float = 0.15, against: bool = False,
        taught: "Taught" = None) -> np.ndarray:
    """Weighted logistic regression by full-batch Adam; the first ``hashed`` features are held back more than the others.

    With ``against`` they can only speak against a document: clean words do not make up for a foul one.
    """
    total = max(weight.sum(), 1e-12)
    mass = 0.0 if taught is None else taught.mass
    ridge = np.where(np.arange(x.width) < hashed, ridge / max(total + mass, 1.0), 1e-6)
    w, m, v = np.zeros(x.width), np.zeros(x.width), np.zeros(x.width)
    weight = weight / (total + mass)
    for t in range(1, steps + 1):
        g = x.back(weight * (sigmoid(x.times(w)) - target)) + ridge * w
        if taught is not None:
            g += (taught.slope + taught.curve * (w - taught.at)) / (total + mass)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
        if against:
            w[:hashed] = np.minimum(w[:hashed], 0.0)
    return w


@dataclass
class Taught:
    """What pseudo-labels add to a view's loss near the weights ``at``: slope and curvature of each weight, and their mass."""

    slope: np.ndarray
    curve: np.ndarray
    at: np.ndarray
    mass: float


def newton(columns: np.ndarray, target: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """A small logistic regression with an intercept in the last place."""
    x = np.concatenate([columns, np.ones((len(columns), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        g = x.T @ (p - target) + ridge * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, g), -4, 4)
    return w


@dataclass
class Model:
    text: np.ndarray  # weights of the views
    meta: np.ndarray
    calibration: np.ndarray  # slope and intercept per view
    mix: np.ndarray  # weights of the calibrated logits, and an intercept

    def score(self, text_logit: np.ndarray, meta_logit: np.ndarray):
        logits = np.stack([text_logit, meta_logit], 1) * self.calibration[:, 0] + self.calibration[:, 1]
        return sigmoid(logits @ self.mix[:2] + self.mix[2]), sigmoid(logits[:, 0]), sigmoid(logits[:, 1])


def fit_views(text: Sparse, meta: Sparse, target: np.ndarray, taught=(None, None)) -> Model:
    """Both views fitted on labelled rows and what each was taught; every fifth row is kept for calibration."""
    place = np.arange(len(target))
    known = place % 5 > 0 if len(target) >= 50 else place >= 0
    apart = ~known if len(target) >= 50 else known
    weights = [fit(x.where(known), target[known].astype(float), np.ones(int(known.sum())), n, against=x is text, taught=lesson)
               for x, n, lesson in zip((text, meta), (1 << TEXT_BITS, 1 << META_BITS), taught)]
    logits = [x.times(w)[apart] for x, w in zip((text, meta), weights)]
    calibration = np.array([newton(z[:, None], target[apart]) for z in logits])
    both = np.stack(logits, 1) * calibration[:, 0] + calibration[:, 1]
    return Model(*weights, calibration, newton(both, target[apart]))


def lessons(text: Sparse, meta: Sparse, model: Model, confident: float) -> list:
    """For each view (slope, curve, n) summed over the ``n`` rows that the other view labels with confidence."""
    views, out = ((text, model.text), (meta, model.meta)), []
    logits = [x.times(w) for x, w in views]
    for k, (x, _) in enumerate(views):
        slope, base = model.calibration[1 - k]
        chance = sigmoid(slope * logits[1 - k] + base)
        sure = (np.maximum(chance, 1 - chance) >= confident).astype(float)
        p = sigmoid(logits[k])
        squares = np.bincount(x.feature, x.value * x.value * (sure * p * (1 - p))[x.row], x.width)
        out.append((x.back(sure * (p - (chance >= 0.5))), squares, float(sure.sum())))
    return out


def weighed(sums: list, model: Model, n_known: int, taught_share: float) -> list:
    """Lessons scaled to their mass: ``taught_share`` of the labelled rows, at most as many as there are."""
    out = []
    for (slope, curve, n), at in zip(sums, (model.text, model.meta)):
        mass = min(n, taught_share * n_known)
        scale = mass / n if n else 0.0
        out.append(Taught(slope * scale, curve * scale, at, mass))
    return out


def cotrain(text: Sparse, meta: Sparse, target: np.ndarray, rounds: int, confident: float, taught_share: float = 0.5) -> Model:
    """The rounds over rows in memory; ``target`` is 1, 0, or -1 where there is no label."""
    free = target < 0
    known = [x.where(~free) for x in (text, meta)]
    model = fit_views(*known, target[~free])
    for _ in range(rounds):
        sums = lessons(text.where(free), meta.where(free), model, confident)
        model = fit_views(*known, target[~free], weighed(sums, model, int((~free).sum()), taught_share))
    return model


def inputs(docs: DataFrame, text_column: str, categories, numbers) -> list:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    hashes = F.array(*[F.xxhash64(F.col(c).cast("string")) for c in categories]).cast("array<bigint>").alias("hashes")
    sizes = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in numbers]).cast("array<double>").alias("sizes")
    return [text, hashes, sizes]


def meta_arrays(batch, hashes: int, sizes: int):
    return [batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for k in (hashes, sizes)]


def sparse_views(batch, hashes: int, sizes: int, text: int):
    """(rows, text view, metadata view) of blocks of a batch."""
    data, offsets = text_buffers(batch.column(text))
    hashed, sized = meta_arrays(batch, hashes, sizes)
    for x, y in blocks(offsets, TEXT_BYTES):
        yield (x, y, Sparse(y - x, *text_features(data[offsets[x]:offsets[y]], offsets[x:y + 1] - offsets[x]), (1 << TEXT_BITS) + DENSE),
               Sparse(y - x, *meta_features(hashed[x:y], sized[x:y]), (1 << META_BITS) + 1))


def train(
    docs: DataFrame, labels: DataFrame, rounds: int = 2, confident: float = 0.97, max_labelled: int = 8000, taught_share: float = 0.5,
    id_column: str = "doc_id", text_column: str = "text", categories=("lang", "source"), numbers=("n_chars",),
):
    """A fitted model, or the share of good documents if labels are of one kind.

    All documents but the labelled sample are pseudo-labelled in every round.
    """
    good = ((F.min("quality") == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)).cast("int").alias("good")
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(good)
    ids = docs.select(F.col(id_column).alias("id")).where("id IS NOT NULL")
    sample = labels.join(ids.distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), F.col("id")).limit(max_labelled)
    sample = materialize(sample, "labelled")
    kinds = {r.good: r.n for r in sample.groupBy("good").agg(F.count("*").alias("n")).collect()}
    n_known = sum(kinds.values())
    if len(kinds) < 2:
        return kinds.get(1, 0) / n_known if n_known else 1.0
    rows = docs.select(F.col(id_column).alias("id"), *inputs(docs, text_column, categories, numbers))
    # the sample has max_labelled rows at most
    known = rows.join(F.broadcast(sample), "id")
    known = known.groupBy("id", "good").agg(F.min(F.struct("text", "hashes", "sizes")).alias("x")).select("id", "good", "x.*")
    others = rows.join(F.broadcast(sample.select("id")), "id", "left_anti").select("text", "hashes", "sizes")

    def extract(batches):
        for batch in batches:
            for x, y, text, meta in sparse_views(batch, 3, 4, 2):
                at, mat = (pa.array(np.searchsorted(v.row, np.arange(y - x + 1)).astype(np.int32)) for v in (text, meta))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(x, y - x), batch.column(1).slice(x, y - x), pa.ListArray.from_arrays(at, pa.array(text.feature.astype(np.int32))),
                    pa.ListArray.from_arrays(at, pa.array(text.value.astype(np.float32))), pa.ListArray.from_arrays(mat, pa.array(meta.feature.astype(np.int32)))],
                    ["id", "good", "f", "v", "m"])

    kind = rows.schema["id"].dataType.simpleString()
    known = known.select("id", "good", "text", "hashes", "sizes").mapInArrow(extract, f"id {kind}, good int, f array<int>, v array<float>, m array<int>")
    known = materialize(known, "labelled_features")

    def sparse(features, values, width):
        count = np.concatenate([np.diff(c.offsets.to_numpy()) for c in features])
        feature = np.concatenate([c.flatten().to_numpy() for c in features])
        value = np.concatenate([c.flatten().to_numpy() for c in values]) if values else np.ones(len(feature), np.float32)
        return Sparse(len(count), np.repeat(np.arange(len(count), dtype=np.int32), count), feature, value, width)

    def fitted(taught):
        def run(batches):
            held = list(batches)
            if held:
                target = np.concatenate([b.column(1).to_numpy() for b in held])
                text = sparse([b.column(2) for b in held], [b.column(3) for b in held], (1 << TEXT_BITS) + DENSE)
                meta = sparse([b.column(4) for b in held], None, (1 << META_BITS) + 1)
                del held[:]
                model = fit_views(text, meta, target, taught)
                parts = (model.text, model.meta, model.calibration.ravel(), model.mix)
                yield pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.float64())) for x in parts], ["text", "meta", "calibration", "mix"])

        # the labelled sample in one task, in the order of its ids
        one = known.repartition(1).sortWithinPartitions("id")
        found = one.mapInArrow(run, "text array<double>, meta array<double>, calibration array<double>, mix array<double>").first()
        text, meta, calibration, mix = (np.array(x) for x in found)
        return Model(text, meta, calibration.reshape(2, 2), mix)

    def taught_by(model):
        def run(batches):
            total = None
            for batch in batches:
                for _, _, text, meta in sparse_views(batch, 1, 2, 0):
                    own = lessons(text, meta, model, confident)
                    total = own if total is None else [tuple(a + b for a, b in zip(x, y)) for x, y in zip(total, own)]
            for k, (slope, curve, n) in enumerate(total or ()):
                at = np.flatnonzero(curve)
                # the number of rows goes with a feature that there is not
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at) + 1, k, np.int32)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(slope[at], n)),
                     pa.array(np.append(curve[at], 0.0))], ["view", "feature", "slope", "curve"])

        sums = others.mapInArrow(run, "view int, feature int, slope double, curve double").groupBy("view", "feature")
        # at most one row for each feature of a view
        sums = sums.agg(F.sum("slope").alias("slope"), F.sum("curve").alias("curve")).toArrow()
        view, feature, slope, curve = (sums.column(k).to_numpy() for k in range(4))
        out = []
        for k, weights in enumerate((model.text, model.meta)):
            own = (view == k) & (feature >= 0)
            parts = [np.zeros(len(weights)), np.zeros(len(weights))]
            for part, values in zip(parts, (slope, curve)):
                part[feature[own]] = values[own]
            out.append((*parts, float(slope[(view == k) & (feature < 0)].sum())))
        return out

    model = fitted((None, None))
    for _ in range(rounds):
        model = fitted(weighed(taught_by(model), model, n_known, taught_share))
    return model


def classify(docs: DataFrame, model, threshold: float = 0.5, text_column: str = "text", categories=("lang", "source"), numbers=("n_chars",)) -> DataFrame:
    """``docs`` with score, score_text, score_meta and kept."""
    results = ("score", "score_text", "score_meta", "kept")
    own = packed(docs, *[c for c in results if c != text_column])
    if not isinstance(model, Model):
        flat = [F.lit(model).alias(c) for c in results[:3]] + [F.lit(model >= threshold).alias("kept")]
        return docs.select(own).select("row.*", *flat)
    rows = docs.select(own, *inputs(docs, text_column, categories, numbers))

    def score(batches):
        for batch in batches:
            for x, y, text, meta in sparse_views(batch, 2, 3, 1):
                scores = model.score(text.times(model.text), meta.times(model.meta))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), *map(pa.array, scores), pa.array(scores[0] >= threshold)], ["row", *results])

    schema = T.StructType([rows.schema["row"], *[T.StructField(c, T.DoubleType()) for c in results[:3]], T.StructField("kept", T.BooleanType())])
    return rows.mapInArrow(score, schema).select("row.*", *results)
