"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Every text gets counts of words, symbols, repeated lines and repeated windows.
Two fixed rules fail a text outright. The others are judged together: their
transformed statistics are a vector, and per language and source a minimum
covariance determinant estimate describes the vectors that agree best. A text
whose Mahalanobis distance from it is beyond a far quantile is rejected.

The estimate starts from medians and quartiles and takes concentration steps:
distances to the current estimate, the half-sample (by default three quarters)
with the smallest ones, and its mean and covariance as the next estimate. A
step is one aggregate: sums per group and distance class, partial in each task,
then a running count over the classes of a group. No rows of a group ever meet.

Defined results: null text has no words; null language or source is a value;
groups of fewer than ``min_rows`` judged texts are estimated together; repeated
rows count as often as they are there; an empty table gives no rows; a column
of the input that has the name of a result column is replaced by it.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltide.llm.common import materialize, packed

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# the least standard deviation of each statistic: below it a difference is no oddity
FLOORS = (0.25, 0.05, 0.25, 0.25)


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def shifted(values: Column, by: int, merge) -> Column:
    """merge(x[i], x[i + by]) for all i that have both."""
    n = F.greatest(F.size(values) - by, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(by + 1), n), merge)


def text_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Add the counts of ``COUNTS`` and ``n_upper`` (capital letters and exclamation marks)."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    out = docs.withColumn("_text", text).withColumn("_words", F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(without(x, WHITE)) > 0)
    out = out.withColumns({"_lines": lines, "_w1": F.transform("_words", lambda w: F.xxhash64(w))})
    # hashes of windows by doubling: of two, four and eight words
    for width in (1, 2, 4):
        out = out.withColumn(f"_w{2 * width}", shifted(F.col(f"_w{width}"), width, lambda x, y: F.xxhash64(x, y)))
    again = F.size(F.array_distinct("_w8")) < F.size("_w8")
    ordered = F.array_sort(F.transform("_w8", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    out = out.withColumn("_ordered", F.when(again, ordered))
    places = F.flatten(shifted(F.col("_ordered"), 1, lambda x, y: F.when(x["h"] == y["h"], F.array(x["at"], y["at"])).otherwise(
        F.array().cast("array<int>"))))
    out = out.withColumn("_places", F.array_sort(F.array_distinct(places)))
    covered = F.aggregate(shifted(F.col("_places"), 1, lambda x, y: F.least(F.lit(WINDOW), y - x)), F.lit(WINDOW), lambda s, x: s + x)
    out = out.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(without(F.col("_text"), WHITE)).cast("bigint"),
        "n_symbols": (F.length("_text") - F.length(without(F.col("_text"), SYMBOLS))).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
        "n_upper": F.length(F.regexp_replace("_text", r"[^\p{Lu}!]+", "")).cast("bigint"),
    })
    return out.drop("_text", "_words", "_lines", "_w1", "_w2", "_w4", "_w8", "_ordered", "_places")


def vector() -> list[Column]:
    """Transformed statistics; short texts are drawn towards the usual by 100 characters or words."""
    share = lambda c: F.log1p(100.0 * F.col(c) / (F.col("word_chars") + 100.0))
    return [F.log1p(F.col("n_words").cast("double")), F.log((F.col("word_chars") + 500.0) / (F.col("n_words") + 100.0)),
            share("n_symbols"), share("n_upper")]


def chi2_cdf(x: float, degrees: int) -> float:
    """For an even number of degrees."""
    term, total = 1.0, 1.0
    for k in range(1, degrees // 2):
        term *= x / 2 / k
        total += term
    return 1.0 - math.exp(-x / 2) * total


def chi2_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, degrees) < p else (low, middle)
    return high


def running(frame: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Counts up to and including each class, and of all classes, per key."""
    upto = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frame.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))


def start(rows: DataFrame, d: int, floors) -> DataFrame:
    """Medians and quartile spreads per group as a first estimate (m0.., c00..)."""
    each = rows.select("_g", F.posexplode(F.array(*[f"z{i}" for i in range(d)])).alias("j", "z"))
    classes = each.groupBy("_g", "j", F.round(F.col("z") * 64).alias("k")).agg(F.count("*").alias("_n"))
    classes = running(classes, ["_g", "j"], "k")
    at = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("_all"), F.col("k"))) / 64.0
    spread = classes.groupBy("_g", "j").agg(at(0.5).alias("m"), ((at(0.75) - at(0.25)) / 1.349).alias("s"))
    pick = lambda c, i: F.max(F.when(F.col("j") == i, F.col(c)))
    columns = [pick("m", i).alias(f"m{i}") for i in range(d)]
    columns += [(pick("s", i) ** 2 + floors[i] ** 2).alias(f"c{i}{i}") for i in range(d)]
    zero = [F.lit(0.0).alias(f"c{i}{j}") for i in range(d) for j in range(i)]
    return spread.groupBy("_g").agg(*columns).select("*", *zero)


def factored(estimate: DataFrame, d: int) -> DataFrame:
    """Replace the covariance by its lower Cholesky factor (l00, l10, ...)."""
    for i in range(d):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            estimate = estimate.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return estimate.select("_g", *[f"m{i}" for i in range(d)], *[f"l{i}{j}" for i in range(d) for j in range(i + 1)])


def distances(rows: DataFrame, estimate: DataFrame, d: int) -> DataFrame:
    """Add ``_d2``, the squared Mahalanobis distance to the estimate of the row's group."""
    out = rows.join(factored(estimate, d), "_g", "left")
    for i in range(d):
        rest = F.col(f"z{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"_y{k}")
        out = out.withColumn(f"_y{i}", rest / F.col(f"l{i}{i}"))
    total = sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(1, d)), F.col("_y0") * F.col("_y0"))
    names = [f"_y{i}" for i in range(d)] + [f"m{i}" for i in range(d)] + [f"l{i}{j}" for i in range(d) for j in range(i + 1)]
    return out.withColumn("_d2", total).drop(*names)


def concentrated(rows: DataFrame, estimate: DataFrame, d: int, share: float, floors) -> DataFrame:
    """One concentration step: mean and covariance of the ``share`` of rows nearest to the estimate."""
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    near = distances(rows, estimate, d).withColumn("_k", F.round(F.log(F.col("_d2") + 1e-9) * 32))
    sums = [F.sum(f"z{i}").alias(f"s{i}") for i in range(d)] + [F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}{j}") for i, j in pairs]
    classes = running(near.groupBy("_g", "_k").agg(F.count("*").alias("_n"), *sums), ["_g"], "_k")
    inside = classes.where(F.col("_upto") - F.col("_n") < share * F.col("_all"))
    total = inside.groupBy("_g").agg(F.sum("_n").alias("_n"), *[F.sum(c).alias(c) for c in classes.columns if c[0] in "sq"])
    total = total.select("_g", "_n", *[(F.col(f"s{i}") / F.col("_n")).alias(f"m{i}") for i in range(d)], *[f"q{i}{j}" for i, j in pairs])
    cover = lambda i, j: F.col(f"q{i}{j}") / F.col("_n") - F.col(f"m{i}") * F.col(f"m{j}")
    return total.select("_g", *[f"m{i}" for i in range(d)], *[
        (F.greatest(cover(i, i), F.lit(0.0)) + floors[i] ** 2 if i == j else cover(i, j)).alias(f"c{i}{j}") for i, j in pairs])


def outlier_distances(
    rows: DataFrame, group: Column, columns: list[Column], judged: Column, floors=FLOORS, share: float = 0.75, steps: int = 4, min_rows: int = 50,
) -> DataFrame:
    """Add ``distance2``: squared robust distance of each judged row within its group, null for other rows.

    ``rows`` is read several times and should be stored. ``columns`` must be an
    even number of statistics.
    """
    d = len(columns)
    keyed = rows.withColumns({"_key": group, "_judged": judged, **{f"z{i}": c for i, c in enumerate(columns)}})
    sizes = keyed.where("_judged").groupBy("_key").agg(F.count("*").alias("_rows"))
    keyed = keyed.join(sizes, "_key", "left").withColumn("_g", F.when(F.col("_rows") >= min_rows, F.col("_key")).otherwise("")).drop("_key", "_rows")
    core = keyed.where("_judged").select("_g", *[f"z{i}" for i in range(d)])
    estimate = start(core, d, floors)
    for _ in range(steps):
        estimate = concentrated(core, estimate, d, share, floors)
    # the nearest part of normal vectors is too narrow by this factor
    widen = share / chi2_cdf(chi2_quantile(share, d), d + 2) if share < 1 else 1.0
    out = distances(keyed, estimate, d)
    return out.withColumn("distance2", F.when(F.col("_judged"), F.col("_d2") / widen)).drop("_d2", "_g", "_judged", *[f"z{i}" for i in range(d)])


def judge(
    docs: DataFrame, text_column: str = "text", groups: tuple[str, ...] = ("lang", "source"), tail: float = 1e-9, min_rows: int = 50, steps: int = 4,
) -> DataFrame:
    """The columns of ``docs`` but the text, with the counts, base_failed, distance2 and kept."""
    results = (*COUNTS, "n_upper", "base_failed", "distance2", "kept")
    group = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(groups)]))
    rows = docs.select(packed(docs, text_column, *results), group.alias("group"), F.col(text_column).alias("text"))
    counted = materialize(text_counts(rows).drop("text"), "counts")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed)
    out = outlier_distances(counted, F.col("group"), vector(), ~F.col("base_failed"), min_rows=min_rows, steps=steps)
    cut = chi2_quantile(1.0 - tail, len(vector()))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("distance2") <= cut))
    return out.select("row.*", *results)
