"""SimHash fingerprints of whole texts, in DataFrame operations only.

The terms of a text are its runs of five words (a shorter text is one term). A
term's 64-bit hash votes on every bit with a weight that is the number of times
the term occurs; a bit is one where the ones are more than half. Votes are
counted two to a number, 32 numbers a text, as plain sums in generated code, so
no array of votes is ever built and a text of any length is a partial
aggregate.

``within_radius`` finds all fingerprints within a Hamming radius: the bits are
cut into blocks, and of two fingerprints that differ in at most ``radius`` bits
all but ``radius`` blocks agree. For every choice of the blocks that agree there
is a table keyed by their bits; a query meets the fingerprints under its key and
counts their differing bits. Equal fingerprints are one entry with a count, and
a pair is reported by the first table that holds it.

Defined results: null text is empty, a text without words has fingerprint zero;
documents follow each other by descending id, null ids last, rows of one id by
their texts; the last one is followed by the first, a single one by itself;
repeated rows count as often as they are there; an empty table gives no rows.
"""

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltide.llm.common import materialize

SHINGLE = 5
BITS = 64
LANE = 0x0000000100000001
SPACE = r"[\x20\x09-\x0D]+"
# text of one range of ids: what a task sorts at a time, and the most ranges there are
RANGE_BYTES, MOST_RANGES = 8 << 20, 1 << 16


def shifted(values: Column, other: Column, by: int, merge) -> Column:
    """merge(x[i], y[i + by]) for all i that have both."""
    n = F.greatest(F.size(other) - by, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(other, F.lit(by + 1), n), merge)


def with_terms(frame: DataFrame, text: str) -> DataFrame:
    """Add ``_terms``: hashes of all runs of five words of a text column."""
    both = lambda x, y: F.xxhash64(x, y)
    out = frame.withColumn("_words", F.array_remove(F.split(text, SPACE), ""))
    out = out.withColumn("_w1", F.transform("_words", lambda w: F.xxhash64(w)))
    out = out.withColumn("_w2", shifted(F.col("_w1"), F.col("_w1"), 1, both))
    out = out.withColumn("_w4", shifted(F.col("_w2"), F.col("_w2"), 2, both))
    runs = shifted(F.col("_w4"), F.col("_w1"), 4, both)
    few = F.when(F.size("_words") > 0, F.array(F.xxhash64("_words"))).otherwise(F.array().cast("array<bigint>"))
    return out.withColumn("_terms", F.when(F.size("_words") >= SHINGLE, runs).otherwise(few)).drop("_words", "_w1", "_w2", "_w4")


def voted(terms: DataFrame, keys: list[str]) -> DataFrame:
    """Fingerprints of the rows of one key: ``term`` votes (null: no vote)."""
    sums = [F.sum(F.shiftrightunsigned("term", k).bitwiseAND(F.lit(LANE))).alias(f"_v{k}") for k in range(BITS // 2)]
    counted = terms.groupBy(*keys).agg(F.count("term").alias("_n"), *sums)
    bits = []
    for k in range(BITS // 2):
        low, high = F.col(f"_v{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_v{k}", 32)
        for place, ones in ((k, low), (k + 32, high)):
            one = (1 << place) - (1 << 64 if place == 63 else 0)
            bits.append(F.when(2 * ones > F.col("_n"), F.lit(one).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    while len(bits) > 1:
        bits = [bits[i].bitwiseOR(bits[i + 1]) for i in range(0, len(bits), 2)]
    return counted.select(*keys, bits[0].alias("fp"))


def fingerprint(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The columns of ``docs`` and ``fp``, the text's fingerprint as a 64-bit number, without a shuffle of texts.

    Rows are told apart by a number given to them; ``docs`` should be a stored table.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "fp"]).alias("row"),
                       F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_text"))
    rows = with_terms(rows.withColumn("_key", F.monotonically_increasing_id()), "_text")
    found = voted(rows.select("_key", F.explode_outer("_terms").alias("term")), ["_key"])
    return rows.select("_key", "row").join(found, "_key").select("row.*", "fp")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def as_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")


def numbers(values: list, kind: str = "bigint") -> Column:
    """A constant array in one literal, however long."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def range_of(value: Column, bounds: list) -> Column:
    """How many of the ascending bounds are at most ``value``: a binary search; null is below all."""
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    known = numbers(bounds)
    reach = lambda at, step: (at + step <= len(bounds)) & (F.get(known, at + step - 1) <= value)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.coalesce(reach(at, step), F.lit(False)), at + step).otherwise(at))


def next_texts(rows: DataFrame, range_bytes: int) -> DataFrame:
    """(range, n, own, id, text, next_text) of rows (id, text), each with the text that follows by descending id.

    Texts move once, in ranges of ids that hold about ``range_bytes`` of text. The
    first row of a range also goes to the end of the range before it, where only
    its text is wanted (not ``own``).
    """
    size, low = rows.agg(F.sum(F.octet_length("text")), F.min("id")).first()
    n_ranges = min(MOST_RANGES, max(1, -(-(size or 0) // range_bytes)))
    bounds = []
    if n_ranges > 1 and low is not None:
        shares = [k / n_ranges for k in range(1, n_ranges)]
        found = rows.agg(F.percentile_approx("id", numbers(shares, "double"), F.lit(max(10_000, 10 * n_ranges)))).first()[0]
        bounds = sorted({int(x) for x in found} - {low})
    ranged = rows.withColumn("range", range_of(F.col("id"), bounds))
    # one row for each range: its highest id, and the range that its first row follows
    heads = ranged.groupBy("range").agg(F.max("id").alias("id")).orderBy(F.desc("range")).collect()
    highest, before = [None] * (len(bounds) + 1), [None] * (len(bounds) + 1)
    for k, head in enumerate(heads):
        highest[head.range], before[head.range] = head.id, heads[k - 1].range
    here = F.struct(F.col("range"), F.lit(True).alias("own"))
    there = F.struct(F.get(numbers(before, "int"), F.col("range")).alias("range"), F.lit(False).alias("own"))
    places = F.when(F.col("id").eqNullSafe(F.get(numbers(highest), F.col("range"))), F.array(here, there)).otherwise(F.array(here))
    dealt = ranged.select(F.explode(places).alias("p"), "id", "text").select("p.range", "p.own", "id", "text")
    order = Window.partitionBy("range").orderBy(F.desc("own"), F.col("id").desc_nulls_last(), "text")
    return dealt.select("range", F.row_number().over(order).alias("n"), "own", "id", "text", F.lead("text").over(order).alias("next_text"))


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the text that follows it.

    (id, n_chars, edited_sha256, fp, edited_fp, next_fp). The edited text has its
    last third replaced by as much of the beginning of the following text, by
    descending id. Everything behind the one shuffle of texts runs in its ranges.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = next_texts(rows, range_bytes).withColumn("n_chars", F.char_length("text").cast("bigint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", F.when(F.col("own"), edited)).drop("next_text")
    rows = rows.withColumn("digest", F.unhex(F.sha2("edited", 256)))
    plain, changed = (F.struct(F.lit(k).alias("which"), F.col(c).alias("text")) for k, c in enumerate(("text", "edited")))
    keys = ["range", "n", "own", "id", "n_chars", "digest"]
    both = rows.select(*keys, F.explode(F.when(F.col("own"), F.array(plain, changed)).otherwise(F.array(plain))).alias("t"))
    terms = with_terms(both.select(*keys, "t.which", "t.text"), "text").select(*keys, "which", F.explode_outer("_terms").alias("term"))
    found = voted(terms, [*keys, "which"])
    pick = lambda k: F.max(F.when(F.col("which") == k, F.col("fp")))
    found = found.groupBy(*keys).agg(pick(0).alias("fp"), pick(1).alias("edited_fp"))
    following = F.lead("fp").over(Window.partitionBy("range").orderBy("n"))
    found = found.withColumn("next_fp", following).where("own")
    return found.select("id", "n_chars", F.lower(F.hex("digest")).alias("edited_sha256"), "fp", "edited_fp", "next_fp")


def within_radius(queries: DataFrame, entries: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(query_fp, fp, distance, copies): all fingerprints of ``entries`` within ``radius`` bits of each query's.

    Both sides have a column ``fp``; equal ones count as one, ``copies`` is how
    many entries share it. More blocks than radius are needed; the more, the
    longer the keys and the more tables.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("needs more blocks than differing bits")
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    block = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(block[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    key = lambda fp: F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col(fp).bitwiseAND(F.lit(m).cast("bigint")).alias("key")) for t, m in enumerate(masks)]))
    asked = queries.select(F.col("fp").alias("query_fp")).where("query_fp IS NOT NULL").distinct()
    held = entries.where("fp IS NOT NULL").groupBy("fp").agg(F.count("*").alias("copies"))
    asked = asked.select("query_fp", key("query_fp").alias("k")).select("query_fp", "k.t", "k.key")
    held = held.select("fp", "copies", key("fp").alias("k")).select("fp", "copies", "k.t", "k.key")
    off = F.col("fp").bitwiseXOR(F.col("query_fp"))
    # a pair counts in the first table in which it meets
    first = F.coalesce(*[F.when(off.bitwiseAND(F.lit(m).cast("bigint")) == 0, F.lit(t)) for t, m in enumerate(masks)])
    met = asked.join(held, ["t", "key"]).where((F.bit_count(off) <= radius) & (first == F.col("t")))
    return met.select("query_fp", "fp", F.bit_count(off).alias("distance"), "copies")


def simhash_documents(docs: DataFrame, is_query: Column, radius: int = 3, blocks: int = 5, id_column: str = "doc_id",
                      text_column: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints, likeness to the edited and to the following text, and close fingerprints of every document.

    ``is_query`` is an expression of the column ``id``; where it holds,
    ``n_within`` is the number of other documents whose fingerprint is within
    ``radius`` bits, elsewhere it is null.
    """
    found = edited_fingerprints(docs, id_column, text_column, range_bytes)
    found = materialize(found.withColumn("asked", F.coalesce(is_query, F.lit(False))), "fingerprints")
    near = within_radius(found.where("asked"), found, radius, blocks).groupBy("query_fp").agg((F.sum("copies") - 1).alias("n_within"))
    near = near.select(F.col("query_fp").alias("fp"), F.lit(True).alias("asked"), "n_within")
    return found.join(near, ["fp", "asked"], "left").select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_within")
