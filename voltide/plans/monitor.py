"""Daily monitor: product series, ranked snapshot, notification and alerts."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voltide import constants as K, schemas
from voltide.functions.formats import percent_text, whole_text
from voltide.operators import aggregate, joins, ledger, series
from voltide.operators.contracts import quote_iv
from voltide.operators.maintain import among, append_day, freshness
from voltide.operators.tables import staged

SNAPSHOT = ["group_id", "hvm", "hv_min", "hv_max", "hvy", "iv", "iv_min", "iv_max", "hv_pct", "iv_pct", "hv_ratio"]
PERCENT_COLUMNS = ["hvm", "hv_min", "hv_max", "hvy", "iv", "iv_min", "iv_max", "hv_ratio"]


def product_series(index: DataFrame, siv: DataFrame = None) -> DataFrame:
    """Volatility columns of every product and day.

    The join key of the synthetic volatility is the grain of the index, so
    all windows that follow run on one shuffle of the (small) index table.
    """
    if siv is None:
        joined = index.withColumn("iv", F.lit(None).cast("double"))
    else:
        joined = joins.join_options(index, siv)
    return series.analyze_iv(series.analyze_hv(joined))


def rank_by_ratio(snapshot: DataFrame) -> DataFrame:
    """Rows with a volatility ratio, the highest ratio first."""
    return snapshot.where(F.col("hv_ratio").isNotNull()).orderBy(F.col("hv_ratio").desc(), "group_id")


def monitor_snapshot(products: DataFrame, anchor_group: str = K.CSI_GROUP, anchor: DataFrame = None) -> DataFrame:
    latest = series.latest_snapshot(products, anchor_group, anchor)
    return rank_by_ratio(latest.select("trade_date", *SNAPSHOT))


def union_all(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def notification_table(snapshot: DataFrame, names: DataFrame) -> DataFrame:
    """Report text per product; products without a display name are dropped.

    A product without a volatility percentile shows a dash in both
    percentile columns.
    """
    shown = snapshot.join(names, "group_id", "inner")
    ivp = F.when(F.col("hv_pct").isNotNull(), F.col("iv_pct"))
    return shown.select(
        "name",
        *[percent_text(F.col(c)).alias(c) for c in PERCENT_COLUMNS],
        whole_text(F.col("hv_pct")).alias("hv_pct"),
        whole_text(ivp).alias("iv_pct"),
    )


def alert_reason(pct: Column, iv: Column, top: Column, bottom: Column, hi: float, lo: float) -> Column:
    missing = pct.isNull() & iv.isNotNull()
    return (
        F.when(pct >= hi, "iv percentile high")
        .when(pct <= lo, "iv percentile low")
        .when(missing & (iv >= top * K.ALERT_NEAR_MAX), "iv near maximum")
        .when(missing & (iv <= bottom * K.ALERT_NEAR_MIN), "iv near minimum")
    )


def iv_alerts(snapshot: DataFrame, hi: float = K.ALERT_HIGH, lo: float = K.ALERT_LOW, on_display: bool = False) -> DataFrame:
    """Products whose synthetic volatility is extreme.

    Where the percentile is missing, closeness to the extremes decides. With
    ``on_display`` the input is a notification table, whose rounded texts are
    compared.
    """
    def number(name):
        return F.col(name).try_cast("double") if on_display else F.col(name)

    reason = alert_reason(*[number(c) for c in ("iv_pct", "iv", "iv_max", "iv_min")], hi, lo)
    return snapshot.withColumn("alert_reason", reason).where(F.col("alert_reason").isNotNull())


def alert_lines(alerts: DataFrame) -> DataFrame:
    """One message line per alert of a notification table."""
    return alerts.select(
        F.format_string("> %s: iv %s p %s  \n  ", F.col("name"), F.col("iv"), F.col("iv_pct")).alias("line")
    )


def markdown_rows(df: DataFrame) -> DataFrame:
    """Table text, one line per row of a report table."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def document_volatility(payloads: DataFrame, ingest, underlying: DataFrame, calendar: DataFrame, weight: str = "tr") -> tuple:
    """From option documents to (solved quotes, synthetic volatility) with one of the exchange readers."""
    quotes = quote_iv(ingest(payloads, underlying), calendar)
    return quotes, aggregate.siv(quotes, weight)


def recompute_history(options: DataFrame, calendar: DataFrame, weight: str = "tr") -> tuple:
    """Solve every stored option again: (option quotes, synthetic volatility).

    Solving is row by row and keeps the partitioning of the scan; the only
    shuffle is the one of the partial sums per day and product.
    """
    solved = quote_iv(options, calendar)
    return solved, aggregate.siv(solved, weight)


def recompute_stored(spark: SparkSession, quotes_path: str, siv_path: str, calendar: DataFrame, run: str, quotes_schema=None,
                     siv_schema=None, weight: str = "tr", date_col: str = "trade_date", parts_per_step: int = 250) -> tuple:
    """Solve every stored option again and overwrite quotes and synthetic volatilities; both as stored.

    The two tables change together. Step by step, some partitions at a time, the
    new quotes and volatilities are written beside the stored ones and marked;
    only when all partitions are there do they replace the stored ones, quotes
    first, and the run is marked as published. A run that was killed goes on
    under its name ``run``: marked partitions are not solved again, a half
    written step is, and a half replaced table is replaced from what was staged.
    Days that arrive meanwhile stay as they are.
    """
    quotes_schema, siv_schema = quotes_schema or schemas.SOLVED_QUOTES, siv_schema or schemas.PRODUCT_SIV
    staged_quotes, staged_siv = f"{quotes_path}/_staged/{run}", f"{siv_path}/_staged/{run}"
    states = ledger.states(spark, quotes_path, run)
    if ledger.PUBLISHED not in states:
        if ledger.STAGED not in states:
            _stage_steps(spark, quotes_path, staged_quotes, staged_siv, calendar, run, quotes_schema, siv_schema, weight, date_col, parts_per_step)
        quotes, siv = spark.read.schema(quotes_schema).parquet(staged_quotes), spark.read.schema(siv_schema).parquet(staged_siv)
        append_day(quotes, quotes_path, date_col, rebalance=False)
        append_day(siv, siv_path, date_col, rebalance=False)
        ledger.mark(quotes, quotes_path, run, ledger.PUBLISHED, date_col)
        for frame, path in ((quotes, staged_quotes), (siv, staged_siv)):  # the staged rows go
            frame.where(F.lit(False)).write.mode("overwrite").parquet(path)
    return spark.read.schema(quotes_schema).parquet(quotes_path), spark.read.schema(siv_schema).parquet(siv_path)


def _stage_steps(spark, quotes_path, staged_quotes, staged_siv, calendar, run, quotes_schema, siv_schema, weight, date_col, parts_per_step):
    stored = spark.read.schema(quotes_schema).parquet(quotes_path)
    # partition values: one for each stored day
    parts = {r[0] for r in stored.select(date_col).distinct().collect()}
    done = ledger.entries(spark, quotes_path).where((F.col("batch") == f"{run}/step") & (F.col("n_rows") > 0))
    done = {r[0] for r in done.select(F.col("part").cast(stored.schema[date_col].dataType)).distinct().collect()}
    todo = sorted(parts - done, key=lambda part: (part is None, part))
    group = [date_col] if date_col not in aggregate.SERIES_KEYS else []
    for first in range(0, len(todo), parts_per_step):
        here = among(F.col(date_col), todo[first:first + parts_per_step])
        append_day(quote_iv(stored.where(here), calendar).select(*quotes_schema.fieldNames()), staged_quotes, date_col)
        solved = spark.read.schema(quotes_schema).parquet(staged_quotes).where(here)
        siv = aggregate.siv(solved, weight, more_keys=group).select(*siv_schema.fieldNames())
        append_day(siv, staged_siv, date_col)
        ledger.mark(solved, quotes_path, f"{run}/step", ledger.STAGED, date_col)
    ledger.mark(spark.read.schema(quotes_schema).parquet(staged_quotes), quotes_path, run, ledger.STAGED, date_col)


def table_dates(**tables: DataFrame) -> DataFrame:
    """(kind, exchange, trade_date) of several aggregated tables, for the freshness gate."""
    return union_all(*[t.select(F.lit(kind).alias("kind"), "exchange", "trade_date").distinct() for kind, t in tables.items()])


def run_monitor(futures: DataFrame, options: DataFrame, index_series: DataFrame = None, calendar: DataFrame = None,
                as_of: str = None, anchor_group: str = K.CSI_GROUP, recompute: bool = False, on_stale: str = "empty") -> DataFrame:
    """The daily run: index, volatility, synthetic volatility, ranked snapshot.

    Quotes are read once: the index and the synthetic volatility, one row per
    product and day, are stored, and the series, the anchor's last day and the
    freshness gate read these. With ``as_of`` every exchange must be up to date
    in every table, futures and options alike; otherwise the result is empty, or
    with ``on_stale='raise'`` the run stops and names what is late.
    """
    if on_stale not in ("empty", "raise"):
        raise ValueError(f"unknown on_stale {on_stale!r}")
    index = aggregate.futures_index(futures)
    if index_series is not None:
        index = index.unionByName(index_series.select(*index.columns))
    if recompute:
        _, siv = recompute_history(options, calendar)
    else:
        siv = aggregate.siv(options)
    index, siv = staged(index, "index"), staged(siv, "siv")
    snapshot = monitor_snapshot(product_series(index, siv), anchor_group, index)
    if as_of is None:
        return snapshot
    gate = freshness(table_dates(futures=index, options=siv), as_of, keys=("kind", "exchange"))
    if on_stale == "raise":
        late = gate.where("NOT is_fresh").orderBy("kind", "exchange").collect()  # one row for each exchange
        if late:
            raise ValueError("stale: " + ", ".join(f"{r.kind} of {r.exchange} end on {r.last_date}" for r in late))
        return snapshot
    return snapshot.where(F.coalesce(gate.agg(F.bool_and("is_fresh")).scalar(), F.lit(False)))
