"""Operators over daily series.

A series holds one row per trading day of one product (quotes are aggregated
to that grain first), so a window partition is bounded by the calendar and not
by the number of quotes. All operators use the same window specification;
chained, they run on one shuffle and one sort.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltide import constants as K

KEYS = ("exchange", "group_id")


def series_window(keys=KEYS, order: str = "trade_date"):
    return Window.partitionBy(*keys).orderBy(order)


def trailing(n: int, keys=KEYS, order: str = "trade_date"):
    return series_window(keys, order).rowsBetween(1 - n, 0)


def log_return(df: DataFrame, close: str = "close", out: str = "log_return", keys=KEYS) -> DataFrame:
    previous = F.lag(close).over(series_window(keys))
    return df.withColumn(out, F.ln(F.col(close) / F.nullif(previous, F.lit(0.0))))


def hist_vol(df: DataFrame, n: int, close: str = "close", out: str = None, annual: int = K.ANNUAL_ROWS,
             keys=KEYS) -> DataFrame:
    """Yearly volatility from the last ``n`` daily log returns."""
    out = out or f"hv{n}"
    returns = log_return(df, close, "_r", keys)
    frame = trailing(n, keys)
    spread = F.when(F.count("_r").over(frame) == n, F.var_samp("_r").over(frame))
    return returns.withColumn(out, F.sqrt(F.lit(float(annual)) * spread)).drop("_r")


def hv_columns(df: DataFrame, close: str = "close", keys=KEYS) -> DataFrame:
    """Short and long volatility and their ratio, from one pass of returns."""
    returns = log_return(df, close, "_r", keys)

    def vol(n):
        frame = trailing(n, keys)
        return F.sqrt(F.lit(float(K.ANNUAL_ROWS)) * F.when(F.count("_r").over(frame) == n, F.var_samp("_r").over(frame)))

    return (
        returns.withColumns({"hvm": vol(K.HV_SHORT), "hvy": vol(K.HV_LONG)})
        .drop("_r")
        .withColumn("hv_ratio", F.col("hvm") / F.nullif(F.col("hvy"), F.lit(0.0)))
    )


def comparable(x: Column) -> Column:
    """Value on a 1e-10 grid, so float noise cannot break ties in rankings."""
    return F.rint(x * F.lit(1e10)) / F.lit(1e10)


def percent_of_rank(below: Column, n: int = K.ANNUAL_ROWS) -> Column:
    """Percentile 0..99 of a value that has ``below`` smaller ones among ``n``.

    The 99 thresholds sit at sorted positions i * q + min(i, m) for i = 1..99,
    with q = n div 100 and m = n mod 100. The percentile is the number of
    thresholds below the value, i.e. of positions less than ``below``.
    """
    q, m = divmod(n, 100)
    if q == 0:
        raise ValueError("the window needs at least 100 rows")
    last = below - 1
    split = m * (q + 1)
    low = F.floor(last / (q + 1))
    high = m + F.floor((last - split) / q)
    return (
        F.when(below <= 0, F.lit(0)).when(last <= split, low).otherwise(F.least(high, F.lit(99)))
    ).cast("int")


def threshold_positions(n: int = K.ANNUAL_ROWS) -> list:
    q, m = divmod(n, 100)
    return [i * q + min(i, m) for i in range(1, 100)]


def rolling_percentile(df: DataFrame, column: str, out: str = "percentile", n: int = K.ANNUAL_ROWS,
                       keys=KEYS) -> DataFrame:
    """Percentile of each value within the last ``n`` rows of its series.

    NULL until ``n`` values are present. The frame holds ``n`` numbers, and the
    list is used up in the same projection.
    """
    frame = trailing(n, keys)
    value = comparable(F.col(column))
    below = F.size(F.filter(F.col("_window"), lambda y: y < F.col("_value")))
    return (
        df.withColumn("_value", value)
        .withColumn("_window", F.collect_list("_value").over(frame))
        .withColumn(out, F.when(F.size("_window") == n, percent_of_rank(below, n)))
        .drop("_value", "_window")
    )


def _largest(df: DataFrame, column: str, n: int, keys) -> DataFrame:
    """Per series: how many values there are, and the largest ``n``, sorted.

    The rank filter is applied before the shuffle too, so at most ``n`` values
    per series and task travel, and the collected list has at most ``n``.
    """
    ranked = df.where(F.col(column).isNotNull()).select(*keys, comparable(F.col(column)).alias("_value"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_value").desc()))
    return (
        ranked.withColumn("_rank", rank)
        .where(F.col("_rank") <= n)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("_value")).alias("_values"))
    )


def percentile_thresholds(df: DataFrame, column: str, n: int = K.ANNUAL_ROWS, keys=KEYS) -> DataFrame:
    """The 99 threshold values per series, from its largest ``n`` values.

    A series with fewer than ``n`` values gets an empty list.
    """
    positions = F.array(*[F.lit(p) for p in threshold_positions(n)])
    picked = F.transform(positions, lambda p: F.get(F.col("_values"), p))
    empty = F.array().cast("array<double>")
    return _largest(df, column, n, keys).select(
        *keys, F.when(F.size("_values") >= n, picked).otherwise(empty).alias("thresholds")
    )


def percentile_of(series: DataFrame, column: str, values: DataFrame, value_col: str, out: str = "percentile",
                  n: int = K.ANNUAL_ROWS, keys=KEYS) -> DataFrame:
    """Percentile of outside values within the history of their series.

    50 where the series has fewer than ``n`` values.
    """
    history = _largest(series, column, n, keys)
    joined = values.join(history, list(keys), "left")
    probe = comparable(F.col(value_col))
    below = F.size(F.filter(F.col("_values"), lambda y: y < probe))
    enough = F.coalesce(F.size("_values") >= n, F.lit(False))
    return joined.withColumn(
        out, F.when(enough, percent_of_rank(below, n)).otherwise(F.lit(K.PERCENTILE_DEFAULT))
    ).drop("_values")


def expanding_extremes(df: DataFrame, column: str, max_as: str, min_as: str, keys=KEYS) -> DataFrame:
    """Highest and lowest value so far; NULL before the first value."""
    frame = series_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({max_as: F.max(column).over(frame), min_as: F.min(column).over(frame)})


def moving_averages(df: DataFrame, windows=(5, 10, 20), column: str = "close", keys=KEYS) -> DataFrame:
    def mean(n):
        frame = trailing(n, keys)
        return F.when(F.count(column).over(frame) == n, F.avg(column).over(frame))

    return df.withColumns({f"ma{n}": mean(n) for n in windows})


def tail(df: DataFrame, n: int = 5, keys=KEYS, order: str = "trade_date") -> DataFrame:
    """The last ``n`` rows of each series."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def percent_window(df: DataFrame, column: str = "close", n: int = 5, keys=KEYS) -> DataFrame:
    """Last ``n`` rows of each series with percentile and lifetime extremes."""
    marked = expanding_extremes(rolling_percentile(df, column, "per", keys=keys), column, "max", "min", keys)
    return tail(marked, n, keys)


def latest_snapshot(df: DataFrame, anchor_group: str, anchor: DataFrame = None) -> DataFrame:
    """Rows of the day on which the anchor product was last quoted.

    ``anchor`` may be any cheaper table with the same dates (for instance the
    raw quotes); only its largest date is read.
    """
    source = df if anchor is None else anchor
    last = source.where(F.col("group_id") == anchor_group).agg(F.max("trade_date"))
    return df.where(F.col("trade_date") == last.scalar())


def analyze_hv(index: DataFrame, keys=KEYS) -> DataFrame:
    """All volatility columns of the product series."""
    out = hv_columns(index, keys=keys)
    out = rolling_percentile(out, "hvm", "hv_pct", keys=keys)
    return expanding_extremes(out, "hvm", "hv_max", "hv_min", keys)


def analyze_iv(series: DataFrame, keys=KEYS) -> DataFrame:
    """Percentile and extremes of a joined synthetic volatility column."""
    out = rolling_percentile(series, "iv", "iv_pct", keys=keys)
    return expanding_extremes(out, "iv", "iv_max", "iv_min", keys)

