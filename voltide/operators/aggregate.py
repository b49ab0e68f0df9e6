"""Product index, total rows and synthetic implied volatility."""

from pyspark.sql import DataFrame, functions as F

from voltide import constants as K
from voltide.functions.numeric import half_even
from voltide.operators.tables import pick_by

SERIES_KEYS = ["trade_date", "exchange", "group_id"]
WEIGHTS = ("volume", "turnover", "rdays", "tr")


def is_total():
    return F.col("product_id") == K.TOTAL_KEY


def futures_index(quotes: DataFrame, scale: int = 3) -> DataFrame:
    """Open-interest weighted mean close per day and product.

    Two sums per group: partial sums are built before the shuffle, so the
    shuffle carries one row per task, day and product however many contracts
    or copies a product has.
    """
    oi = F.col("open_interest")
    mean = F.sum(F.col("close") * oi) / F.nullif(F.sum(oi), F.lit(0))
    return quotes.where(~is_total()).groupBy(*SERIES_KEYS).agg(half_even(mean, scale).alias("close"))


def with_total_rows(quotes: DataFrame, order: list) -> DataFrame:
    """Append one total row per day and product: a copy of its first row."""
    first = pick_by(quotes, SERIES_KEYS, order, last=False)
    return quotes.unionByName(first.withColumn("product_id", F.lit(K.TOTAL_KEY)))


def put_on_totals(quotes: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Write a per-product value into the total rows; contracts stay as they are.

    Only the total rows (one per day and product) are joined.
    """
    totals = quotes.where(is_total()).drop(column).join(values.select(*SERIES_KEYS, column), SERIES_KEYS, "left")
    return quotes.where(~is_total()).unionByName(totals.select(*quotes.columns))


def index_on_totals(quotes: DataFrame, scale: int = 3) -> DataFrame:
    return put_on_totals(quotes, futures_index(quotes, scale), "close")


def siv(options: DataFrame, weight: str = "tr", max_bias: float = K.MAX_STRIKE_BIAS, scale: int = 3, more_keys=()) -> DataFrame:
    """Synthetic implied volatility per day and product.

    ``more_keys`` are columns that depend on these, such as a day's month, and
    stay in the result.

    A weighted mean of the contracts' volatilities. The weight falls with the
    square of the distance between strike and underlying price, and is 0 when
    that distance exceeds ``max_bias``. A product without a usable contract
    gets NULL.
    """
    if weight not in WEIGHTS:
        raise ValueError(f"weight must be one of {WEIGHTS}")
    bias = F.abs(F.col("strike") - F.col("u_price")) / F.nullif(F.col("u_price"), F.lit(0.0))
    near = F.when(bias > max_bias, F.lit(0.0)).otherwise(
        ((bias - max_bias) / max_bias) * ((bias - max_bias) / max_bias)
    )
    turnover = F.col("close") * F.col("volume")
    size = {
        "volume": F.col("volume").cast("double"),
        "turnover": turnover,
        "rdays": F.col("rdays").cast("double"),
        "tr": turnover * F.least(F.col("rdays"), F.lit(K.RDAYS_CAP)),
    }[weight]
    usable = F.col("iv") > K.MIN_SIV_IV
    part = F.when(usable, near * size)
    # a contract without a weight must leave both sums alone
    top = F.sum(part * F.col("iv"))
    bottom = F.nullif(F.sum(part), F.lit(0.0))
    return (
        options.where(~is_total())
        .groupBy(*SERIES_KEYS, *more_keys)
        .agg(half_even(top / bottom, scale).alias("iv"))
    )


def siv_on_totals(options: DataFrame, weight: str = "tr") -> DataFrame:
    return put_on_totals(options, siv(options, weight), "iv")


def last_date(df: DataFrame, date_col: str = "trade_date") -> DataFrame:
    return df.agg(F.max(date_col).alias(date_col))


def series_extremes(df: DataFrame, column: str, keys=("exchange", "group_id")) -> DataFrame:
    """Highest and lowest value over the whole history of each series."""
    return df.groupBy(*keys).agg(F.max(column).alias(f"{column}_max"), F.min(column).alias(f"{column}_min"))
