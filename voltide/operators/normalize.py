"""Clean parsed quote rows into the canonical tables."""

from pyspark.sql import Column, DataFrame, functions as F

from voltide import constants as K, schemas
from voltide.functions.numeric import nan_to_null, to_numeric
from voltide.operators.tables import pick_by


def not_marked(name: str, mark: str):
    return ~F.col(name).eqNullSafe(F.lit(mark))


def normalize_total_key(df: DataFrame, mark: str = K.SUBTOTAL_MARK) -> DataFrame:
    return df.withColumn("product_id", F.replace("product_id", F.lit(mark), F.lit(K.TOTAL_KEY)))


def drop_sum_rows(df: DataFrame, mark: str = K.SUM_ROW_MARK) -> DataFrame:
    """Drop grand-total rows, recognised by a phrase inside the id."""
    return df.where(~F.coalesce(F.contains("product_id", F.lit(mark)), F.lit(False)))


def _marked(grand_total: str) -> Column:
    return ~(not_marked("product_id", grand_total) & not_marked("group_id", grand_total))


def futures_problem(grand_total: str = K.GRAND_TOTAL_MARK) -> Column:
    """Why a raw futures row is no quote; NULL for a quote."""
    size = to_numeric(F.col("open_interest"), "bigint")
    return (
        F.when(_marked(grand_total), "grand_total")
        .when(F.col("open_interest").isNull(), "missing_open_interest")
        .when(size.isNull(), "unreadable_open_interest")
        .when(size <= 0, "no_open_interest")
    )


def options_problem(grand_total: str = K.GRAND_TOTAL_MARK) -> Column:
    """Why a raw option row is no quote; NULL for a quote and for total rows, which may be without volume."""
    size = to_numeric(F.col("volume"), "bigint")
    return (
        F.when(_marked(grand_total), "grand_total")
        .when(F.col("volume").isNull(), "missing_volume")
        .when(F.col("product_id").eqNullSafe(F.lit(K.TOTAL_KEY)), F.lit(None).cast("string"))
        .when(size.isNull(), "unreadable_volume")
        .when(size <= 0, "no_volume")
    )


def quarantine(df: DataFrame, problem: Column) -> DataFrame:
    """The rows that have a problem, whole and as they came, with a ``reject_reason``.

    With ``futures_problem`` or ``options_problem`` these are the rows that the
    normalisation leaves out: kept and quarantined rows make up the input.
    """
    return df.withColumn("reject_reason", problem).where(F.col("reject_reason").isNotNull())


def normalize_futures(df: DataFrame, grand_total: str = K.GRAND_TOTAL_MARK) -> DataFrame:
    return df.where(futures_problem(grand_total).isNull()).select(
        "trade_date",
        "exchange",
        "product_id",
        F.trim("group_id").alias("group_id"),
        *[to_numeric(F.col(c)).alias(c) for c in schemas.FUTURES_PRICE_COLUMNS],
        *[to_numeric(F.col(c), "bigint").alias(c) for c in schemas.FUTURES_COUNT_COLUMNS],
    )


def normalize_options(df: DataFrame, grand_total: str = K.GRAND_TOTAL_MARK) -> DataFrame:
    kinds = dict(df.dtypes)  # numbers need no way through text
    return df.where(options_problem(grand_total).isNull()).select(
        "trade_date",
        "exchange",
        "product_id",
        "group_id",
        "otype",
        *[(nan_to_null(F.col(c)) if kinds[c] == "double" else to_numeric(F.col(c))).alias(c) for c in ("strike", "u_price", "close")],
        *[to_numeric(F.col(c), "bigint").alias(c) for c in ("volume", "open_interest")],
    )


def fix_zero_close(df: DataFrame) -> DataFrame:
    return df.withColumn("close", F.when(F.col("close") == 0, F.col("settle")).otherwise(F.col("close")))


def dedupe_last(df: DataFrame, keys: list, order: list) -> DataFrame:
    """Keep the last row per key in a stated order."""
    return pick_by(df, keys, order, last=True)


def only_groups(df: DataFrame, groups: list, keep: bool = True) -> DataFrame:
    member = F.col("group_id").isin(*groups)
    return df.where(member if keep else ~member)


def with_oi_change(df: DataFrame, now: str = "open_interest", before: str = "pre_open_interest") -> DataFrame:
    return df.withColumn(
        "oi_change", to_numeric(F.col(now), "bigint") - to_numeric(F.col(before), "bigint")
    )


def in_dates(df: DataFrame, dates: DataFrame, date_col: str = "trade_date") -> DataFrame:
    """Rows whose date is in a table of dates."""
    return df.join(dates.select(F.col(dates.columns[0]).alias(date_col)), date_col, "left_semi")


def date_slice(df: DataFrame, after, upto, date_col: str = "trade_date") -> DataFrame:
    """Rows with ``after`` < date <= ``upto``; prunes date partitions."""
    return df.where((F.col(date_col) > after) & (F.col(date_col) <= upto))
