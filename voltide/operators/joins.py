"""Joins between quotes, products and reference tables."""

from pyspark.sql import Column, DataFrame, functions as F

from voltide import constants as K
from voltide.operators.tables import apart, fixed_table, pick_by, staged


def unique_closes(underlying: DataFrame, id_col: str = "product_id", order: list = None, keys: list = ("trade_date",)) -> DataFrame:
    """One close per day and contract, whatever copies the source holds.

    Total rows are no underlyings. With ``order`` the last copy wins,
    otherwise the highest close. Map tasks reduce the copies before the
    shuffle.
    """
    contracts = underlying.where(F.col(id_col) != K.TOTAL_KEY).withColumnRenamed(id_col, "u_id")
    if order:
        return pick_by(contracts, [*keys, "u_id"], list(order), last=True).select(*keys, "u_id", F.col("close").alias("u_price"))
    return contracts.groupBy(*keys, "u_id").agg(F.max("close").alias("u_price"))


def attach_underlying(options: DataFrame, underlying: DataFrame, id_col: str = "product_id", order: list = None,
                      stored: bool = False) -> DataFrame:
    """Left join the close of the underlying contract of the same day.

    Where both sides name their exchange and ids are contracts, the exchange is
    part of the key: one id on two exchanges is two contracts. The right side
    has one row per key, so the join cannot multiply options. A hot underlying
    is split at run time by adaptive execution (left side of a left join), and a
    small right side is broadcast on its measured size. With ``stored`` the
    closes are written first, so their size is known when the join is planned
    and options that cost much to make are neither shuffled nor sorted.
    """
    left = options.drop("u_price")
    both = id_col == "product_id" and "exchange" in underlying.columns and "exchange" in left.columns
    keys = ["trade_date", "exchange"] if both else ["trade_date"]
    closes = unique_closes(underlying, id_col, order, keys)
    left, closes = (apart(left), staged(closes, "closes")) if stored else (left, closes)
    return left.join(closes, [*keys, "u_id"], "left")


def option_group_id(group: Column, exchange: Column = None) -> Column:
    """Group id of a product's options: a fixed map, then the id without the
    futures suffix (Shanghai), else the futures id itself."""
    mapped = F.lit(None).cast("string")
    for futures_id, options_id in K.OPTION_GROUPS.items():
        mapped = F.when(group == futures_id, F.lit(options_id)).otherwise(mapped)
    bare = F.replace(group, F.lit("_f"), F.lit(""))
    plain = bare if exchange is None else F.when(exchange == "SHFE", bare).otherwise(group)
    return F.coalesce(mapped, plain)


def option_exchange(group: Column, exchange: Column) -> Column:
    """Exchange of a product's options: that of the product, unless the fixed map leads elsewhere."""
    return F.when(group.isin(list(K.OPTION_GROUPS)), F.lit(K.INDEX_OPTION_EXCHANGE)).otherwise(exchange)


def join_options(series: DataFrame, siv: DataFrame, keys=("trade_date",)) -> DataFrame:
    """Left join the synthetic volatility of the mapped option group.

    Where both sides name their exchange it is part of the key: one group id
    on two exchanges is two products.
    """
    exchange = F.col("exchange") if "exchange" in series.columns else None
    right = siv.select(*keys, F.col("group_id").alias("opt_group_id"), "iv", *[
        F.col("exchange").alias("opt_exchange") for c in siv.columns if c == "exchange" and exchange is not None])
    on = [*keys, *[c for c in right.columns if c.startswith("opt_")]]
    left = series.withColumn("opt_group_id", option_group_id(F.col("group_id"), exchange))
    if "opt_exchange" in on:
        left = left.withColumn("opt_exchange", option_exchange(F.col("group_id"), exchange))
    return left.join(right, on, "left").drop("opt_group_id", "opt_exchange")


def code_table(spark) -> DataFrame:
    return fixed_table(spark, list(K.DCE_CODES.items()), "group_id string, code string")


def attach_code(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Prefix contract months with the commodity code; unknown names get none."""
    joined = df.join(codes, "group_id", "left")
    coded = F.concat(F.coalesce("code", F.lit("")), F.col("product_id"))
    return joined.withColumn(
        "product_id", F.when(F.col("product_id") == K.TOTAL_KEY, F.col("product_id")).otherwise(coded)
    ).select(*df.columns)


def display_names(spark) -> DataFrame:
    return fixed_table(spark, list(K.DISPLAY_NAMES.items()), "group_id string, name string")
