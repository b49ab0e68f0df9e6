"""Quote-shaped views over the benchmark tables.

The given tables hold orders and parts, not quotes. These views read them as
market data: a line item is a quote of one contract on its ship date, the part
type is the product, the retail price is the underlying price. Only the
columns a query uses are read from the files.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voltide import constants as K
from voltide.functions.numeric import half_even
from voltide.operators import calendar as cal

# part type -> (exchange, product code used in contract names)
PRODUCTS = {
    "ECONOMY": ("SHFE", "cu"),
    "LARGE": ("SHFE", "sc"),
    "MEDIUM": ("DCE", "m"),
    "PROMO": ("CZCE", "SR"),
    "SMALL": ("CZCE", "CF"),
    "STANDARD": ("CFFE", "IO"),
}
ANCHOR = "STANDARD"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _by_type(position: int):
    out = F.lit(None).cast("string")
    for kind, values in PRODUCTS.items():
        out = F.when(F.col("group_id") == kind, F.lit(values[position])).otherwise(out)
    return out


def code_of():
    """Product code used in contract names."""
    return _by_type(1)


def lines(spark: SparkSession, folder: str, items: DataFrame = None) -> DataFrame:
    """Line items with the type and price of their part."""
    part = table(spark, folder, "part").select("p_partkey", F.col("p_type").alias("group_id"), "p_retailprice")
    items = table(spark, folder, "lineitem") if items is None else items
    return (
        items.join(part, items.l_partkey == part.p_partkey)
        .withColumn("trade_date", F.col("l_shipdate").cast("date"))
        .withColumn("exchange", _by_type(0))
    )


def futures_quotes(spark: SparkSession, folder: str) -> DataFrame:
    close = F.col("l_extendedprice") / F.col("l_quantity")
    return lines(spark, folder).select(
        "trade_date",
        "exchange",
        F.col("l_partkey").cast("string").alias("product_id"),
        "group_id",
        (close * (1 - F.col("l_tax"))).alias("pre_settle"),
        close.alias("open"),
        (close * (1 + F.col("l_tax"))).alias("high"),
        (close * (1 - F.col("l_discount"))).alias("low"),
        close.alias("close"),
        (close * (1 - F.col("l_discount") / 2)).alias("settle"),
        F.col("l_quantity").cast("bigint").alias("open_interest"),
        (F.col("l_quantity") - 5 * F.col("l_linenumber")).cast("bigint").alias("oi_change"),
        (F.col("l_quantity") * F.col("l_linenumber")).cast("bigint").alias("volume"),
    )


def contract_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Futures quotes with a delivery date: the last day of the quarter that
    lies ``l_linenumber`` quarters ahead."""
    base = lines(spark, folder)
    quarter = F.trunc("trade_date", "quarter")
    return base.select(
        "trade_date",
        "exchange",
        "group_id",
        F.last_day(F.add_months(quarter, F.col("l_linenumber") * 3 + 2)).alias("delivery"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"),
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice") / F.col("l_quantity") * (1 - F.col("l_tax")))
        .otherwise(F.lit(0.0)).alias("settle"),
    )


def fair_price() -> Column:
    """An option's price on a line of ``lines``: what it is worth at once and a share of the part's price."""
    strike = F.rint(F.col("p_retailprice") * (F.lit(0.80) + F.lit(0.05) * F.col("l_linenumber")))
    cp = F.when(F.col("l_linestatus") == "O", F.lit(1.0)).otherwise(F.lit(-1.0))
    gain = cp * (F.col("p_retailprice") - strike)
    return F.greatest(F.lit(0.0), gain) + F.col("p_retailprice") * (F.lit(0.01) + F.col("l_discount"))


def fair_underlying(spark: SparkSession, folder: str, digits: int = 4) -> DataFrame:
    """Parts' prices as closes of the futures contracts that fairly priced options refer to."""
    month = F.add_months(F.trunc("trade_date", "month"), F.col("l_linenumber") + 2)
    stamp = F.substring(F.date_format(month, "yyMM"), 5 - digits, digits)
    return lines(spark, folder).select("trade_date", "exchange", F.concat(_by_type(1), stamp).alias("product_id"), F.col("p_retailprice").alias("close"))


def fair_index(spark: SparkSession, folder: str) -> DataFrame:
    """The highest part price of a day as the close of the equity index."""
    days = lines(spark, folder).groupBy("trade_date").agg(F.max("p_retailprice").alias("close"))
    return days.withColumn("group_id", F.lit(K.CSI_GROUP))


def call_put() -> Column:
    """Sign of an option quote."""
    return F.when(F.col("otype") == "C", F.lit(1.0)).otherwise(F.lit(-1.0))


def option_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Option quotes with contract names, and a given volatility and days."""
    base = lines(spark, folder)
    u_price = F.col("p_retailprice")
    strike = F.rint(u_price * (F.lit(0.80) + F.lit(0.05) * F.col("l_linenumber")))
    cp = F.when(F.col("l_linestatus") == "O", F.lit(1.0)).otherwise(F.lit(-1.0))
    otype = F.when(F.col("l_linestatus") == "O", F.lit("C")).otherwise(F.lit("P"))
    month = F.add_months(F.trunc("trade_date", "month"), F.col("l_linenumber") + 2)
    code = _by_type(1)
    dash = F.when(F.col("group_id").isin("STANDARD", "MEDIUM"), F.lit("-")).otherwise(F.lit(""))
    # one-digit years are the custom of the Zhengzhou exchange
    stamp = F.date_format(month, "yyMM")
    stamp = F.when(F.col("exchange") == "CZCE", F.substring(stamp, 2, 3)).otherwise(stamp)
    named = base.withColumns({"_strike": strike, "_cp": cp, "_otype": otype})
    return named.select(
        "trade_date",
        "exchange",
        F.concat(code, stamp, dash, F.col("_otype"), dash, F.col("_strike").cast("bigint").cast("string"))
        .alias("product_id"),
        "group_id",
        F.col("_otype").alias("otype"),
        F.col("_strike").alias("strike"),
        u_price.alias("u_price"),
        (F.greatest(F.lit(0.0), F.col("_cp") * (u_price - F.col("_strike"))) + u_price * (F.lit(0.01) + F.col("l_discount")))
        .alias("close"),
        (F.col("l_quantity") * F.col("l_linenumber")).cast("bigint").alias("volume"),
        F.col("l_quantity").cast("bigint").alias("open_interest"),
        (F.col("l_discount") * 4).alias("iv"),
        (F.col("l_quantity").cast("int") * 7 + 1).alias("rdays"),
        F.col("l_partkey").cast("string").alias("part"),
    )


def pricing_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Arguments of the pricing models for every line item."""
    quotes = option_quotes(spark, folder)
    return quotes.select(
        "trade_date", "group_id", F.col("part").alias("product_id"), "open_interest",
        F.col("u_price").alias("s"),
        F.col("strike").alias("k"),
        F.lit(0.12).alias("r"),
        (F.col("rdays") / F.lit(365.0)).alias("t"),
        (F.lit(0.1) + F.col("iv")).alias("v"),
        F.when(F.col("otype") == "C", F.lit(1.0)).otherwise(F.lit(-1.0)).alias("cp"),
        F.col("close").alias("price"),
    )


def index_siv(spark: SparkSession, folder: str) -> DataFrame:
    """A second daily series: the mean order value per priority, seen as an index."""
    orders = table(spark, folder, "orders")
    return orders.groupBy(
        F.col("o_orderdate").cast("date").alias("trade_date"), F.col("o_orderpriority").alias("group_id")
    ).agg(half_even(F.sum("o_totalprice") / F.count("*"), 3).alias("close"))


def equity_index(spark: SparkSession, folder: str) -> DataFrame:
    """The mean order value of a day as the close of the equity index."""
    orders = table(spark, folder, "orders")
    return (
        orders.groupBy(F.col("o_orderdate").cast("date").alias("trade_date"))
        .agg(half_even(F.sum("o_totalprice") / F.count("*"), 3).alias("close"))
        .withColumn("group_id", F.lit(K.CSI_GROUP))
    )


def underlying_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Closes of the futures contracts that option names refer to."""
    base = lines(spark, folder)
    month = F.add_months(F.trunc("trade_date", "month"), F.col("l_linenumber") + 2)
    stamp = F.date_format(month, "yyMM")
    stamp = F.when(F.col("exchange") == "CZCE", F.substring(stamp, 2, 3)).otherwise(stamp)
    return base.select(
        "trade_date", F.concat(_by_type(1), stamp).alias("product_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"),
    )


# month and day of the holidays, and of the days only the detailed calendar closes
HOLIDAYS = ["01-01", "05-01", "05-02", "05-03", "10-01", "10-02", "10-03", "10-04", "10-05"]
DETAIL_CLOSED = ["02-02", "02-03", "07-01", "12-31"]


def trading_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Calendar around the ship dates: weekdays without holidays are sessions."""
    ship = F.col("l_shipdate").cast("date")
    bounds = table(spark, folder, "lineitem").agg(
        F.add_months(F.trunc(F.min(ship), "month"), -4).alias("first"),
        F.add_months(F.max(ship), 18).alias("last"),
    )
    days = cal.calendar_days(bounds)
    label = F.date_format("cal_date", "MM-dd")
    session = (F.weekday("cal_date") < 5) & ~label.isin(HOLIDAYS)
    return days.select(
        "cal_date",
        session.alias("is_session"),
        F.when(label.isin(DETAIL_CLOSED), F.lit(True)).alias("closed"),
    )
