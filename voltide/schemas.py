"""Explicit schemas of the tables the jobs read and write."""

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


FUTURES_QUOTES = _struct(
    ("trade_date", T.DateType()),
    ("exchange", T.StringType()),
    ("product_id", T.StringType()),
    ("group_id", T.StringType()),
    ("pre_settle", T.DoubleType()),
    ("open", T.DoubleType()),
    ("high", T.DoubleType()),
    ("low", T.DoubleType()),
    ("close", T.DoubleType()),
    ("settle", T.DoubleType()),
    ("open_interest", T.LongType()),
    ("oi_change", T.LongType()),
    ("volume", T.LongType()),
)

OPTION_QUOTES = _struct(
    ("trade_date", T.DateType()),
    ("exchange", T.StringType()),
    ("product_id", T.StringType()),
    ("group_id", T.StringType()),
    ("otype", T.StringType()),
    ("strike", T.DoubleType()),
    ("u_price", T.DoubleType()),
    ("close", T.DoubleType()),
    ("volume", T.LongType()),
    ("open_interest", T.LongType()),
    ("iv", T.DoubleType()),
    ("rdays", T.IntegerType()),
)

SOLVED_QUOTES = T.StructType([*OPTION_QUOTES.fields, T.StructField("iv_status", T.StringType(), True)])

PRODUCT_INDEX = _struct(
    ("trade_date", T.DateType()),
    ("exchange", T.StringType()),
    ("group_id", T.StringType()),
    ("close", T.DoubleType()),
)

PRODUCT_SIV = _struct(
    ("trade_date", T.DateType()),
    ("exchange", T.StringType()),
    ("group_id", T.StringType()),
    ("iv", T.DoubleType()),
)

TRADING_CALENDAR = _struct(
    ("cal_date", T.DateType()),
    ("is_session", T.BooleanType()),
    ("closed", T.BooleanType()),
)

RAW_PAYLOADS = _struct(
    ("exchange", T.StringType()),
    ("kind", T.StringType()),
    ("trade_date", T.DateType()),
    ("payload", T.StringType()),
)

FUTURES_PRICE_COLUMNS = ["pre_settle", "open", "high", "low", "close", "settle"]
FUTURES_COUNT_COLUMNS = ["open_interest", "oi_change", "volume"]
