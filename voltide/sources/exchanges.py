# -*- coding: utf-8 -*-
"""Exchange documents to canonical quote tables.

The futures readers return contract and total rows as the source delivers
them; ``futures_index`` ignores the total rows and ``index_on_totals`` fills
them. The option readers return quotes joined to the close of their
underlying, ready for ``quote_iv`` and ``siv``.
"""

from pyspark.sql import DataFrame, functions as F

from voltide import constants as K
from voltide.functions import text
from voltide.operators.aggregate import with_total_rows
from voltide.operators.joins import attach_code, attach_underlying, code_table
from voltide.operators.normalize import (
    drop_sum_rows, normalize_futures, normalize_options, normalize_total_key, only_groups, with_oi_change,
)
from voltide.operators.tables import staged
from voltide.sources.documents import html_records, json_rows, strip, xml_rows

# --- fixed values: field names of the exchange documents --------------------------
SHFE_ARRAY = "o_curinstrument"
SHFE_FUTURES = {
    "DELIVERYMONTH": "product_id",
    "PRODUCTID": "group_id",
    "PRESETTLEMENTPRICE": "pre_settle",
    "OPENPRICE": "open",
    "HIGHESTPRICE": "high",
    "LOWESTPRICE": "low",
    "CLOSEPRICE": "close",
    "SETTLEMENTPRICE": "settle",
    "OPENINTEREST": "open_interest",
    "OPENINTERESTCHG": "oi_change",
    "VOLUME": "volume",
}
SHFE_OPTIONS = {
    "INSTRUMENTID": "product_id",
    "PRODUCTGROUPID": "group_id",
    "CLOSEPRICE": "close",
    "OPENINTEREST": "open_interest",
    "VOLUME": "volume",
}
CFFE_ROW = "dailydata"
CFFE_FIELDS = {
    "instrumentid": "product_id",
    "tradingday": "day_text",
    "openprice": "open",
    "highestprice": "high",
    "lowestprice": "low",
    "closeprice": "close",
    "preopeninterest": "pre_open_interest",
    "openinterest": "open_interest",
    "presettlementprice": "pre_settle",
    "settlementpriceif": "settle_if",
    "settlementprice": "settle",
    "volume": "volume",
    "turnover": "turnover",
    "productid": "group_id",
    "delta": "delta",
    "expiredate": "expiry_text",
}
CFFE_OPTION_GROUPS = ["IO"]
DCE_FUTURES = {
    "交割月份": "product_id",
    "商品名称": "group_id",
    "前结算价": "pre_settle",
    "开盘价": "open",
    "最高价": "high",
    "最低价": "low",
    "收盘价": "close",
    "结算价": "settle",
    "持仓量": "open_interest",
    "持仓量变化": "oi_change",
    "成交量": "volume",
}
DCE_OPTIONS = {
    "合约名称": "product_id",
    "商品名称": "group_id",
    "收盘价": "close",
    "持仓量": "open_interest",
    "成交量": "volume",
}
CZCE_IDS = ("品种月份", "合约代码")
CZCE_OPTION_IDS = ("品种代码", "合约代码")
CZCE_OPEN_INTEREST = ("持仓量", "空盘量")
CZCE_FUTURES = {
    "昨结算": "pre_settle",
    "今开盘": "open",
    "最高价": "high",
    "最低价": "low",
    "今收盘": "close",
    "今结算": "settle",
    "增减量": "oi_change",
    "成交量(手)": "volume",
}
CALENDAR_ROW = "doc"


def _renamed(df: DataFrame, names: dict) -> DataFrame:
    return df.select("exchange", "trade_date", "pos", *[F.col(a).alias(b) for a, b in names.items()])


# --- Shanghai: JSON -----------------------------------------------------------------
def ingest_shfe_futures(payloads: DataFrame) -> DataFrame:
    rows = normalize_total_key(_renamed(json_rows(payloads, SHFE_ARRAY, list(SHFE_FUTURES)), SHFE_FUTURES))
    contract = F.concat(text.strip_futures_suffix(F.col("group_id")), F.col("product_id"))
    named = rows.withColumn(
        "product_id", F.when(F.col("product_id") == K.TOTAL_KEY, F.col("product_id")).otherwise(contract)
    )
    return normalize_futures(named)


def _finish_options(rows: DataFrame, underlying: DataFrame, id_col: str, dashed: bool, index_option: bool = False) -> DataFrame:
    parsed = rows if "_o" in rows.columns else rows.withColumn("_o", text.parse_option_name(F.col("product_id"), dashed))
    u_id = text.index_underlying(F.col("_o.u_id")) if index_option else F.col("_o.u_id")
    parsed = parsed.withColumns({"u_id": u_id, "otype": F.col("_o.otype"), "strike": F.col("_o.strike")}).drop("_o")
    return normalize_options(attach_underlying(parsed, underlying, id_col, stored=True))


def ingest_shfe_options(payloads: DataFrame, futures: DataFrame) -> DataFrame:
    rows = normalize_total_key(_renamed(json_rows(payloads, SHFE_ARRAY, list(SHFE_OPTIONS)), SHFE_OPTIONS))
    trimmed = rows.withColumns({"product_id": F.trim("product_id"), "group_id": F.trim("group_id")})
    return _finish_options(drop_sum_rows(trimmed), futures, "product_id", dashed=False)


# --- financial futures: XML -----------------------------------------------------------
def _cffe_rows(payloads: DataFrame) -> DataFrame:
    rows = _renamed(xml_rows(payloads, CFFE_ROW, list(CFFE_FIELDS)), CFFE_FIELDS)
    dated = rows.withColumn("trade_date", text.compact_date(F.col("day_text")))
    return with_oi_change(dated).drop("day_text", "settle_if", "turnover", "delta", "expiry_text", "pre_open_interest")


def _cffe_totals(rows: DataFrame) -> DataFrame:
    """Total rows from the first row of a product, in an order that several documents of one day cannot upset.

    Contracts and totals come from the same rows, so documents are parsed once.
    """
    rows = staged(rows, "cffe-rows")
    numbers = [F.col(c).try_cast("double") for c in ("close", "open_interest", "oi_change", "settle")]
    rest = sorted(set(rows.columns) - {"pos", "product_id", "trade_date", "exchange", "group_id"})
    return with_total_rows(rows, ["pos", "product_id", *numbers, *rest])


def ingest_cffe_futures(payloads: DataFrame) -> DataFrame:
    return normalize_futures(_cffe_totals(only_groups(_cffe_rows(payloads), CFFE_OPTION_GROUPS, keep=False)))


def ingest_cffe_options(payloads: DataFrame, index: DataFrame) -> DataFrame:
    """Index options; ``index`` has the equity index in ``group_id``."""
    rows = _cffe_totals(only_groups(_cffe_rows(payloads), CFFE_OPTION_GROUPS))
    return _finish_options(rows, index, "group_id", dashed=True, index_option=True)


# --- Dalian: HTML, titles in th ----------------------------------------------------------
def _dce_rows(payloads: DataFrame, names: dict) -> DataFrame:
    rows = html_records(payloads, {b: (a,) for a, b in names.items()}, header="th")
    return rows.withColumn(
        "product_id",
        F.when(F.contains("group_id", F.lit(K.SUBTOTAL_MARK)), F.lit(K.TOTAL_KEY)).otherwise(F.col("product_id")),
    )


def ingest_dce_futures(payloads: DataFrame, codes: DataFrame = None) -> DataFrame:
    rows = normalize_futures(_dce_rows(payloads, DCE_FUTURES))
    named = rows.withColumn("group_id", text.strip_mark(F.col("group_id"), K.SUBTOTAL_MARK))
    return attach_code(named, code_table(payloads.sparkSession) if codes is None else codes)


def ingest_dce_options(payloads: DataFrame, futures: DataFrame) -> DataFrame:
    rows = _dce_rows(payloads, DCE_OPTIONS)
    named = rows.withColumn("group_id", text.strip_mark(F.col("group_id"), K.SUBTOTAL_MARK))
    return _finish_options(named, futures, "product_id", dashed=True)


# --- Zhengzhou: HTML, titles in thead -------------------------------------------------------
def _czce_rows(payloads: DataFrame, ids: tuple, names: dict) -> DataFrame:
    wanted = {"product_id": ids, "open_interest": CZCE_OPEN_INTEREST, **{b: (a,) for a, b in names.items()}}
    return normalize_total_key(html_records(payloads, wanted, header="thead", carry="product_id"))


def ingest_czce_futures(payloads: DataFrame) -> DataFrame:
    rows = _czce_rows(payloads, CZCE_IDS, CZCE_FUTURES)
    group = F.when(F.col("product_id") == K.TOTAL_KEY, text.strip_digits(F.col("carried"))).otherwise(
        text.strip_digits(F.col("product_id"))
    )
    return normalize_futures(rows.withColumn("group_id", group))


def ingest_czce_options(payloads: DataFrame, futures: DataFrame) -> DataFrame:
    rows = _czce_rows(payloads, CZCE_OPTION_IDS, {k: v for k, v in CZCE_FUTURES.items() if v in ("close", "volume")})

    # a total row takes its group from the contract before it; other names are matched once
    named = F.when(F.col("product_id") == K.TOTAL_KEY, F.col("carried")).otherwise(F.col("product_id"))
    parsed = drop_sum_rows(rows).withColumn("_named", named).withColumn("_o", text.parse_option_name(F.col("_named")))
    group = F.coalesce(text.strip_digits(F.col("_o.u_id")), F.col("_named"))
    own = F.when(~F.col("product_id").eqNullSafe(F.lit(K.TOTAL_KEY)), F.col("_o"))
    return _finish_options(parsed.withColumns({"group_id": group, "_o": own}).drop("_named"), futures, "product_id", dashed=False)


# --- equity index and trading calendar ----------------------------------------------------
def ingest_csi_series(payloads: DataFrame) -> DataFrame:
    """Daily closes of the equity index from a JSON list of records."""
    records = F.from_json("payload", "array<struct<tradedate:string,tclose:string>>")
    rows = payloads.select("exchange", F.inline(records))
    return rows.select(
        text.drop_midnight(F.col("tradedate")).alias("trade_date"),
        "exchange",
        F.lit(K.CSI_GROUP).alias("group_id"),
        F.col("tclose").try_cast("double").alias("close"),
    )


def ingest_csi_daily(payloads: DataFrame, after: str = K.CSI_AFTER_TIME) -> DataFrame:
    """The day's close from the index page, once the page shows the final value.

    The page is cut at its ``item`` blocks. An item counts when it names the
    index, carries the requested date, and a time later than ``after``.
    """
    items = F.regexp_extract_all("payload", F.lit(r"(?s)(class=\"item[\"\s].*?)(?=class=\"item[\"\s]|$)"), F.lit(1))
    rows = payloads.select("exchange", "trade_date", F.explode(items).alias("_item"))

    def field(name):
        return strip(F.regexp_extract("_item", rf"(?s)class=\"{name}\"[^>]*>(.*?)<", 1))

    stamp = F.regexp_extract(field("time"), r"：\s*(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})", 0)
    parts = rows.select(
        "exchange", "trade_date",
        field("g_name").alias("_name"),
        F.split(F.regexp_replace(stamp, r"^：\s*", ""), r"\s+").alias("_stamp"),
        field("g_num").alias("_num"),
    )
    wanted = (
        (F.col("_name") == K.CSI_ITEM_NAME)
        & (F.get("_stamp", F.lit(0)) == F.date_format("trade_date", "yyyy-MM-dd"))
        & (F.get("_stamp", F.lit(1)) > after)
    )
    return parts.where(wanted).select(
        "trade_date", "exchange", F.lit(K.CSI_GROUP).alias("group_id"), F.col("_num").try_cast("double").alias("close")
    )


def ingest_calendar(payloads: DataFrame) -> DataFrame:
    """Detailed calendar rows (cal_date, title, closed)."""
    rows = xml_rows(payloads, CALENDAR_ROW, ["pubdate", "title"])
    return rows.select(
        F.try_to_date(F.trim("pubdate"), "yyyy-MM-dd").alias("cal_date"),
        "title",
        F.coalesce(text.is_closed_title(F.col("title")), F.lit(False)).alias("closed"),
    )
