# -*- coding: utf-8 -*-
"""Exchange documents rendered from the benchmark tables.

Every line item becomes one small document with a contract row and the extra
rows a real document has (subtotal, grand total, empty and dashed cells). No
rows are grouped to build a document; line items are spread over tasks by their
number first, because a document costs far more than its line's bytes. HTML
documents come in a second form, as the exchanges publish them: all contracts
of a day in one document, a subtotal behind each product. There the numbers,
not the rendered rows, go to the task that has the day.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from voltide import constants as K, schemas
from voltide.operators.tables import apart
from voltide.plans import views
from voltide.sources import exchanges

# a day's document holds the lines of so many parts, about 240 in all exchanges
SHEET_PARTS = 20_000
# lines that a task renders and reads
TASK_LINES = 50_000
# what a daily document is of
DAY = ["exchange", "trade_date", "sheet"]


def with_month(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("month", T.DateType(), True)])


MONTH_SCHEMA = with_month(schemas.FUTURES_QUOTES)

# part type -> commodity name of the Dalian exchange; one has no code
DCE_NAMES = {
    "ECONOMY": "玉米", "LARGE": "豆粕", "MEDIUM": "铁矿石", "PROMO": "聚丙烯", "SMALL": "棕榈油", "STANDARD": "杂项",
}
# part type -> group id that reports can name; one is not listed there
REPORT_IDS = {
    "ECONOMY": "cu_f", "LARGE": "sc_f", "MEDIUM": "豆粕", "PROMO": "SR", "SMALL": "WH", "STANDARD": "csidx300",
}


def _pick(col: Column, names: dict) -> Column:
    out = F.lit(None).cast("string")
    for kind, name in names.items():
        out = F.when(col == kind, F.lit(name)).otherwise(out)
    return out


def dce_name(group: Column) -> Column:
    return _pick(group, DCE_NAMES)


def display_id(group: Column) -> Column:
    return _pick(group, REPORT_IDS)


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _comma(col: Column) -> Column:
    return F.format_number(col, 0)


def _quotes(spark: SparkSession, folder: str, daily: bool = False) -> DataFrame:
    """Line items with the numbers a document prints, spread by their number: a file of few bytes holds many documents.

    ``daily``: spread by the document they go to.
    """
    items = views.table(spark, folder, "lineitem")
    tasks = -(-items.count() // TASK_LINES) or 1
    base = views.lines(spark, folder, items if daily else items.repartition(tasks))
    base = base.withColumn("sheet", F.floor(F.col("l_partkey") / SHEET_PARTS))
    if daily:
        base = base.repartition(tasks, *DAY)
    month = F.add_months(F.trunc("trade_date", "month"), F.col("l_linenumber") + 2)
    price = F.col("l_extendedprice")
    return base.select(
        "trade_date", "exchange", "group_id", "l_linenumber", "l_linestatus",
        views.code_of().alias("code"),
        F.date_format(month, "yyMM").alias("stamp"),
        (price - F.col("l_tax")).alias("pre_settle"),
        price.alias("open"), (price + 1).alias("high"), (price - 1).alias("low"), price.alias("close"),
        (price + F.col("l_discount")).alias("settle"),
        # one line number stands for contracts without open interest
        F.when(F.col("l_linenumber") == 7, F.lit(0)).otherwise(F.col("l_quantity").cast("bigint") * 100).alias("oi"),
        (F.col("l_quantity").cast("bigint") - 25).alias("oi_change"),
        (F.col("l_quantity").cast("bigint") * 70).alias("volume"),
        F.rint(F.col("p_retailprice") * (F.lit(0.80) + F.lit(0.05) * F.col("l_linenumber"))).cast("bigint").alias("strike"),
        F.when(F.col("l_linestatus") == "O", F.lit("C")).otherwise(F.lit("P")).alias("otype"),
        views.fair_price().alias("fair"),
        "l_tax", "sheet",
    )


def _payload(rows: DataFrame, kind: str, body: Column) -> DataFrame:
    return rows.select("exchange", F.lit(kind).alias("kind"), "trade_date", body.alias("payload"))


def _json_payload(rows: DataFrame, kind: str, body: Column) -> DataFrame:
    """Documents that are whole before a reader opens them.

    ``from_json`` interprets its argument expression by expression; planned together, that argument would be all of
    the rendering.
    """
    return apart(_payload(rows, kind, body))


# --- JSON ----------------------------------------------------------------------------
def shfe_futures(spark: SparkSession, folder: str, bump: float = 0.0) -> DataFrame:
    rows = _quotes(spark, folder)

    def record(month, group, oi, close):
        values = {
            "DELIVERYMONTH": month, "PRODUCTID": group,
            "PRESETTLEMENTPRICE": F.when(F.col("l_tax") == 0, F.lit("-")).otherwise(_text("pre_settle")),
            "OPENPRICE": F.lit(""), "HIGHESTPRICE": _text("high"), "LOWESTPRICE": _text("low"),
            "CLOSEPRICE": close, "SETTLEMENTPRICE": _text("settle"), "OPENINTEREST": oi,
            "OPENINTERESTCHG": _text("oi_change"), "VOLUME": _text("volume"),
        }
        return F.struct(*[v.alias(k) for k, v in values.items()])

    group = F.concat(F.col("code"), F.lit("_f   "))
    close = (F.col("close") + bump).cast("string")
    body = F.to_json(F.struct(F.array(
        record(F.col("stamp"), group, _comma(F.col("oi")), close),
        record(F.lit(K.SUBTOTAL_MARK), group, F.lit("1"), F.lit("")),
        record(F.lit(""), F.lit(K.GRAND_TOTAL_MARK), F.lit("1"), F.lit("")),
    ).alias(exchanges.SHFE_ARRAY)))
    return _json_payload(rows, "futures", body)


def option_name(dash: str = "", digits: int = 4) -> Column:
    stamp = F.substring("stamp", 5 - digits, digits)
    return F.concat("code", stamp, F.lit(dash), "otype", F.lit(dash), F.col("strike").cast("string"))


def shfe_options(spark: SparkSession, folder: str, price: str = "close") -> DataFrame:
    rows = _quotes(spark, folder)

    def record(name, group, volume):
        values = {
            "INSTRUMENTID": name, "PRODUCTGROUPID": group, "CLOSEPRICE": _text(price),
            "OPENINTEREST": _text("oi"), "VOLUME": volume,
        }
        return F.struct(*[v.alias(k) for k, v in values.items()])

    group = F.concat("code", F.lit("  "))
    body = F.to_json(F.struct(F.array(
        record(F.concat(option_name(), F.lit("  ")), group, F.when(F.col("l_linenumber") == 7, F.lit("")).otherwise(_comma(F.col("volume")))),
        record(F.lit(K.SUBTOTAL_MARK), group, F.lit("0")),
        record(F.lit(K.SUM_ROW_MARK), F.lit(""), F.lit("5")),
    ).alias(exchanges.SHFE_ARRAY)))
    return _json_payload(rows, "options", body)


# --- XML -----------------------------------------------------------------------------
def cffe(spark: SparkSession, folder: str, price: str = "close") -> DataFrame:
    """Futures and index options in one document, as the exchange publishes them."""
    rows = _quotes(spark, folder)
    oi = F.col("oi") + 100

    def element(name, product, close="close"):
        values = {
            "instrumentid": name, "tradingday": F.date_format("trade_date", "yyyyMMdd"),
            "highestprice": _text("high"), "lowestprice": _text("low"), "closeprice": _text(close),
            "preopeninterest": (oi - F.col("oi_change")).cast("string"), "openinterest": oi.cast("string"),
            "presettlementprice": _text("pre_settle"), "settlementprice": _text("settle"),
            "volume": _text("volume"), "productid": product,
        }
        parts = [F.concat(F.lit(f"<{k}>"), v, F.lit(f"</{k}>")) for k, v in values.items()]
        return F.concat(F.lit("<dailydata><openprice></openprice>"), *parts, F.lit("</dailydata>"))

    option = F.concat(F.lit("IO"), "stamp", F.lit("-"), "otype", F.lit("-"), F.col("strike").cast("string"))
    body = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><dailydatas>'),
        element(F.concat("code", "stamp"), F.col("group_id")),
        element(option, F.lit("IO"), price),
        F.lit("</dailydatas>"),
    )
    return _payload(rows, "daily", body)


def calendar_xml(spark: SparkSession, folder: str) -> DataFrame:
    """One notice per order: high-priority orders announce a closed market."""
    orders = views.table(spark, folder, "orders")
    title = F.concat(
        F.col("o_orderkey").cast("string"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.lit(K.CLOSED_MARK)).otherwise(F.lit(" &amp; ")),
    )
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    body = F.concat(
        F.lit("<rss><channel><doc><title>"), title, F.lit("</title><pubdate>"), day, F.lit("</pubdate></doc></channel></rss>")
    )
    rows = orders.select(F.lit("CFFE").alias("exchange"), F.col("o_orderdate").cast("date").alias("trade_date"), body.alias("_b"))
    return _payload(rows, "calendar", F.col("_b"))


# --- HTML ----------------------------------------------------------------------------
def _row(cells: list, tag: str = "td") -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")) for c in cells], F.lit("</tr>\n"))


def _through_charset(body: Column) -> Column:
    """The bytes of the exchange's character set, decoded as a reader does."""
    return F.decode(F.encode(body, K.SOURCE_CHARSET), K.SOURCE_CHARSET)


def _bodies(rows: DataFrame, contract: Column, subtotal: Column, daily: bool) -> DataFrame:
    """Table rows of every document: one contract with its subtotal, or all contracts of a day product by product."""
    if not daily:
        return rows.withColumn("rows", F.concat(contract, subtotal))
    lines = rows.select(*DAY, "group_id", contract.alias("line"), subtotal.alias("subtotal"))
    products = lines.groupBy(*DAY, "group_id").agg(
        F.concat(F.array_join(F.sort_array(F.collect_list("line")), ""), F.min("subtotal")).alias("part"))
    parts = F.sort_array(F.collect_list(F.struct("group_id", "part")))
    return products.groupBy(*DAY).agg(F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("rows"))


def _dce(rows: DataFrame, kind: str, titles: list, contract: list, subtotal: list, grand: list, daily: bool) -> DataFrame:
    body = F.concat(
        F.lit("<html><body><div>行情</div><table class='t'>\n"),
        _row([F.lit(t) for t in titles], "th"), F.col("rows"), _row(grand),
        F.lit("</table><table><tr><td>x</td></tr></table></body></html>"),
    )
    return _payload(_bodies(rows, _row(contract), _row(subtotal), daily), kind, _through_charset(body))


def dce_futures(spark: SparkSession, folder: str, daily: bool = False) -> DataFrame:
    rows = _quotes(spark, folder, daily)
    name = dce_name(F.col("group_id"))
    numbers = [
        F.when(F.col("l_tax") == 0, F.lit("-")).otherwise(_text("pre_settle")), F.lit(" - "), _text("high"),
        _text("low"), F.concat(F.lit("<b>"), _text("close"), F.lit("</b>&nbsp;")), _text("settle"),
        _comma(F.col("oi")), _text("oi_change"), _comma(F.col("volume")),
    ]
    titles = ["商品名称", "交割月份", "前结算价", "开盘价", "最高价", "最低价", "收盘价", "结算价", "持仓量", "持仓量变化", "成交量"]
    blank = [F.lit("")] * 6
    tail = [F.lit("5"), F.lit("-1"), F.lit("7")]
    return _dce(
        rows, "futures", titles,
        [F.concat(F.lit("\n  "), name), F.col("stamp"), *numbers],
        [F.concat(name, F.lit(K.SUBTOTAL_MARK)), F.lit(""), *blank, *tail],
        [F.lit(K.GRAND_TOTAL_MARK), F.lit(""), *blank, *tail],
        daily,
    )


def dce_options(spark: SparkSession, folder: str, daily: bool = False, price: str = "close") -> DataFrame:
    rows = _quotes(spark, folder, daily)
    name = dce_name(F.col("group_id"))
    return _dce(
        rows, "options", ["商品名称", "合约名称", "收盘价", "成交量", "持仓量"],
        [name, option_name("-"), _text(price), _comma(F.col("volume")), _comma(F.col("oi"))],
        [F.concat(name, F.lit(K.SUBTOTAL_MARK)), F.lit(""), F.lit(""), F.lit("0"), F.lit("5")],
        [F.lit(K.GRAND_TOTAL_MARK), F.lit(""), F.lit(""), F.lit("3"), F.lit("5")],
        daily,
    )


def _czce(rows: DataFrame, kind: str, titles: list, contract: list, subtotal: list, grand: list, daily: bool) -> DataFrame:
    """``titles`` are columns, because older documents use other spellings."""
    body = F.concat(
        F.lit("<TABLE id='tab1'><thead>"), _row(titles), F.lit("</thead><tbody>"), F.col("rows"), _row(grand), F.lit("</tbody></TABLE>"),
    )
    return _payload(_bodies(rows, _row(contract), _row(subtotal), daily), kind, _through_charset(body))


def _by_age(old: str, new: str) -> Column:
    return F.when(F.col("trade_date") < "1998-01-01", F.lit(old)).otherwise(F.lit(new))


def czce_futures(spark: SparkSession, folder: str, daily: bool = False) -> DataFrame:
    rows = _quotes(spark, folder, daily)
    titles = [_by_age("品种月份", "合约代码")] + [F.lit(t) for t in ("昨结算", "今开盘", "最高价", "最低价", "今收盘", "今结算")] + [
        _by_age("空盘量", "持仓量"), F.lit("增减量"), F.lit("成交量(手)"),
    ]
    numbers = [_text("pre_settle"), F.lit(""), _text("high"), _text("low"), _text("close"), _text("settle")]
    contract = F.concat(F.col("code"), F.substring("stamp", 2, 3))
    zero = [F.lit("")] * 6
    return _czce(
        rows, "futures", titles,
        [contract, *numbers, _comma(F.col("oi")), _text("oi_change"), _comma(F.col("volume"))],
        [F.lit(K.SUBTOTAL_MARK), *zero, F.lit("5"), F.lit("-1"), F.lit("7")],
        [F.lit(K.GRAND_TOTAL_MARK), *zero, F.lit("5"), F.lit("-1"), F.lit("7")],
        daily,
    )


def czce_options(spark: SparkSession, folder: str, daily: bool = False, price: str = "close") -> DataFrame:
    rows = _quotes(spark, folder, daily)
    titles = [_by_age("品种代码", "合约代码"), F.lit("今收盘"), _by_age("空盘量", "持仓量"), F.lit("成交量(手)")]
    return _czce(
        rows, "options", titles,
        [option_name("", 3), _text(price), _comma(F.col("oi")), _comma(F.col("volume"))],
        [F.lit(K.SUBTOTAL_MARK), F.lit(""), F.lit("5"), F.lit("0")],
        [F.lit(K.SUM_ROW_MARK), F.lit(""), F.lit("5"), F.lit("9")],
        daily,
    )


def pages_with_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Raw web pages, each with a table of facts about it at its end: a caption over the titles, a table inside a cell,
    spans over columns and rows, and rows without closing tags."""
    page, url, size = F.col("page_id").cast("string"), F.col("url"), F.length("html").cast("string")
    facts = F.concat(
        F.lit('<table title="a > b"><tr><th colspan="3">facts &amp; figures</th></tr><tr><th>page</th><th>url</th><th>size</th></tr><tr><td rowspan=2>'),
        page, F.lit('</td><td><a href="'), url, F.lit('">'), url, F.lit("</a></td><td><table><tr><td>"), size,
        F.lit("</td></tr></table> &lt; &infin;</td></tr><tr><td colspan='2'>"), size, F.lit("</td></tr><!-- <tr><td>no</td></tr> --><tr><td>"),
        page, F.lit("<td>-</table><table><tr><td>other</td></tr></table>"),
    )
    rows = views.table(spark, folder, "pages").select(
        F.lit("web").alias("exchange"), F.lit(None).cast("date").alias("trade_date"), F.concat("html", facts).alias("_b"))
    return _payload(rows, "page", F.col("_b"))


# --- equity index ---------------------------------------------------------------------
def csi_series(spark: SparkSession, folder: str) -> DataFrame:
    orders = views.table(spark, folder, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    record = F.struct(
        F.lit("000300").alias("indx_code"), F.concat(day, F.lit(" 00:00:00")).alias("tradedate"),
        F.col("o_totalprice").cast("string").alias("tclose"), F.lit("1").alias("lclose"), F.lit("2").alias("changes"),
    )
    rows = orders.select(
        F.lit("CSI").alias("exchange"), F.col("o_orderdate").cast("date").alias("trade_date"), F.to_json(F.array(record)).alias("_b")
    )
    return _payload(rows, "index", F.col("_b"))


def csi_page(spark: SparkSession, folder: str) -> DataFrame:
    """Index page with two items; finished orders show the final time, others an
    earlier time, and pending ones the day before."""
    orders = views.table(spark, folder, "orders")
    day = F.date_format(
        F.when(F.col("o_orderstatus") == "P", F.date_sub("o_orderdate", 1)).otherwise(F.col("o_orderdate").cast("date")),
        "yyyy-MM-dd",
    )
    clock = F.when(F.col("o_orderstatus") == "O", F.lit("14:59:59")).otherwise(F.lit("15:01:03"))

    def item(name, number):
        return F.concat(
            F.lit('<div class="item"><span class="g_name"> '), F.lit(name), F.lit('</span><em class="g_num">'), number,
            F.lit('</em><p class="time">更新时间：'), day, F.lit(" "), clock, F.lit("</p></div>"),
        )

    body = F.concat(
        F.lit("<html><body>"), item("上证50", F.lit("1.5")), item(K.CSI_ITEM_NAME, F.col("o_totalprice").cast("string")),
        F.lit("</body></html>"),
    )
    rows = orders.select(F.lit("CSI").alias("exchange"), F.col("o_orderdate").cast("date").alias("trade_date"), body.alias("_b"))
    return _payload(rows, "page", F.col("_b"))


# --- stored files ---------------------------------------------------------------------
def ingest_by_month(payloads: DataFrame) -> DataFrame:
    return exchanges.ingest_shfe_futures(payloads).withColumn("month", F.trunc("trade_date", "month"))


def write_contract_files(quotes: DataFrame, path: str) -> None:
    """CSV files below one folder per delivery date."""
    missing = [f for f in schemas.FUTURES_QUOTES.fields if f.name not in quotes.columns]
    filled = quotes.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    filled.select(*schemas.FUTURES_QUOTES.fieldNames(), "delivery").hint("rebalance", F.col("delivery")).write.partitionBy(
        "delivery"
    ).option("header", True).csv(path)
