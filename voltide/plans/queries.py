# -*- coding: utf-8 -*-
"""One query per operator, over the given tables.

Dates leave as ISO text and computed doubles are rounded, so results can be
compared by value with another engine.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voltide import constants as K, schemas
from voltide.functions import lattice, numeric, text
from voltide.functions.formats import percent_text, whole_text
from voltide.functions.normal import norm_cdf, norm_pdf
from voltide.functions.register import register_functions
from voltide.operators import (
    aggregate as agg, calendar as cal, contracts, joins, ledger, maintain, normalize, pricing, series, term,
)
from voltide.operators.tables import staged
from voltide.plans import documents as docs, monitor, views
from voltide.session import configure, shared_folder
from voltide.sources import documents as parse, exchanges, files
from voltide.streaming import series_state
from voltide.streaming.daily_sync import SYNC_KEYS, stream_daily_sync
from voltide.streaming.series_state import sync_series

QUERIES = {}
# name -> (documents, reader) of the queries that read rendered documents
DOCUMENT_QUERIES = {}


def query(fn):
    """Register under the function's name."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(configure(spark), str(folder).rstrip("/"))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def document_query(render, **how):
    """Register a reader of documents under its name; it runs on documents rendered from the tables."""
    def register(fn):
        def rendered(spark, folder):
            return render(spark, folder, **how)

        def run(spark, folder):
            return fn(spark, folder, rendered(spark, folder))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        DOCUMENT_QUERIES[fn.__name__] = (rendered, fn)
        query(run)
        return fn

    return register


def day(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def rnd(name, scale: int = 6, alias: str = None) -> Column:
    col = F.col(name) if isinstance(name, str) else name
    return numeric.strict_zero(numeric.half_even(col, scale)).alias(alias or name)


def _keys():
    return [day("trade_date"), "exchange", "group_id"]


def _index(spark, folder):
    return agg.futures_index(views.futures_quotes(spark, folder))


def _siv(spark, folder):
    return agg.siv(views.option_quotes(spark, folder))


def _series(spark, folder):
    return monitor.product_series(_index(spark, folder), _siv(spark, folder))


def _snapshot(spark, folder):
    quotes = views.futures_quotes(spark, folder)
    return monitor.monitor_snapshot(_series(spark, folder), views.ANCHOR, quotes)


# --- aggregations -----------------------------------------------------------------
@query
def futures_index(spark, folder):
    return _index(spark, folder).select(*_keys(), "close")


@query
def total_rows(spark, folder):
    quotes = views.futures_quotes(spark, folder).select(
        "trade_date", "exchange", "group_id", "product_id", "open_interest", "volume", "close"
    )
    out = agg.with_total_rows(quotes, ["product_id", "open_interest", "volume", "close"])
    return out.select(*_keys(), "product_id", "open_interest", "volume", rnd("close"))


@query
def index_on_totals(spark, folder):
    quotes = views.futures_quotes(spark, folder).select(
        "trade_date", "exchange", "group_id", "product_id", "open_interest", "close"
    )
    out = agg.index_on_totals(agg.with_total_rows(quotes, ["product_id", "open_interest", "close"]))
    return out.select(*_keys(), "product_id", "open_interest", rnd("close"))


def _siv_query(weight):
    def run(spark, folder):
        return agg.siv(views.option_quotes(spark, folder), weight).select(*_keys(), "iv")

    run.__name__ = f"siv_{weight}"
    return query(run)


for _weight in agg.WEIGHTS:
    _siv_query(_weight)


@query
def siv_on_totals(spark, folder):
    quotes = views.option_quotes(spark, folder).select(
        "trade_date", "exchange", "group_id", "product_id", "strike", "u_price", "close", "volume", "rdays", "iv"
    )
    out = agg.siv_on_totals(agg.with_total_rows(quotes, quotes.columns[3:]))
    return out.select(*_keys(), "product_id", rnd("iv"))


@query
def last_date(spark, folder):
    return agg.last_date(views.futures_quotes(spark, folder)).select(day("trade_date"))


@query
def series_extremes(spark, folder):
    return agg.series_extremes(_index(spark, folder), "close")


# --- time series ------------------------------------------------------------------
@query
def log_return(spark, folder):
    return series.log_return(_index(spark, folder)).select(*_keys(), rnd("log_return"))


@query
def hist_vol(spark, folder):
    out = series.hist_vol(_index(spark, folder), 20)
    return out.select(*_keys(), rnd("hv20"))


@query
def hv_ratio(spark, folder):
    out = series.hv_columns(_index(spark, folder))
    return out.select(*_keys(), rnd("hvm"), rnd("hvy"), rnd("hv_ratio"))


@query
def order_value_volatility(spark, folder):
    """Short volatility of a second kind of series, with one key column."""
    out = series.hv_columns(views.index_siv(spark, folder), keys=("group_id",))
    return out.select(day("trade_date"), "group_id", rnd("hvm"), rnd("hvy"))


@query
def rolling_percentile(spark, folder):
    out = series.rolling_percentile(series.hv_columns(_index(spark, folder)), "hvm", "hv_pct")
    return out.select(*_keys(), F.col("hv_pct").cast("double").alias("hv_pct"))


@query
def percentile_of_value(spark, folder):
    """Each day's close placed within the whole history of its product."""
    index = _index(spark, folder)
    values = index.select("trade_date", "exchange", "group_id", (F.col("close") * 1.5).alias("probe"))
    out = series.percentile_of(index, "close", values, "probe")
    return out.select(*_keys(), F.col("percentile").cast("int").alias("percentile"))


@query
def percentile_thresholds(spark, folder):
    out = series.percentile_thresholds(_index(spark, folder), "close")
    return out.select("exchange", "group_id", F.posexplode("thresholds").alias("rank", "threshold"))


@query
def expanding_extremes(spark, folder):
    out = series.expanding_extremes(series.hv_columns(_index(spark, folder)), "hvm", "hv_max", "hv_min")
    return out.select(*_keys(), rnd("hv_max"), rnd("hv_min"))


@query
def moving_averages(spark, folder):
    out = series.moving_averages(_index(spark, folder))
    return out.select(*_keys(), rnd("ma5"), rnd("ma10"), rnd("ma20"))


@query
def latest_snapshot(spark, folder):
    out = series.latest_snapshot(_index(spark, folder), views.ANCHOR, views.futures_quotes(spark, folder))
    return out.select(*_keys(), "close")


@query
def tail5(spark, folder):
    out = series.percent_window(_index(spark, folder))
    label = text.month_day(F.col("trade_date")).alias("label")
    return out.select(*_keys(), label, "close", F.col("per").cast("double").alias("per"), "max", "min")


@query
def term_structure(spark, folder):
    quotes = views.contract_quotes(spark, folder)
    return term.term_structure(quotes).select(*_keys(), "pos", rnd("price", 4))


@query
def term_pct_change(spark, folder):
    quotes = views.contract_quotes(spark, folder)
    out = term.term_pct_change(term.term_structure(quotes))
    return out.select(*_keys(), "pos", rnd("pct"))


@query
def term_matrix(spark, folder):
    quotes = views.contract_quotes(spark, folder)
    out = term.term_matrix(term.term_structure(quotes), list(range(8)))
    return out.select(*_keys(), *[rnd(str(i), 4, f"p{i}") for i in range(8)])


# --- normalisation -------------------------------------------------------------------
def _messy(spark, folder):
    """Quotes as the text an exchange would print."""
    quotes = views.futures_quotes(spark, folder)
    group = F.concat(F.col("group_id"), F.lit("  "))
    return quotes.select(
        "trade_date",
        "exchange",
        F.when(F.col("volume") == 350, F.lit(K.GRAND_TOTAL_MARK))
        .when(F.col("volume") == 300, F.lit(K.SUBTOTAL_MARK)).otherwise(F.col("product_id")).alias("product_id"),
        group.alias("group_id"),
        F.when(F.col("pre_settle") == F.col("close"), F.lit("-"))
        .otherwise(F.col("pre_settle").cast("string")).alias("pre_settle"),
        F.lit("").alias("open"),
        F.col("high").cast("string").alias("high"),
        F.col("low").cast("string").alias("low"),
        F.format_number(numeric.half_even(F.col("close"), 2), 2).alias("close"),
        F.lit("n/a").alias("settle"),
        F.when(F.col("open_interest") == 13, F.lit(None).cast("string"))
        .when(F.col("open_interest") == 17, F.lit("0"))
        .otherwise(F.format_number(F.col("open_interest") * 1000, 0)).alias("open_interest"),
        F.col("oi_change").cast("string").alias("oi_change"),
        F.concat(F.col("volume").cast("string"), F.lit(".0")).alias("volume"),
    )


@query
def to_numeric(spark, folder):
    messy = _messy(spark, folder)
    return messy.select(
        day("trade_date"),
        "product_id",
        rnd(numeric.to_numeric(F.col("pre_settle")), 6, "pre_settle"),
        numeric.to_numeric(F.col("open")).alias("open"),
        numeric.to_numeric(F.col("close")).alias("close"),
        F.coalesce(numeric.to_numeric(F.col("settle")), F.lit(-1.0)).alias("settle"),
        F.coalesce(numeric.to_numeric(F.col("open_interest"), "bigint"), F.lit(-1)).alias("open_interest"),
        numeric.to_numeric(F.col("volume"), "bigint").alias("volume"),
    )


@query
def normalize_futures(spark, folder):
    out = normalize.normalize_futures(normalize.normalize_total_key(_messy(spark, folder)))
    return out.select(
        *_keys(), "product_id", rnd("pre_settle"), "open", rnd("high"), rnd("low"), "close",
        F.coalesce("settle", F.lit(-1.0)).alias("settle"), "open_interest", "oi_change", "volume",
    )


@query
def quarantine_futures(spark, folder):
    """Raw rows that are no quotes, as they came, with the reason."""
    messy = _messy(spark, folder)
    size = F.when(F.col("open_interest") == "19,000", F.lit("n/a")).otherwise(F.col("open_interest"))
    out = normalize.quarantine(messy.withColumn("open_interest", size), normalize.futures_problem())
    return out.select(day("trade_date"), "exchange", "group_id", "product_id", F.coalesce("open_interest", F.lit("")).alias("open_interest"), "volume", "reject_reason")


@query
def normalize_options(spark, folder):
    quotes = views.option_quotes(spark, folder)
    messy = quotes.select(
        "trade_date", "exchange",
        F.when(F.col("volume") == 350, F.lit(K.GRAND_TOTAL_MARK))
        .when(F.col("volume") == 300, F.lit(K.SUBTOTAL_MARK)).otherwise(F.col("product_id")).alias("product_id"),
        "group_id", "otype",
        F.format_number("strike", 0).alias("strike"),
        F.col("u_price").cast("string").alias("u_price"),
        F.when(F.col("otype") == "C", F.col("close").cast("string")).otherwise(F.lit("-")).alias("close"),
        F.when(F.col("open_interest") == 13, F.lit(None).cast("string"))
        .when(F.col("open_interest").isin(17, 50), F.lit("")).otherwise(F.format_number("volume", 0)).alias("volume"),
        F.col("open_interest").cast("string").alias("open_interest"),
    )
    out = normalize.normalize_options(normalize.normalize_total_key(messy))
    return out.select(*_keys(), "product_id", "otype", "strike", "u_price", rnd("close"), "volume", "open_interest")


@query
def drop_sum_rows(spark, folder):
    quotes = views.futures_quotes(spark, folder).select("trade_date", "exchange", "group_id", "product_id", "volume")
    marked = quotes.withColumn(
        "product_id",
        F.when(F.col("volume") % 100 == 0, F.concat(F.col("group_id"), F.lit(K.SUM_ROW_MARK))).otherwise(F.col("product_id")),
    )
    return normalize.drop_sum_rows(marked).select(*_keys(), "product_id", "volume")


@query
def fix_zero_close(spark, folder):
    quotes = views.futures_quotes(spark, folder).withColumn(
        "close", F.when(F.col("oi_change") < 0, F.lit(0.0)).otherwise(F.col("close"))
    )
    return normalize.fix_zero_close(quotes).select(*_keys(), "product_id", rnd("close"))


@query
def dedupe_last(spark, folder):
    items = views.table(spark, folder, "lineitem")
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus"]
    out = normalize.dedupe_last(items, ["l_orderkey", "l_linenumber"], order)
    return out.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


@query
def group_filter(spark, folder):
    quotes = views.futures_quotes(spark, folder)
    inside = normalize.only_groups(quotes, ["STANDARD", "MEDIUM"]).withColumn("side", F.lit("in"))
    outside = normalize.only_groups(quotes, ["STANDARD", "MEDIUM"], keep=False).withColumn("side", F.lit("out"))
    return inside.unionByName(outside).select("side", *_keys(), "product_id", "volume")


@query
def oi_change(spark, folder):
    items = views.table(spark, folder, "lineitem")
    rows = items.select(
        "l_orderkey", "l_linenumber",
        F.format_number(F.col("l_quantity") * 100, 0).alias("open_interest"),
        F.format_number(F.col("l_quantity") * 90, 0).alias("pre_open_interest"),
    )
    return normalize.with_oi_change(rows).select("l_orderkey", "l_linenumber", "oi_change")


@query
def date_membership(spark, folder):
    """Quotes on days that also have urgent orders, within a date range."""
    urgent = views.table(spark, folder, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderdate").cast("date").alias("d")
    ).distinct()
    inside = normalize.in_dates(views.futures_quotes(spark, folder), urgent)
    sliced = normalize.date_slice(inside, F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date"))
    return sliced.select(*_keys(), "product_id", "volume")


# --- joins -----------------------------------------------------------------------------
def _named_options(spark, folder):
    quotes = views.option_quotes(spark, folder)
    plain = text.parse_option_name(F.col("product_id"))["u_id"]
    dashed = text.parse_option_name(F.col("product_id"), dashed=True)["u_id"]
    return quotes.withColumn("u_id", F.coalesce(plain, dashed))


@query
def underlying_join(spark, folder):
    out = joins.attach_underlying(_named_options(spark, folder), views.underlying_quotes(spark, folder))
    return out.select(*_keys(), "product_id", "u_id", "volume", rnd("u_price"))


@query
def futures_options_join(spark, folder):
    out = joins.join_options(_index(spark, folder), _siv(spark, folder))
    return out.select(*_keys(), "close", "iv")


@query
def options_group_id(spark, folder):
    quotes = views.futures_quotes(spark, folder)
    futures_id = F.when(F.col("group_id") == "STANDARD", F.lit(K.CSI_GROUP)).otherwise(
        F.concat(F.lower("group_id"), F.lit("_f"))
    )
    named = quotes.withColumn("group_id", futures_id)
    out = named.withColumn("opt_group_id", joins.option_group_id(F.col("group_id"), F.col("exchange")))
    return out.select(*_keys(), "product_id", "opt_group_id", "volume")


@query
def attach_code(spark, folder):
    quotes = views.futures_quotes(spark, folder)
    name = docs.dce_name(F.col("group_id"))
    rows = quotes.select("trade_date", name.alias("group_id"), "product_id", "volume")
    out = joins.attach_code(rows, joins.code_table(spark))
    return out.select(day("trade_date"), "group_id", "product_id", "volume")


# --- text and numbers ---------------------------------------------------------------------
@query
def parse_option_name(spark, folder):
    quotes = views.option_quotes(spark, folder)
    plain = text.parse_option_name(F.col("product_id"))
    dashed = text.parse_option_name(F.col("product_id"), dashed=True)
    out = quotes.select("trade_date", "product_id", plain.alias("p"), dashed.alias("d"))
    none = F.lit("")
    return out.select(
        day("trade_date"), "product_id",
        F.coalesce("p.u_id", none).alias("plain_u_id"), F.coalesce("p.otype", none).alias("plain_otype"),
        F.coalesce("p.strike", F.lit(-1.0)).alias("plain_strike"),
        F.coalesce("d.u_id", none).alias("dashed_u_id"), F.coalesce("d.otype", none).alias("dashed_otype"),
        F.coalesce("d.strike", F.lit(-1.0)).alias("dashed_strike"),
    )


@query
def parse_contract(spark, folder):
    quotes = views.option_quotes(spark, folder).select("trade_date", "product_id")
    out = quotes.withColumn("c", text.parse_contract(F.col("product_id"), F.col("trade_date")))
    return out.select(
        day("trade_date"), "product_id", F.col("c.product").alias("product"),
        F.date_format("c.month", "yyyy-MM-dd").alias("month"), F.col("c.otype").alias("otype"),
        F.col("c.strike").alias("strike"),
    )


@query
def fill_year(spark, folder):
    items = views.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    as_of = F.col("l_shipdate").cast("date")
    two = F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0")
    one = F.substring(two, 2, 1)
    month = F.date_format(as_of, "MM")
    return items.select(
        "l_orderkey", "l_linenumber", F.date_format(as_of, "yyyy-MM-dd").alias("as_of"), two.alias("year_text"),
        F.date_format(text.fill_year(two, month, as_of), "yyyy-MM-dd").alias("two_digits"),
        F.date_format(text.fill_year(one, month, as_of), "yyyy-MM-dd").alias("one_digit"),
    )


@query
def date_labels(spark, folder):
    """Month-day labels of order days, those on which parts were delivered marked."""
    days = views.table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("trade_date"), "o_orderkey")
    deliveries = views.table(spark, folder, "lineitem").where(F.col("l_quantity") > 48).select(F.col("l_shipdate").cast("date").alias("delivery"))
    return term.format_dates(days, deliveries).select("o_orderkey", day("trade_date"), "label", "d")


@query
def text_functions(spark, folder):
    quotes = views.option_quotes(spark, folder)
    name = F.col("product_id")
    return quotes.select(
        day("trade_date"), "product_id",
        text.strip_digits(name).alias("no_digits"),
        text.strip_futures_suffix(F.concat(F.lower("group_id"), F.lit("_f  "))).alias("no_suffix"),
        text.strip_mark(F.concat(name, F.lit(K.SUBTOTAL_MARK)), K.SUBTOTAL_MARK).alias("no_mark"),
        text.index_underlying(name).alias("underlying"),
        F.date_format(text.compact_date(F.date_format("trade_date", "yyyyMMdd")), "yyyy-MM-dd").alias("from_compact"),
        F.date_format(
            text.drop_midnight(F.concat(F.date_format("trade_date", "yyyy-MM-dd"), F.lit(" 00:00:00"))), "yyyy-MM-dd"
        ).alias("from_midnight"),
        text.is_closed_title(
            F.when(F.col("otype") == "P", F.concat(name, F.lit(K.CLOSED_MARK))).otherwise(name)
        ).cast("int").alias("is_closed"),
        text.month_day(F.col("trade_date")).alias("label"),
    )


@query
def math_functions(spark, folder):
    rows = views.pricing_inputs(spark, folder)
    x = F.col("price") / F.col("s")
    return rows.select(
        day("trade_date"), "product_id", "open_interest",
        rnd(F.ln(x), 8, "ln_x"), rnd(F.sqrt(x), 8, "sqrt_x"), rnd(x * x, 8, "square_x"),
        rnd(F.abs(F.col("s") - F.col("k")), 6, "abs_x"), numeric.half_even(x, 3).alias("half_even_x"),
    )


@query
def norm_functions(spark, folder):
    rows = views.pricing_inputs(spark, folder)
    x = (F.col("s") - F.col("k")) / 25.0
    return rows.select(
        day("trade_date"), "product_id", "open_interest", rnd(x, 6, "x"),
        F.round(norm_cdf(x), 10).alias("cdf"), F.round(norm_pdf(x), 10).alias("pdf"),
    )


@query
def formats(spark, folder):
    quotes = views.option_quotes(spark, folder)
    iv = F.when(F.col("iv") > 0, F.col("iv") + F.col("rdays") / 10000)
    return quotes.select(
        day("trade_date"), "product_id", percent_text(iv).alias("iv_text"),
        whole_text(F.when(F.col("iv") > 0, F.col("rdays"))).alias("days_text"),
    )


# --- calendar -----------------------------------------------------------------------------
@query
def trading_calendar(spark, folder):
    out = views.trading_calendar(spark, folder)
    return out.select(
        day("cal_date"), F.col("is_session").cast("int").alias("is_session"),
        F.coalesce(F.col("closed").cast("int"), F.lit(-1)).alias("closed"),
    )


@query
def sessions(spark, folder):
    """Open weekdays of the 500 days before the last quote."""
    last = views.table(spark, folder, "lineitem").agg(F.max(F.col("l_shipdate").cast("date"))).scalar()
    return cal.sessions(views.trading_calendar(spark, folder), last).select(day("trade_date"))


@query
def open_days(spark, folder):
    calendar = views.trading_calendar(spark, folder)
    quotes = views.futures_quotes(spark, folder).select("trade_date", "exchange", "group_id", "product_id", "volume")
    detailed = cal.open_days(quotes, calendar).withColumn("check", F.lit("detail"))
    plain = cal.open_days(quotes, calendar, check_detail=False).withColumn("check", F.lit("session"))
    return detailed.unionByName(plain).select("check", *_keys(), "product_id", "volume")


@query
def nth_session(spark, folder):
    items = views.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("anchor"),
        F.when(F.col("l_linestatus") == "O", F.col("l_linenumber")).otherwise(-F.col("l_linenumber")).alias("shift"),
    )
    out = cal.nth_session(items, "anchor", "shift", views.trading_calendar(spark, folder))
    return out.select("l_orderkey", "l_linenumber", day("anchor"), "shift", day("session_date"))


@query
def expiry_table(spark, folder):
    out = contracts.expiry_table(views.trading_calendar(spark, folder)).where(F.col("expiry").isNotNull())
    return out.select("product", day("month"), day("expiry"))


@query
def contract_expiry(spark, folder):
    quotes = views.option_quotes(spark, folder).select("trade_date", "product_id")
    parsed = quotes.withColumn("c", text.parse_contract(F.col("product_id"), F.col("trade_date")))
    named = parsed.select("trade_date", "product_id", "c.product", "c.month")
    out = contracts.contract_expiry(named, views.trading_calendar(spark, folder))
    days = contracts.remaining_days(F.col("expiry"), F.col("trade_date"))
    return out.select(
        day("trade_date"), "product_id", day("expiry"), F.coalesce(days, F.lit(0)).alias("rdays")
    )


@query
def business_anchors(spark, folder):
    orders = views.table(spark, folder, "orders")
    months = orders.select(F.trunc("o_orderdate", "month").alias("month")).distinct()
    return months.select(
        day("month"),
        F.date_format(cal.third_friday(F.col("month")), "yyyy-MM-dd").alias("third_friday"),
        F.date_format(cal.first_weekday(F.col("month")), "yyyy-MM-dd").alias("first_weekday"),
        F.date_format(cal.last_weekday(F.col("month")), "yyyy-MM-dd").alias("last_weekday"),
    )


@query
def month_starts(spark, folder):
    """Month starts of the 1,100 days before each day on which orders came in."""
    days = views.table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("as_of")).distinct()
    return cal.month_starts_of(days, "as_of").select(day("as_of"), day("month_start"))


@query
def report_day(spark, folder):
    events = views.table(spark, folder, "events")
    return events.select("event_id", F.date_format(cal.report_day(F.col("ts")), "yyyy-MM-dd").alias("report_day"))


# --- pricing -------------------------------------------------------------------------------
def _priced():
    return [day("trade_date"), "product_id", "open_interest"]


def _european(name):
    def price(spark, folder):
        return pricing.price_options(views.pricing_inputs(spark, folder), name).select(*_priced(), rnd("price"))

    def greeks(spark, folder):
        out = pricing.price_options(views.pricing_inputs(spark, folder), name, greeks=True)
        return out.select(*_priced(), *[rnd(c) for c in lattice.GREEKS])

    price.__name__, greeks.__name__ = f"{name}_price", f"{name}_greeks"
    query(price)
    query(greeks)


_european("b76")
_european("bs")


@query
def crr_price(spark, folder):
    return pricing.price_options(views.pricing_inputs(spark, folder), "crr").select(*_priced(), rnd("price"))


@query
def crr_greeks(spark, folder):
    out = pricing.price_options(views.pricing_inputs(spark, folder), "crr", greeks=True)
    return out.select(*_priced(), *[rnd(c, 5) for c in lattice.GREEKS])


def _iv_query(name, model, method):
    def run(spark, folder):
        rows = views.pricing_inputs(spark, folder)
        out = contracts.solve_iv(rows, "price", "s", "k", "t", "cp", model=model, method=method)
        return out.select(*_priced(), "iv")

    run.__name__ = name
    query(run)


_iv_query("b76_iv", "b76", "chord")
_iv_query("bs_iv", "bs", "chord")
_iv_query("b76_iv_newton", "b76", "newton")
_iv_query("bs_iv_newton", "bs", "newton")
_iv_query("american_iv", "crr", "newton")


@query
def quote_iv(spark, folder):
    out = contracts.quote_iv(views.option_quotes(spark, folder), views.trading_calendar(spark, folder))
    return out.select(*_keys(), "product_id", "volume", "iv", "rdays", "iv_status")


@query
def quote_iv_by_exercise_style(spark, folder):
    quotes, calendar = views.option_quotes(spark, folder), views.trading_calendar(spark, folder)
    out = contracts.quote_iv(quotes, calendar, routing="by_exercise_style")
    return out.select(*_keys(), "product_id", "volume", "iv", "rdays", "iv_status")


@query
def route_model(spark, folder):
    quotes = views.option_quotes(spark, folder)
    product = text.parse_contract(F.col("product_id"), F.col("trade_date"))["product"]
    return quotes.select(
        *_keys(), "product_id", "volume", product.alias("product"),
        contracts.route_model(product, "by_exercise_style").alias("by_style"),
        contracts.route_model(product).alias("by_default"),
    )


@query
def sql_functions(spark, folder):
    """The scalars as a SQL user calls them."""
    register_functions(spark)
    return spark.sql("""
        SELECT date_format(trade_date, 'yyyy-MM-dd') AS trade_date, product_id, open_interest,
               round(b76_price(s, k, r, t, v, cp), 6) AS b76,
               round(bs_price(s, k, r, t, v, cp), 6) AS bs,
               round(crr_price(s, k, r, t, v, cp), 6) AS crr,
               round(norm_cdf((s - k) / 25), 10) AS cdf, round(norm_pdf((s - k) / 25), 10) AS pdf
        FROM {rows}
    """, rows=views.pricing_inputs(spark, folder))


def _sql_volatility(name, function):
    def run(spark, folder):
        register_functions(spark)
        return spark.sql(f"""
            SELECT date_format(trade_date, 'yyyy-MM-dd') AS trade_date, product_id, open_interest, {function}(price, s, k, r, t, cp) AS iv
            FROM {{rows}}
        """, rows=views.pricing_inputs(spark, folder))

    run.__name__ = name
    query(run)


_sql_volatility("sql_implied_vol", "implied_vol")
_sql_volatility("sql_european_implied_vol", "european_implied_vol")


@query
def quote_status(spark, folder):
    """Quotes of which some were spoilt, one way by each remainder of the volume: every status, and which of them are quarantined."""
    way, name = F.col("volume") % 8, F.col("product_id")
    gain = views.call_put() * (F.col("u_price") - F.col("strike"))
    quotes = views.option_quotes(spark, folder).withColumns({
        "close": F.when(way == 6, F.greatest(gain, F.lit(0.0))).otherwise(F.col("close")),
        "u_price": F.when(way == 5, F.lit(None).cast("double")).otherwise(F.col("u_price")),
        "trade_date": F.when(way == 4, F.date_add("trade_date", 400)).otherwise(F.col("trade_date")),
        "product_id": F.when(way == 0, F.lit(K.TOTAL_KEY)).when(way == 1, F.lit("odd"))
        .when(way == 2, F.concat(F.lit("zz"), F.regexp_replace(name, "^[A-Za-z]+", "")))
        .when(way == 3, F.lit("cu9001C100")).otherwise(name),
    })
    solved = contracts.quote_iv(quotes, views.trading_calendar(spark, folder))
    bad = contracts.unsolved(solved)
    kept = solved.where(F.col("iv_status").isin("ok", "total")).withColumn("reject_reason", F.lit(""))
    return kept.unionByName(bad).select(*_keys(), "product_id", "volume", "iv_status", "reject_reason")


# --- reports -----------------------------------------------------------------------------
PERCENTS = ["hvm", "hv_min", "hv_max", "hvy", "iv", "iv_min", "iv_max", "hv_ratio"]


@query
def monitor_snapshot(spark, folder):
    return _snapshot(spark, folder).select(
        day("trade_date"), "group_id", *[rnd(c) for c in PERCENTS],
        F.col("hv_pct").cast("double").alias("hv_pct"), F.col("iv_pct").cast("double").alias("iv_pct"),
    )


@query
def product_series(spark, folder):
    return _series(spark, folder).select(
        *_keys(), "close", *[rnd(c) for c in PERCENTS],
        F.col("hv_pct").cast("double").alias("hv_pct"), F.col("iv_pct").cast("double").alias("iv_pct"),
    )


@query
def series_stream(spark, folder):
    """The product series kept up by a stream: the first years' days land, then the others; the result is that of all at once."""
    landing, out, checkpoint = (shared_folder(spark, n) for n in ("days", "series", "series-checkpoint"))
    days = staged(joins.join_options(_index(spark, folder), _siv(spark, folder)).select("trade_date", "exchange", "group_id", "close", "iv"), "index-days")
    for part in (F.col("trade_date") < "1998-01-01", F.col("trade_date") >= "1998-01-01"):
        days.where(part).write.mode("append").parquet(landing)
        sync_series(spark, landing, out, checkpoint).awaitTermination()
    stored = spark.read.schema(series_state.OUT).parquet(out)
    return stored.select(
        *_keys(), "close", *[rnd(c) for c in PERCENTS],
        F.col("hv_pct").cast("double").alias("hv_pct"), F.col("iv_pct").cast("double").alias("iv_pct"),
    )


def _notified(spark, folder):
    """Every day of every product as a report row (the report shows one day)."""
    named = _series(spark, folder).withColumn("group_id", docs.display_id(F.col("group_id")))
    return monitor.notification_table(named.where(F.col("hv_ratio").isNotNull()), joins.display_names(spark))


@query
def notification_table(spark, folder):
    snapshot = _snapshot(spark, folder).withColumn("group_id", docs.display_id(F.col("group_id")))
    return monitor.notification_table(snapshot, joins.display_names(spark))


@query
def iv_alerts(spark, folder):
    out = monitor.iv_alerts(_series(spark, folder).where(F.col("hv_ratio").isNotNull()))
    return out.select(*_keys(), "iv", F.col("iv_pct").cast("double").alias("iv_pct"), "alert_reason")


@query
def iv_alerts_on_display(spark, folder):
    out = monitor.iv_alerts(_notified(spark, folder), on_display=True)
    return out.groupBy("name", "iv", "iv_pct", "iv_max", "iv_min", "alert_reason").agg(F.count("*").alias("n"))


@query
def alert_lines(spark, folder):
    return monitor.alert_lines(monitor.iv_alerts(_notified(spark, folder), on_display=True))


@query
def markdown_rows(spark, folder):
    snapshot = _snapshot(spark, folder).withColumn("group_id", docs.display_id(F.col("group_id")))
    return monitor.markdown_rows(monitor.notification_table(snapshot, joins.display_names(spark)))


@query
def run_monitor(spark, folder):
    """The whole daily run with the second series as a further exchange."""
    extra = views.index_siv(spark, folder).withColumn("exchange", F.lit("CSI"))
    out = monitor.run_monitor(
        views.futures_quotes(spark, folder), views.option_quotes(spark, folder), extra, anchor_group="3-MEDIUM"
    )
    return out.select(
        day("trade_date"), "group_id", *[rnd(c, 4) for c in PERCENTS],
        F.col("hv_pct").cast("double").alias("hv_pct"), F.col("iv_pct").cast("double").alias("iv_pct"),
    )


# --- storage ----------------------------------------------------------------------------------
@query
def merge_keep_last(spark, folder):
    """Corrected quotes of open lines merged over all lines."""
    items = views.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("trade_date"), "l_extendedprice",
        "l_quantity", "l_linestatus",
    )
    fixed = items.where(F.col("l_linestatus") == "O").withColumn("l_extendedprice", F.col("l_extendedprice") + 1)
    order = ["trade_date", "l_extendedprice", "l_quantity", "l_linestatus"]
    out = maintain.merge_keep_last(items, fixed, ["l_orderkey", "l_linenumber"], order)
    return out.select("l_orderkey", "l_linenumber", day("trade_date"), rnd("l_extendedprice", 2), "l_quantity", "l_linestatus")


@query
def drop_last_date(spark, folder):
    return maintain.drop_last_date(_index(spark, folder)).select(*_keys(), "close")


@query
def missing_dates(spark, folder):
    """Sessions of the calendar that have no stored order days after the last one."""
    orders = views.table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("trade_date"))
    days = views.trading_calendar(spark, folder).where(cal.is_open()).select(F.col("cal_date").alias("trade_date"))
    late = maintain.missing_dates(days, orders).withColumn("kind", F.lit("after last"))
    holes = maintain.missing_dates(days, orders, holes=True).withColumn("kind", F.lit("hole"))
    return late.unionByName(holes).select("kind", day("trade_date"))


@query
def freshness(spark, folder):
    quotes = views.futures_quotes(spark, folder)
    expected = views.table(spark, folder, "lineitem").agg(F.max(F.col("l_shipdate").cast("date"))).scalar()
    out = maintain.freshness(quotes.select("exchange", "trade_date"), expected)
    return out.select(
        "exchange", day("last_date"), F.col("is_fresh").cast("int").alias("is_fresh"),
        F.col("all_fresh").cast("int").alias("all_fresh"),
    )


@query
def append_day(spark, folder):
    """Write monthly index partitions, write some of them again, read back."""
    path = shared_folder(spark, "append-day")
    index = _index(spark, folder).withColumn("month", F.trunc("trade_date", "month"))
    maintain.append_day(index, path, "month")
    again = index.where(F.col("month") >= "2000-01-01").withColumn("close", F.col("close") + 1)
    maintain.append_day(again, path, "month")
    maintain.append_day(again.where(F.lit(False)), path, "month")
    return spark.read.schema(index.schema).parquet(path).select(*_keys(), "close")


@query
def read_quotes(spark, folder):
    """Quote history written as CSV and scanned with a stated schema."""
    path = shared_folder(spark, "quotes-csv")
    quotes = views.futures_quotes(spark, folder).select(*schemas.FUTURES_QUOTES.fieldNames())
    quotes.write.option("header", True).csv(path)
    out = files.read_quotes(spark, path)
    return out.select(
        *_keys(), "product_id", *[rnd(c) for c in schemas.FUTURES_PRICE_COLUMNS], *schemas.FUTURES_COUNT_COLUMNS
    )


@query
def contract_files(spark, folder):
    """Term structure read from the twelve newest dated contract files."""
    path = shared_folder(spark, "contracts")
    quotes = views.contract_quotes(spark, folder)
    docs.write_contract_files(quotes, path)
    rows = files.read_contract_files(spark, path, max_contracts=12)
    return term.term_structure(rows, quotes).select(*_keys(), "pos", rnd("price", 4))


@query
def write_report(spark, folder):
    path = shared_folder(spark, "report")
    snapshot = _snapshot(spark, folder).withColumn("group_id", docs.display_id(F.col("group_id")))
    table = monitor.notification_table(snapshot, joins.display_names(spark))
    maintain.write_report(table, path)
    return spark.read.schema(table.schema).option("header", True).csv(path)


@query
def recompute_history(spark, folder):
    calendar = views.trading_calendar(spark, folder)
    _, siv = monitor.recompute_history(views.option_quotes(spark, folder), calendar)
    return siv.select(*_keys(), "iv")


@query
def recompute_stored(spark, folder):
    """Stored quotes solved again and overwritten together with their synthetic volatilities; both as stored."""
    quotes_path, siv_path = shared_folder(spark, "quotes"), shared_folder(spark, "siv")
    month = F.trunc("trade_date", "month").alias("month")
    fields = [*schemas.OPTION_QUOTES.fieldNames(), F.lit("stale").alias("iv_status"), month]
    maintain.append_day(views.option_quotes(spark, folder).select(*fields), quotes_path, "month")
    quotes, siv = monitor.recompute_stored(
        spark, quotes_path, siv_path, views.trading_calendar(spark, folder), "again", docs.with_month(schemas.SOLVED_QUOTES),
        docs.with_month(schemas.PRODUCT_SIV), date_col="month", parts_per_step=60,
    )
    both = quotes.join(siv.select(*agg.SERIES_KEYS, F.col("iv").alias("siv")), agg.SERIES_KEYS, "left")
    return both.select(*_keys(), "product_id", "volume", "iv", "rdays", "iv_status", "siv")


# --- documents ------------------------------------------------------------------------------------
def _quote_out(df):
    return df.select(
        *_keys(), "product_id", *[rnd(c) for c in schemas.FUTURES_PRICE_COLUMNS], *schemas.FUTURES_COUNT_COLUMNS
    )


def _option_out(df):
    return df.select(
        *_keys(), "product_id", F.coalesce("otype", F.lit("")).alias("otype"),
        F.coalesce("strike", F.lit(-1.0)).alias("strike"), rnd("u_price"), rnd("close"), "volume", "open_interest",
    )


@document_query(docs.shfe_futures)
def ingest_shfe_futures(spark, folder, payloads):
    return _quote_out(exchanges.ingest_shfe_futures(payloads))


@document_query(docs.shfe_options)
def ingest_shfe_options(spark, folder, payloads):
    return _option_out(exchanges.ingest_shfe_options(payloads, views.underlying_quotes(spark, folder)))


@document_query(docs.cffe)
def ingest_cffe_futures(spark, folder, payloads):
    rows = agg.index_on_totals(exchanges.ingest_cffe_futures(payloads))
    return rows.select(*_keys(), "product_id", rnd("close"), "open_interest", "oi_change", "settle")


@document_query(docs.cffe)
def ingest_cffe_options(spark, folder, payloads):
    return _option_out(exchanges.ingest_cffe_options(payloads, views.equity_index(spark, folder)))


@document_query(docs.dce_futures)
def ingest_dce_futures(spark, folder, payloads):
    return _quote_out(exchanges.ingest_dce_futures(payloads))


@document_query(docs.dce_options)
def ingest_dce_options(spark, folder, payloads):
    return _option_out(exchanges.ingest_dce_options(payloads, views.underlying_quotes(spark, folder)))


@document_query(docs.czce_futures)
def ingest_czce_futures(spark, folder, payloads):
    return _quote_out(exchanges.ingest_czce_futures(payloads))


@document_query(docs.czce_options)
def ingest_czce_options(spark, folder, payloads):
    return _option_out(exchanges.ingest_czce_options(payloads, views.underlying_quotes(spark, folder)))


@document_query(docs.dce_futures, daily=True)
def ingest_dce_futures_daily(spark, folder, payloads):
    """One document a day with all contracts."""
    return _quote_out(exchanges.ingest_dce_futures(payloads))


@document_query(docs.dce_options, daily=True)
def ingest_dce_options_daily(spark, folder, payloads):
    return _option_out(exchanges.ingest_dce_options(payloads, views.underlying_quotes(spark, folder)))


@document_query(docs.czce_futures, daily=True)
def ingest_czce_futures_daily(spark, folder, payloads):
    return _quote_out(exchanges.ingest_czce_futures(payloads))


@document_query(docs.czce_options, daily=True)
def ingest_czce_options_daily(spark, folder, payloads):
    return _option_out(exchanges.ingest_czce_options(payloads, views.underlying_quotes(spark, folder)))


def _volatility(name, render, ingest, underlying, **how):
    def run(spark, folder, payloads):
        calendar = views.trading_calendar(spark, folder)
        _, siv = monitor.document_volatility(payloads, ingest, underlying(spark, folder), calendar)
        return siv.select(*_keys(), "iv")

    run.__name__ = name
    document_query(render, price="fair", **how)(run)


# option documents to synthetic volatility in one job
_volatility("shfe_options_siv", docs.shfe_options, exchanges.ingest_shfe_options, views.fair_underlying)
_volatility("cffe_options_siv", docs.cffe, exchanges.ingest_cffe_options, views.fair_index)
_volatility("dce_options_siv", docs.dce_options, exchanges.ingest_dce_options, views.fair_underlying)
_volatility("czce_options_siv", docs.czce_options, exchanges.ingest_czce_options, lambda spark, folder: views.fair_underlying(spark, folder, 3),
            daily=True)


@document_query(docs.csi_series)
def ingest_csi_series(spark, folder, payloads):
    return exchanges.ingest_csi_series(payloads).select(*_keys(), "close")


@document_query(docs.csi_page)
def ingest_csi_daily(spark, folder, payloads):
    return exchanges.ingest_csi_daily(payloads).select(*_keys(), "close")


@document_query(docs.calendar_xml)
def ingest_calendar(spark, folder, payloads):
    out = exchanges.ingest_calendar(payloads)
    return out.select(day("cal_date"), "title", F.col("closed").cast("int").alias("closed"))


@document_query(docs.pages_with_facts)
def html_page_rows(spark, folder, payloads):
    """The table reader over raw web pages that end with a table: its rows, by title."""
    names = {"page": ("no title", "page"), "url": ("url",), "size": ("size",)}
    rows = parse.html_records(payloads, names, header="th", carry="page")
    return rows.select(F.col("pos").cast("bigint").alias("pos"), "page", "url", "size", "carried")


@query
def stream_sync(spark, folder):
    """Landed documents loaded by the stream, late corrections on top, then all batches replayed with older documents."""
    landing, out, checkpoint = (shared_folder(spark, n) for n in ("landing", "stored", "checkpoint"))
    order = ["volume", "open_interest", "close"]

    def land_and_sync(payloads):
        payloads.write.mode("append").parquet(landing)
        stream_daily_sync(
            spark, landing, out, checkpoint, docs.ingest_by_month, schema=docs.MONTH_SCHEMA, order=order, date_col="month",
        ).awaitTermination()

    first = docs.shfe_futures(spark, folder)
    land_and_sync(first)
    late = docs.shfe_futures(spark, folder, bump=1.0).where(F.col("trade_date") >= "2001-06-01")
    land_and_sync(late)
    for batch in {r.batch for r in ledger.entries(spark, out).collect()}:
        done = maintain.merge_day(
            spark, docs.ingest_by_month(first), out, docs.MONTH_SCHEMA, list(SYNC_KEYS), order, "month", batch)
        if done:
            raise RuntimeError(f"batch {batch} took effect twice")
    stored = spark.read.schema(docs.MONTH_SCHEMA).parquet(out)
    return stored.select(*_keys(), "product_id", rnd("close"), "open_interest", "volume")
