"""What is left out has a reason, and nothing is lost on the way."""

import datetime

from pyspark.sql import functions as F

from voltide import constants as K
from voltide.operators import contracts, joins, normalize, term
from voltide.plans import monitor
from voltide.sources import exchanges

DAY = datetime.date(2021, 1, 5)


def test_kept_and_quarantined_futures_make_up_the_input(spark):
    sizes = ["1,200", "5", "-", "", "0", "-3", "n/a", None, "12.0", "7"]
    rows = [(DAY, "X", f"c{i}", "g ", *["1"] * 6, s, "1", "1") for i, s in enumerate(sizes)]
    rows += [(DAY, "X", K.GRAND_TOTAL_MARK, "g", *["1"] * 6, "5", "1", "1"), (DAY, "X", "c", K.GRAND_TOTAL_MARK, *["1"] * 6, None, "1", "1"),
             (DAY, "X", None, None, *["1"] * 6, "5", "1", "1"), (None, None, "c1", "g", *["1"] * 6, "n/a", "1", "1")]
    names = ["pre_settle", "open", "high", "low", "close", "settle", "open_interest", "oi_change", "volume"]
    raw = spark.createDataFrame(rows, "trade_date date, exchange string, product_id string, group_id string, " + ", ".join(f"{n} string" for n in names))
    kept, bad = normalize.normalize_futures(raw), normalize.quarantine(raw, normalize.futures_problem())
    assert kept.count() + bad.count() == len(rows) and bad.columns == [*raw.columns, "reject_reason"]
    got = sorted((r.product_id or "", r.open_interest or "", r.reject_reason) for r in bad.collect())
    assert got == sorted([("c2", "-", "no_open_interest"), ("c3", "", "no_open_interest"), ("c4", "0", "no_open_interest"), ("c5", "-3", "no_open_interest"),
                          ("c6", "n/a", "unreadable_open_interest"), ("c7", "", "missing_open_interest"), (K.GRAND_TOTAL_MARK, "5", "grand_total"),
                          ("c", "", "grand_total"), ("c1", "n/a", "unreadable_open_interest")])
    assert normalize.quarantine(raw.limit(0), normalize.futures_problem()).count() == 0


def test_kept_and_quarantined_options_make_up_the_input(spark):
    rows = [("c1", "g", "3"), ("c2", "g", "0"), ("c3", "g", "x"), ("c4", "g", None), (K.TOTAL_KEY, "g", "0"), (K.TOTAL_KEY, "g", "x"), (K.GRAND_TOTAL_MARK, "g", "9"), (None, "g", "4")]
    raw = spark.createDataFrame([(DAY, "X", p, g, "C", "1", "1", "1", v, "1") for p, g, v in rows],
                                "trade_date date, exchange string, product_id string, group_id string, otype string, strike string, u_price string, close string, "
                                "volume string, open_interest string")
    kept, bad = normalize.normalize_options(raw), normalize.quarantine(raw, normalize.options_problem())
    assert sorted((r.product_id, r.reject_reason) for r in bad.collect()) == sorted(
        [("c2", "no_volume"), ("c3", "unreadable_volume"), ("c4", "missing_volume"), (K.GRAND_TOTAL_MARK, "grand_total")])
    assert kept.count() + bad.count() == len(rows) and kept.where("product_id = 'total'").count() == 2


def test_every_status_but_two_is_quarantined(spark, calendar):
    rows = [("cu2103C57000", 58810.0, 2220.0), ("total", 1.0, 1.0), ("odd", 1.0, 1.0), ("zz2103C1", 1.0, 1.0), ("cu9901C1", 1.0, 1.0), ("cu2012C57000", 58810.0, 2220.0),
            ("cu2103C57000", None, 2220.0), ("cu2103C57000", 58810.0, 0.0), ("cu2103C57000", 58810.0, 1000.0)]
    quotes = spark.createDataFrame([(DAY, p, u, c) for p, u, c in rows], "trade_date date, product_id string, u_price double, close double")
    solved = contracts.quote_iv(quotes, calendar)
    assert sorted(r.reject_reason for r in contracts.unsolved(solved).collect()) == [
        "below_intrinsic", "expired", "no_calendar", "no_price", "no_price", "unparsed", "unsupported_product"]
    assert solved.where("iv_status IN ('ok', 'total')").count() == 2


def test_one_contract_id_on_two_exchanges(spark):
    options = spark.createDataFrame([(DAY, "A", "x1"), (DAY, "B", "x1"), (DAY, "C", "x1")], "trade_date date, exchange string, u_id string")
    under = spark.createDataFrame([(DAY, "A", "x1", 1.0, 5), (DAY, "A", "x1", 3.0, 2), (DAY, "B", "x1", 2.0, 1), (DAY, "A", "total", 9.0, 9)],
                                  "trade_date date, exchange string, product_id string, close double, seq int")
    got = lambda frame: {r.exchange: r.u_price for r in frame.collect()}
    assert got(joins.attach_underlying(options, under)) == {"A": 3.0, "B": 2.0, "C": None}
    assert got(joins.attach_underlying(options, under, order=["seq"])) == {"A": 1.0, "B": 2.0, "C": None}
    assert got(joins.attach_underlying(options, under.drop("exchange"))) == {"A": 3.0, "B": 3.0, "C": 3.0}
    index = under.withColumnsRenamed({"product_id": "group_id"})
    assert got(joins.attach_underlying(options, index, "group_id")) == {"A": 3.0, "B": 3.0, "C": 3.0}


def test_delivery_days_are_marked(spark):
    days = spark.createDataFrame([(DAY, "x"), (DAY + datetime.timedelta(days=1), "y"), (None, "z")], "trade_date date, d string")
    deliveries = spark.createDataFrame([(DAY,), (DAY,), (None,)], "delivery date")
    assert sorted((r.label or "", r.d) for r in term.format_dates(days, deliveries).collect()) == [("", ""), ("0105", "d"), ("0106", "")]
    assert {r.d for r in term.format_dates(days).collect()} == {""}


def test_documents_to_volatility(spark, calendar):
    from test_sources import html, payloads

    titles = list(exchanges.DCE_OPTIONS)
    rows = [["c2105-C-2700", "玉米", "120", "3", "1,2"], ["c2105-P-2700", "玉米", "100", "3", "9"], ["", "玉米小计", "", "3", "0"], ["", "总计", "", "", ""]]
    under = spark.createDataFrame([(DAY, "c2105", 2700.0)], "trade_date date, product_id string, close double")
    quotes, siv = monitor.document_volatility(payloads(spark, html(titles, rows, False)), exchanges.ingest_dce_options, under, calendar)
    solved = {r.product_id: (r.iv, r.iv_status) for r in quotes.collect()}
    assert solved["total"] == (0.0, "total") and solved["c2105-C-2700"][1] == "ok" and 0.1 < solved["c2105-C-2700"][0] < 0.5
    one = siv.first()
    assert one.group_id == "玉米" and solved["c2105-P-2700"][0] - 1e-3 <= one.iv <= solved["c2105-C-2700"][0] + 1e-3 and siv.count() == 1
    assert siv.where(F.col("iv").isNull()).count() == 0
