import datetime

import pytest
from pyspark.sql import functions as F

from voltide.functions import text
from voltide.operators import aggregate, calendar as cal, contracts

# --- fixed values: contract -> expiry date ---------------------------------------------
EXPIRIES = [
    ("IO2106C5000", "2021-06-18"), ("IO2106-C-5000", "2021-06-18"), ("IO1802P3500", "2018-02-22"),
    ("IO1802-P-3500", "2018-02-22"), ("m1803-C-2400", "2018-02-07"), ("m1903-C-2400", "2019-02-14"),
    ("m2201-P-3900", "2021-12-07"), ("c1905-C-1660", "2019-04-08"), ("i2002-C-580", "2020-01-08"),
    ("i2011-P-630", "2020-10-15"), ("pg2011-C-2100", "2020-10-15"), ("pg2101-C-2900", "2020-12-07"),
    ("l2009-C-6000", "2020-08-07"), ("l2011-P-5900", "2020-10-15"), ("v2010-P-7000", "2020-09-07"),
    ("v2011-C-7600", "2020-10-15"), ("pp2011-P-7600", "2020-10-15"), ("pp2101-P-7600", "2020-12-07"),
    ("pp2103-P-7600", "2021-02-05"), ("pp2105-P-7600", "2021-04-08"), ("TA101C3300", "2020-12-03"),
    ("CF905C12000", "2019-04-03"), ("CF907P13000", "2019-06-05"), ("CF011C12200", "2020-10-13"),
    ("SR801C4500", "2017-11-24"), ("SR803P5000", "2018-01-25"), ("SR907C4800", "2019-05-27"),
    ("SR909P4800", "2019-08-05"), ("MA006C2000", "2020-05-08"), ("TA006C3500", "2020-05-08"),
    ("CF101P13500", "2020-12-03"), ("SR101C5000", "2020-12-03"), ("RM101C2500", "2020-12-03"),
    ("MA101P2200", "2020-12-03"), ("TA101C3800", "2020-12-03"), ("ZC101P750", "2020-12-03"),
    ("ZC106P750", "2021-05-10"), ("cu2002C48000", "2020-01-20"), ("cu2103C48000", "2021-02-22"),
    ("cu2104P44000", "2021-03-25"), ("cu2101C34000", "2020-12-25"), ("al2102C14400", "2021-01-25"),
    ("zn2105P23000", "2021-04-26"), ("au2004C316", "2020-03-25"), ("au2008P360", "2020-07-27"),
    ("ru2103C10000", "2021-02-22"), ("sc2109C440", "2021-08-13"),
]
# --- fixed values: contract, day, remaining days -----------------------------------------
REMAINING = [
    ("IO2102C5000", "2021-01-22", 29), ("IO2106C5000", "2021-01-22", 148), ("cu2103C57000", "2021-01-22", 32),
    ("au2104P396", "2021-01-22", 63), ("pp2105C7700", "2021-01-22", 77), ("SR103C5000", "2021-01-22", 13),
    ("ZC105C700", "2021-04-06", 1),
]
AS_OF = datetime.date(2022, 6, 1)


def test_expiry_anchors(spark, calendar):
    df = spark.createDataFrame([(n, e) for n, e in EXPIRIES], "name string, want string")
    parsed = df.withColumn("c", text.parse_contract(F.col("name"), F.lit(AS_OF))).select("name", "want", "c.*")
    out = contracts.contract_expiry(parsed, calendar).collect()
    assert len(out) == len(EXPIRIES)
    assert {r.name: str(r.expiry) for r in out} == dict(EXPIRIES)


def test_remaining_days(spark, calendar):
    df = spark.createDataFrame(REMAINING, "name string, d string, want int").withColumn("d", F.to_date("d"))
    parsed = df.withColumn("c", text.parse_contract(F.col("name"), F.col("d"))).select("name", "d", "want", "c.*")
    out = contracts.contract_expiry(parsed, calendar).withColumn(
        "days", contracts.remaining_days(F.col("expiry"), F.col("d"))
    )
    assert all(r.days == r.want for r in out.collect())


# --- fixed values: year and month digits, look-ahead in days, date (on 2026-12-01) ---------
FILLED = [
    ("9", "01", 732, "2019-01-01"), ("8", "05", 732, "2018-05-01"), ("0", "09", 732, "2020-09-01"),
    ("1", "12", 732, "2021-12-01"), ("19", "05", 732, "2019-05-01"), ("21", "01", 732, "2021-01-01"),
    ("00", "01", 365 * 80, "2100-01-01"), ("99", "05", 365 * 80, "2099-05-01"),
]


def test_fill_year(spark):
    day = F.lit(datetime.date(2026, 12, 1))
    for year, month, delta, want in FILLED:
        got = spark.range(1).select(text.fill_year(F.lit(year), F.lit(month), day, delta).alias("d")).first().d
        assert str(got) == want
    bad = spark.range(1).select(text.fill_year(F.lit("21"), F.lit("13"), day).alias("d")).first().d
    assert bad is None


def test_parse_names(spark):
    names = ["cu2103C57000", "IO2106-C-5400", "白糖2103P5", "nothing", None, "m2105-P-", "cu2103C57000x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    out = df.select(
        "n", text.parse_option_name(F.col("n")).alias("p"), text.parse_option_name(F.col("n"), True).alias("d"),
        text.parse_contract(F.col("n"), F.lit(AS_OF)).alias("c"),
    ).collect()
    by = {r.n: r for r in out}
    assert tuple(by["cu2103C57000"].p) == ("cu2103", "C", 57000.0)
    assert tuple(by["IO2106-C-5400"].d) == ("IO2106", "C", 5400.0)
    assert tuple(by["IO2106-C-5400"].p) == (None, None, None)
    assert by["白糖2103P5"].p.u_id == "白糖2103"
    assert tuple(by["IO2106-C-5400"].c) == ("IO", datetime.date(2021, 6, 1), "C", 5400.0)
    for bad in ("nothing", None, "m2105-P-", "cu2103C57000x"):
        assert tuple(by[bad].c) == (None, None, None, None)


def test_calendar_days(spark, calendar):
    days = ["2018-01-01", "2020-10-08", "2020-01-31", "2021-01-01", "2021-01-02", "2021-01-04"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("trade_date"))
    assert [str(r[0]) for r in cal.open_days(df, calendar).collect()] == ["2021-01-04"]
    plain = cal.open_days(df, calendar, check_detail=False).orderBy("trade_date").collect()
    assert [str(r[0]) for r in plain] == ["2020-01-31", "2021-01-04"]
    span = [str(r[0]) for r in cal.sessions(calendar, "2020-10-12", 20).orderBy("trade_date").collect()]
    assert span[0] == "2020-09-22" and span[-2:] == ["2020-10-09", "2020-10-12"] and "2020-10-08" not in span


def test_nth_session_against_walk(spark, calendar):
    rows = {r.cal_date: r for r in calendar.collect()}
    one = datetime.timedelta(days=1)

    def walk(day, n):
        left, step = abs(n), one if n > 0 else -one
        while True:
            r = rows[day]
            if r.is_session and not (n > 0 and r.closed):
                left -= 1
            if left == 0:
                return day
            day += step

    start = datetime.date(2018, 3, 1)
    cases = [(start + datetime.timedelta(days=5 * i), n) for i in range(200) for n in (-13, -5, -1, 1, 3, 5)]
    df = spark.createDataFrame(cases, "a date, n int")
    for r in cal.nth_session(df, "a", "n", calendar).collect():
        assert r.session_date == walk(r.a, r.n)


def test_month_starts_and_report_day(spark):
    months = [str(r[0]) for r in cal.month_starts(spark, "2021-03-15", 60).orderBy("month_start").collect()]
    assert months == ["2021-02-01", "2021-03-01"]
    df = spark.sql("SELECT timestamp'2021-03-15 07:59:00' a, timestamp'2021-03-15 08:00:00' b")
    row = df.select(cal.report_day(F.col("a")).alias("a"), cal.report_day(F.col("b")).alias("b")).first()
    assert (str(row.a), str(row.b)) == ("2021-03-14", "2021-03-15")


# --- fixed values: one day of options (name, strike, close, volume, given volatility) -------
OPTIONS = [
    ("cu2103C30", 30.0, 4.5, 50, 0.34), ("cu2103C35", 35.0, 1.5, 90, 0.28), ("cu2105C35", 35.0, 2.5, 55, 0.30),
    ("cu2105C40", 40.0, 1.5, 5, 0.38), ("cu2105C30", 45.0, 3.5, 5, 0.0), ("total", 0.0, 0.0, 0, 0.0),
]


@pytest.fixture
def options(spark):
    df = spark.createDataFrame(OPTIONS, "product_id string, strike double, close double, volume bigint, iv double")
    return df.select(
        F.lit("2020-11-04").cast("date").alias("trade_date"), F.lit("SHFE").alias("exchange"),
        F.lit("cu").alias("group_id"), "*", F.lit(33.0).alias("u_price"),
    )


def test_quote_iv_and_siv(spark, calendar, options):
    solved = contracts.quote_iv(options, calendar)
    by = {r.product_id: r for r in solved.collect()}
    assert [by[o[0]].iv for o in OPTIONS] == [0.4109, 0.3242, 0.3803, 0.416, 0.1992, 0.0]
    assert [by[o[0]].rdays for o in OPTIONS] == [111, 111, 174, 174, 174, 0]
    given = options.withColumn("rdays", F.lit(111))

    def siv(df, weight):
        return aggregate.siv(df, weight).first().iv

    assert siv(given, "volume") == 0.298 and siv(given, "turnover") == 0.309
    fewer = given.where("product_id <> 'cu2105C30'")
    assert siv(fewer, "volume") == 0.298 and siv(fewer, "turnover") == 0.309
    assert siv(solved, "rdays") == 0.371 and siv(solved, "tr") == 0.374
    total = aggregate.siv_on_totals(solved.select(*options.columns, "rdays"), "rdays").where("product_id = 'total'").first()
    assert total.iv == 0.371


def test_quote_status(spark, calendar, options):
    names = {
        "cu2103C30": ("ok", 4.5), "cu2010C30": ("expired", 4.5), "xx2103C30": ("unsupported_product", 4.5),
        "junk": ("unparsed", 4.5), "cu2103C31": ("no_price", 0.0), "cu2103C20": ("below_intrinsic", 4.5),
    }
    rows = spark.createDataFrame([(n, v[1]) for n, v in names.items()], "product_id string, close double")
    df = rows.select(
        F.lit("2020-11-04").cast("date").alias("trade_date"), F.lit("SHFE").alias("exchange"), F.lit("cu").alias("group_id"),
        "*", F.lit(30.0).alias("strike"), F.lit(33.0).alias("u_price"), F.lit(1).alias("volume"),
    )
    out = {r.product_id: r for r in contracts.quote_iv(df, calendar).collect()}
    for name, (status, _) in names.items():
        assert out[name].iv_status == status, name
    assert out["cu2103C20"].iv == 0.0 and out["cu2103C31"].iv == 0.0
    assert out["cu2010C30"].iv is None and out["junk"].iv is None


def test_routing(spark, calendar, options):
    named = options.where("product_id <> 'total'").withColumn("product_id", F.replace("product_id", F.lit("cu"), F.lit("au")))
    solved = contracts.quote_iv(named, calendar, routing="by_exercise_style")
    inputs = solved.withColumns({
        "t": F.col("rdays") / 365, "cp": F.lit(1.0), "k": F.regexp_extract("product_id", "C(.*)", 1).cast("double"),
    })
    again = contracts.solve_iv(inputs, "close", "u_price", "k", "t", "cp", model="b76", out="want").collect()
    assert again and all(r.iv == r.want for r in again)


def test_empty_weight_gives_null(spark, options):
    flat = options.withColumn("iv", F.lit(0.0)).withColumn("rdays", F.lit(5))
    assert aggregate.siv(flat, "tr").first().iv is None
