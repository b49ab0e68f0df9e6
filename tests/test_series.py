import datetime
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide.functions.numeric import half_even
from voltide.operators import aggregate, normalize, series, term
from voltide.plans import monitor

START = datetime.date(2019, 1, 1)


def positions(size):
    """Threshold positions, step by step."""
    step, rest, out = size // 100, size % 100, []
    for _ in range(99):
        out.append((out[-1] if out else 0) + step + (1 if rest > 0 else 0))
        rest -= 1
    return out


def stepwise(window):
    ordered, count = sorted(window), 0
    for at in positions(len(window)):
        if window[-1] > ordered[at]:
            count += 1
        else:
            break
    return count


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(3)
    rows = []
    for group, n in (("a", 700), ("b", 300), ("c", 40)):
        price = 100.0
        for i in range(n):
            price = round(max(price * math.exp(rng.gauss(0, 0.02)), 1), 0)
            rows.append((START + datetime.timedelta(days=i), "X", group, price))
    df = spark.createDataFrame(rows, "trade_date date, exchange string, group_id string, close double")
    return df.repartition(4).cache(), rows


def test_volatility(spark, walk):
    df, rows = walk
    out = series.hist_vol(df, 20).where("group_id = 'a'").orderBy("trade_date").collect()
    closes = [r[3] for r in rows if r[2] == "a"]
    rets = [None] + [math.log(b / a) for a, b in zip(closes, closes[1:])]
    for i, r in enumerate(out):
        if i < 20:
            assert r.hv20 is None
        else:
            assert r.hv20 == pytest.approx(math.sqrt(250 * statistics.variance(rets[i - 19:i + 1])), rel=1e-9)


def test_rolling_percentile_with_ties(spark, walk):
    df, rows = walk
    out = series.rolling_percentile(df, "close", "p").collect()
    got = {(r.group_id, r.trade_date): r.p for r in out}
    for group in "abc":
        mine = [r for r in rows if r[2] == group]
        for i, r in enumerate(mine):
            want = stepwise([x[3] for x in mine[i - 249:i + 1]]) if i >= 249 else None
            assert got[(group, r[0])] == want


def test_percentile_of_and_thresholds(spark, walk):
    df, rows = walk
    probe = spark.createDataFrame([("X", g, v) for g in "abc" for v in (1.0, 90.0, 100.0, 130.0, 1e6)],
                                  "exchange string, group_id string, probe double")
    for r in series.percentile_of(df, "close", probe, "probe").collect():
        history = sorted(x[3] for x in rows if x[2] == r.group_id)
        if len(history) < 250:
            assert r.percentile == 50
            continue
        top = history[-250:]
        assert r.percentile == sum(top[p] < r.probe for p in positions(250))
    lists = {r.group_id: r.thresholds for r in series.percentile_thresholds(df, "close").collect()}
    assert lists["c"] == [] and len(lists["a"]) == 99
    assert lists["b"] == [sorted(x[3] for x in rows if x[2] == "b")[-250:][p] for p in positions(250)]


def test_positions_closed_form():
    for n in (100, 101, 199, 250, 251, 1000):
        assert series.threshold_positions(n) == positions(n)


def test_extremes_averages_tail(spark, walk):
    df, rows = walk
    out = series.moving_averages(series.expanding_extremes(df, "close", "hi", "lo"))
    mine = [r[3] for r in rows if r[2] == "b"]
    for i, r in enumerate(out.where("group_id = 'b'").orderBy("trade_date").collect()):
        assert (r.hi, r.lo) == (max(mine[:i + 1]), min(mine[:i + 1]))
        assert r.ma5 == (pytest.approx(sum(mine[i - 4:i + 1]) / 5) if i >= 4 else None)
    assert series.tail(df, 5).groupBy("group_id").count().where("count <> 5").count() == 0


def test_nulls_break_the_window(spark, walk):
    df, _ = walk
    holes = df.withColumn("iv", F.when(F.col("trade_date") != START + datetime.timedelta(days=100), F.col("close")))
    out = series.analyze_iv(holes).where("group_id = 'a'").orderBy("trade_date").collect()
    assert all(r.iv_pct is None for r in out[:350]) and out[350].iv_pct is not None
    assert out[100].iv_max == out[99].iv_max


def test_index_ignores_totals_and_is_bounded(spark):
    rng = random.Random(9)
    rows = [(START + datetime.timedelta(days=rng.randrange(5)), "X", rng.choice(["hot"] * 8 + ["g"]), f"p{i}",
             round(rng.uniform(50, 60), 2), rng.randrange(1, 99)) for i in range(3000)]
    rows += [(START, "X", "hot", "total", 1e6, 10 ** 6)]
    df = spark.createDataFrame(rows, "trade_date date, exchange string, group_id string, product_id string, close double, open_interest bigint")
    for r in aggregate.futures_index(df).collect():
        mine = [x for x in rows if (x[0], x[2]) == (r.trade_date, r.group_id) and x[3] != "total"]
        assert r.close == pytest.approx(sum(x[4] * x[5] for x in mine) / sum(x[5] for x in mine), abs=5.1e-4)
        assert min(x[4] for x in mine) <= r.close <= max(x[4] for x in mine)
    filled = aggregate.index_on_totals(df).where("product_id = 'total'").first()
    assert filled.close < 61


def test_dedupe_keeps_last_of_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i}", i, float(i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, seq int, v double").repartition(16)
    out = {r.k: r.seq for r in normalize.dedupe_last(df, ["k"], ["seq"]).collect()}
    assert out["hot"] == 4999 and len(out) == 1 + len([r for r in rows if r[0] != "hot"])


def test_half_even(spark):
    """Same result as NumPy's rounding, ties included."""
    xs = [0.2985, 0.2975, 2.0005, 0.0005, 0.0015, 1.23449] + [i / 16 for i in range(-40, 40)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", half_even(F.col("x"), 3).alias("y")).collect():
        assert r.y == np.round(r.x, 3)


def test_term_structure(spark):
    d = [datetime.date(2020, m, 15) for m in (3, 6, 9, 12)]
    days = [datetime.date(2020, 2, 1) + datetime.timedelta(days=13 * i) for i in range(25)]
    rows = [("X", "g", t, D, 100.0 + D.month, 0.0 if D.month == 6 else 200.0 + D.month)
            for D in d for t in days if t <= D]
    df = spark.createDataFrame(rows, "exchange string, group_id string, trade_date date, delivery date, close double, settle double")
    got = {(r.trade_date, r.pos): r.price for r in term.term_structure(df, df).collect()}
    want = {}
    for _, _, t, D, close, settle in rows:
        pos = sum(t <= x < D for x in d)
        want[(t, pos)] = want.get((t, pos), 0) + (settle or close)
    assert got == want
    newest = term.term_structure(df, df, max_contracts=2)
    assert newest.agg(F.countDistinct("trade_date")).first()[0] == len({r[2] for r in rows if r[3] in d[2:]})
    pct = {(r.trade_date, r.pos): r.pct for r in term.term_pct_change(term.term_structure(df, df)).collect()}
    t0 = days[0]
    assert pct[(t0, 0)] is None and pct[(t0, 1)] == pytest.approx((want[(t0, 1)] - want[(t0, 0)]) / want[(t0, 0)])


def test_alert_rules(spark):
    rows = [("a", 0.2, 0.5, 0.1, 95), ("b", 0.2, 0.5, 0.1, 50), ("c", 0.2, 0.5, 0.1, 10), ("d", 0.46, 0.5, 0.1, None),
            ("e", 0.10, 0.5, 0.1, None), ("f", 0.3, 0.5, 0.1, None), ("g", None, None, None, None)]
    df = spark.createDataFrame(rows, "name string, iv double, iv_max double, iv_min double, iv_pct int")
    got = {r.name: r.alert_reason for r in monitor.iv_alerts(df).collect()}
    assert got == {"a": "iv percentile high", "c": "iv percentile low", "d": "iv near maximum", "e": "iv near minimum"}
    lines = [r.line for r in monitor.alert_lines(df.select("name", *[F.col(c).cast("string") for c in ("iv", "iv_pct")])).collect()]
    assert lines[0] == "> a: iv 0.2 p 95  \n  "


def test_notification(spark):
    names = spark.createDataFrame([("a", "A"), ("b", "B")], "group_id string, name string")
    cols = "group_id string, " + ", ".join(f"{c} double" for c in monitor.PERCENT_COLUMNS) + ", hv_pct int, iv_pct int"
    rows = [("a", *[0.1234] * 8, 42, 7), ("b", *[None] * 8, None, 9), ("x", *[0.5] * 8, 1, 1)]
    out = {r.name: r for r in monitor.notification_table(spark.createDataFrame(rows, cols), names).collect()}
    assert set(out) == {"A", "B"}
    assert (out["A"].hvm, out["A"].hv_pct, out["A"].iv_pct) == ("12.3", "42", "7")
    assert (out["B"].hvm, out["B"].hv_pct, out["B"].iv_pct) == ("-", "-", "-")
    assert monitor.markdown_rows(spark.sql("SELECT 'x' a, 1 b")).first().line == "| x | 1 |"


def test_freshness_gate(spark, walk):
    df, _ = walk
    index = df.withColumn("product_id", F.lit("p")).withColumn("open_interest", F.lit(1))
    last = str(START + datetime.timedelta(days=699))
    options = spark.createDataFrame([], "trade_date date, exchange string, group_id string, product_id string, strike double, "
                                    "u_price double, close double, volume bigint, rdays int, iv double")
    assert [r.group_id for r in monitor.run_monitor(index, options, as_of=last, anchor_group="a").collect()] == ["a"]
    late = str(START + datetime.timedelta(days=700))
    assert monitor.run_monitor(index, options, as_of=late, anchor_group="a").count() == 0
