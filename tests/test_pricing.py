import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide.functions import european, kernels, lattice
from voltide.functions.lattice import _LAW
from voltide.functions.normal import norm_cdf
from voltide.functions.register import register_functions
from voltide.operators import contracts, pricing

# --- fixed values: single-quote anchors (price, underlying, strike, days, sign, volatility) ---
IV_ANCHORS = [
    (320.0, 5640.0, 5600.0, 145, -1.0, 0.2452),
    (0.2, 770.8, 780.0, 2, 1.0, 0.1097),
    (0.2, 770.8, 780.0, 1, 1.0, 0.1552),
    (1155.0, 5569.78, 4400.0, 328, 1.0, 0.0),
    (4.5, 33.0, 30.0, 111, 1.0, 0.4109),
    (1.5, 33.0, 35.0, 111, 1.0, 0.3242),
    (2.5, 33.0, 35.0, 174, 1.0, 0.3803),
    (1.5, 33.0, 40.0, 174, 1.0, 0.416),
    (3.5, 33.0, 30.0, 174, 1.0, 0.1992),
]
# --- fixed values: market quotes (price, underlying, strike, days, sign, percent, tolerance) ---
MARKET = [
    (350.6, 5569.78, 5400.0, 148, 1.0, 19.17, 0.52),
    (356.6, 5579.78, 5600.0, 148, -1.0, 25.02, 0.25),
    (2220.0, 58810.0, 57000.0, 32, 1.0, 16.27, 0.3),
    (1550.0, 58810.0, 58000.0, 32, 1.0, 16.35, 0.2),
    (1896.0, 58810.0, 60000.0, 32, -1.0, 17.70, 0.4),
    (1234.0, 58810.0, 59000.0, 32, -1.0, 16.78, 0.55),
    (14.22, 390.0, 396.0, 63, -1.0, 17.81, 0.52),
    (14.8, 390.0, 384.0, 63, 1.0, 19.06, 0.61),
    (618.0, 8170.0, 7700.0, 77, 1.0, 24.04, 0.7),
    (272.0, 8170.0, 8100.0, 77, -1.0, 21.63, 1.01),
    (224.0, 5216.0, 5000.0, 13, 1.0, 18.56, 0.51),
    (127.5, 5216.0, 5300.0, 13, -1.0, 21.02, 1.4),
]


def phi(x):
    return 0.5 * math.erfc(-x / math.sqrt(2))


def quotes(spark, rows):
    df = spark.createDataFrame([r[:5] for r in rows], "price double, s double, k double, days int, cp double")
    return df.withColumn("t", F.col("days") / 365).withColumn("id", F.monotonically_increasing_id())


def test_american_iv_anchors(spark):
    out = contracts.solve_iv(quotes(spark, IV_ANCHORS).coalesce(1), "price", "s", "k", "t", "cp").orderBy("id")
    assert [r.iv for r in out.collect()] == [a[5] for a in IV_ANCHORS]


def test_american_iv_market(spark):
    out = contracts.solve_iv(quotes(spark, MARKET).coalesce(1), "price", "s", "k", "t", "cp").orderBy("id").collect()
    for row, (*_, percent, tolerance) in zip(out, MARKET):
        assert abs(row.iv * 100 - percent) <= tolerance


def test_norm_cdf(spark):
    xs = [i / 16 for i in range(-640, 641)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", norm_cdf(F.col("x")).alias("p")).collect():
        assert abs(r.p - phi(r.x)) < 1e-15
        if -35 < r.x < 0:
            # the published tail form is good to about nine digits
            assert abs(r.p / phi(r.x) - 1) < 1e-8


def grid():
    rng = random.Random(5)
    return [(rng.uniform(80, 120), rng.uniform(80, 120), rng.choice([0.0, 0.05, 0.12]), rng.uniform(0.02, 1.5),
             rng.uniform(0.05, 0.9), rng.choice([1.0, -1.0])) for _ in range(300)]


@pytest.mark.parametrize("model", ["b76", "bs"])
def test_european_price_and_greeks(spark, model):
    df = spark.createDataFrame(grid(), "s double, k double, r double, t double, v double, cp double")

    def value(s, k, r, t, v, cp):
        d1 = (math.log(s / k) + ((0 if model == "b76" else r) + v * v / 2) * t) / (v * math.sqrt(t))
        d2, q = d1 - v * math.sqrt(t), math.exp(-r * t)
        if model == "b76":
            return cp * (s * phi(cp * d1) - k * phi(cp * d2)) * q
        return cp * (s * phi(cp * d1) - k * phi(cp * d2) * q)

    for r in pricing.price_options(df, model, greeks=True).collect():
        args = (r.s, r.k, r.r, r.t, r.v, r.cp)
        assert r.price == pytest.approx(value(*args), abs=1e-9)
        h = 1e-3
        up, down = value(r.s + h, *args[1:]), value(r.s - h, *args[1:])
        assert r.delta == pytest.approx((up - down) / (2 * h) * r.s * 0.01, abs=1e-5)
        assert r.gamma == pytest.approx((up - 2 * value(*args) + down) / h ** 2 * r.s ** 2 * 1e-4, abs=1e-3)
        v = 1e-5
        vega = (value(*args[:4], r.v + v, r.cp) - value(*args[:4], r.v - v, r.cp)) / (2 * v)
        assert r.vega == pytest.approx(vega / 100, abs=1e-5)
        slope = (value(*args[:3], r.t - v, *args[4:]) - value(*args[:3], r.t + v, *args[4:])) / (2 * v)
        assert r.theta == pytest.approx(slope / 240, abs=1e-5)


@pytest.mark.parametrize("model", ["b76", "bs"])
def test_zero_volatility(spark, model):
    df = spark.createDataFrame([(100.0, 90.0, 0.1, 0.5, 0.0, 1.0), (100.0, 90.0, 0.1, 0.5, -1.0, -1.0)],
                               "s double, k double, r double, t double, v double, cp double")
    out = pricing.price_options(df, model, greeks=True).collect()
    assert [r.price for r in out] == [10.0, 0.0]
    assert all(r.delta == r.gamma == r.theta == r.vega == 0 for r in out)


def test_column_forms_agree_with_staged(spark):
    df = spark.createDataFrame(grid()[:40], "s double, k double, r double, t double, v double, cp double")
    args = [F.col(c) for c in pricing.ARGS]
    both = pricing.price_options(df, "b76").withColumn("again", european.b76_price(*args))
    assert all(r.price == pytest.approx(r.again, abs=1e-12) for r in both.collect())
    both = pricing.price_options(df, "bs", greeks=True).withColumn("g", european.bs_greeks(*args))
    assert all(r.theta == pytest.approx(r.g.theta, abs=1e-12) for r in both.collect())


def slow_tree(f, k, r, t, v, cp, n):
    """Plain recursive definition of the American value."""
    dt = t / n
    up = math.exp(v * math.sqrt(dt))
    p = (1 - 1 / up) / (up - 1 / up)

    def node(i, j):
        own = cp * (f * up ** (i - 2 * j) - k)
        if i == n:
            return max(0.0, own)
        return max(math.exp(-r * dt) * (p * node(i + 1, j) + (1 - p) * node(i + 1, j + 1)), own, 0.0)

    return node


def test_tree_against_recursion_and_native(spark):
    rows = grid()[:30]
    df = spark.createDataFrame(rows, "s double, k double, r double, t double, v double, cp double")
    args = [F.col(c) for c in pricing.ARGS]
    out = df.select("*", lattice.crr_price(*args, n=6).alias("a"), lattice.crr_price_native(*args, n=6).alias("b"))
    for r in out.collect():
        want = slow_tree(r.s, r.k, r.r, r.t, r.v, r.cp, 6)(0, 0)
        assert r.a == pytest.approx(want, abs=1e-10)
        assert r.b == pytest.approx(want, abs=1e-10)
    for r in pricing.price_options(df, "crr", greeks=True, n=6).collect():
        node, dt = slow_tree(r.s, r.k, r.r, r.t, r.v, r.cp, 6), r.t / 6
        up = math.exp(r.v * math.sqrt(dt))
        assert r.delta == pytest.approx((node(1, 0) - node(1, 1)) / (r.s * up - r.s / up) * r.s * 0.01, abs=1e-9)
        assert r.theta == pytest.approx((node(2, 1) - node(0, 0)) / (2 * dt * 240), abs=1e-9)
        bumped = slow_tree(r.s, r.k, r.r, r.t, r.v * 1.001, r.cp, 6)(0, 0)
        assert r.vega == pytest.approx((bumped - node(0, 0)) / (0.001 * r.v * 100), abs=1e-6)


def test_american_bounds_and_round_trip(spark):
    df = spark.createDataFrame(grid(), "s double, k double, r double, t double, v double, cp double")
    priced = pricing.price_options(df, "crr").where(F.abs(F.ln(F.col("s") / F.col("k"))) < 0.1)
    solved = contracts.solve_iv(priced, "price", "s", "k", "t", "cp", rate=0.05).where("r = 0.05").collect()
    assert len(solved) > 20
    for r in solved:
        assert r.price >= max(0.0, r.cp * (r.s - r.k)) - 1e-12
        if r.price > r.cp * (r.s - r.k) + 0.5:
            assert r.iv == pytest.approx(r.v, abs=2e-4)


@pytest.mark.parametrize("model", ["b76", "bs"])
def test_newton_finds_the_volatility(spark, model):
    df = spark.createDataFrame(grid(), "s double, k double, r double, t double, v double, cp double").where("r = 0.12")
    priced = pricing.price_options(df, model).where("price > 0.05")
    for r in contracts.solve_iv(priced, "price", "s", "k", "t", "cp", model=model, method="newton").collect():
        disc = math.exp(-0.12 * r.t)
        floor = max(0, r.cp * (r.s - r.k) * disc) if model == "b76" else max(0, r.cp * (r.s - r.k * disc))
        if r.price > floor + 0.05:
            assert r.iv == pytest.approx(r.v, abs=1e-4)


def test_chord_equals_stepwise_rule():
    def chord(price, s, k, r, t, cp):
        if price <= 0 or price <= ((s - k) * math.exp(-r * t) if cp > 0 else k * math.exp(-r * t) - s):
            return 0.0
        v = 0.01
        for _ in range(50):
            if v <= 0:
                break
            d1 = (math.log(s / k) + v * v / 2 * t) / (v * math.sqrt(t))
            model = cp * (s * phi(cp * d1) - k * phi(cp * (d1 - v * math.sqrt(t)))) * math.exp(-r * t)
            dx = (price - model) / (s * math.exp(-r * t) * math.exp(-0.5) / math.sqrt(2 * math.pi) * math.sqrt(t))
            if abs(dx) < 1e-5:
                break
            v += dx
        return round(v, 4) if v > 0 else 0.0

    rng = random.Random(11)
    rows = [(rng.uniform(0, 30), 100.0, rng.uniform(70, 130), 0.12, rng.uniform(0.05, 1), rng.choice([1.0, -1.0])) for _ in range(200)]
    arrays = [np.array(c) for c in zip(*rows)]
    with np.errstate(all="ignore"):
        got = kernels.european_vol("b76", "chord", *arrays, _LAW)
    assert [round(g, 4) for g in got] == pytest.approx([chord(*r) for r in rows], abs=1.01e-4)


def test_null_and_flat_inputs(spark):
    rows = [(None, 100.0, 100.0, 30, 1.0), (0.0, 100.0, 100.0, 30, 1.0), (5.0, 100.0, 90.0, 30, 1.0)]
    out = contracts.solve_iv(quotes(spark, rows).coalesce(1), "price", "s", "k", "t", "cp").orderBy("id").collect()
    assert [r.iv for r in out] == [None, 0.0, 0.0]


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql(
        "SELECT norm_cdf(0.5D) a, b76_price(100D, 100D, 0.05D, 0.5D, 0.2D, 1D) b, "
        "implied_vol(320D, 5640D, 5600D, 0.12D, 145D / 365, -1D) c"
    ).first()
    assert row.a == pytest.approx(phi(0.5), abs=1e-15)
    assert row.b == pytest.approx(5.4987, abs=1e-3)
    assert row.c == 0.2452
