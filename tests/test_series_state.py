"""The streamed series equals the batch result day by day."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide.operators import series
from voltide.streaming import series_state

DAY = datetime.date(2019, 1, 1)
COLUMNS = ["hvm", "hvy", "hv_ratio", "hv_pct", "hv_max", "hv_min", "iv_pct", "iv_max", "iv_min"]


def walk(n=620):
    g = np.random.default_rng(8)
    rows = []
    for exchange, group, gap in (("A", "g", 0), ("B", "g", 3), ("A", None, 0), ("A", "flat", 0)):
        price = 100.0
        for t in range(n):
            price *= math.exp(g.normal(0, 0.01)) if group != "flat" else 1.0
            close = None if gap and t == 300 else 0.0 if gap and t == 301 else price
            iv = None if t % 97 == 5 or (group is None and t < 400) else round(float(g.uniform(0.1, 0.4)), 3)
            if not (gap and t % 50 == 7):
                rows.append((DAY + datetime.timedelta(days=t), exchange, group, close, iv))
    return rows


def close_to(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9)


@pytest.mark.parametrize("cuts", [[400], [1, 2, 260, 261, 500]])
def test_day_by_day(spark, tmp_path, cuts):
    rows = walk()
    index = spark.createDataFrame(rows, series_state.IN)
    want = {(r.exchange, r.group_id, r.trade_date): r for r in series.analyze_iv(series.analyze_hv(index)).collect()}
    landing, out, check = (str(tmp_path / n) for n in ("landing", "out", "check"))
    edges = [0, *cuts, 10_000]
    for a, b in zip(edges, edges[1:]):
        low, high = (F.date_add(F.lit(DAY), x) for x in (a, b))
        index.where((F.col("trade_date") >= low) & (F.col("trade_date") < high)).repartition(3).write.mode("append").parquet(landing)
        series_state.sync_series(spark, landing, out, check).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert len(got) == len(want) == len(rows)
    for r in got:
        w = want[r.exchange, r.group_id, r.trade_date]
        assert not r.late and all(close_to(r[c], w[c]) for c in ["close", "iv", *COLUMNS]), (r, w)
    assert sum(r.hv_pct is not None for r in got) > 500 and sum(r.iv_pct is not None for r in got) == sum(w.iv_pct is not None for w in want.values())


def test_late_days_are_marked_and_change_nothing(spark, tmp_path):
    landing, out, check = (str(tmp_path / n) for n in ("landing", "out", "check"))

    def land(*days):
        rows = [(DAY + datetime.timedelta(days=d), "A", "g", 100.0 + d + copy, 0.2) for d, copy in days]
        spark.createDataFrame(rows, series_state.IN).write.mode("append").parquet(landing)
        series_state.sync_series(spark, landing, out, check).awaitTermination()

    land(*[(d, 0) for d in range(30)])
    land((10, 5), (30, 0), (30, 1))
    land((31, 0))
    got = sorted((r.trade_date, r.late, r.close, r.hvm) for r in spark.read.parquet(out).collect())
    assert [(g[0] - DAY).days for g in got if g[1]] == [10, 30] and all(g[3] is None for g in got if g[1])
    closes = np.array([100.0 + d for d in range(32)])
    want = math.sqrt(250 * np.diff(np.log(closes))[-20:].var(ddof=1))
    assert abs(got[-1][3] - want) < 1e-12 and len(got) == 34


def test_the_state_has_a_fixed_size():
    state = np.full(series_state.SCALARS + 3 * series_state.N, np.nan)
    for n in (1, 7, 900):
        columns, state = series_state.advance(state, np.linspace(1, 2, n), np.full(n, 0.1))
        assert len(state) == series_state.SCALARS + 3 * series_state.N and all(len(c) == n for c in columns.values())
    assert columns["hv_pct"][-1] >= 0 and state[0] == 2.0
