"""Volatility columns of the product series, kept up to date by a stream.

A daily run reads the new days only. What a product's next day needs of its
past is its state: the last close, the last 250 returns, volatilities and
synthetic volatilities, and their extremes so far. It has a fixed size, so the
state of all products grows with their number and not with their history.
"""

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voltide import constants as K

IN = "trade_date date, exchange string, group_id string, close double, iv double"
OUT = (
    "trade_date date, exchange string, group_id string, close double, iv double, hvm double, hvy double, hv_ratio double, hv_pct int, "
    "hv_max double, hv_min double, iv_pct int, iv_max double, iv_min double, late boolean"
)
N = K.ANNUAL_ROWS
EPOCH = datetime.date(1970, 1, 1)
# the state: last close, four extremes, and three histories of N numbers; missing ones are NaN
SCALARS = 5


def rolling(history: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` values up to each value behind the first ``N``, one row each."""
    return np.lib.stride_tricks.sliding_window_view(history[N - n + 1:], n)


def volatility(returns: np.ndarray, n: int) -> np.ndarray:
    return np.sqrt(N * rolling(returns, n).var(axis=1, ddof=1))


def percentile(history: np.ndarray) -> np.ndarray:
    """Percentile 0..99 of each value among the last ``N``, NaN until there are so many."""
    window = np.rint(rolling(history, N) * 1e10) / 1e10
    below = (window < window[:, -1:]).sum(axis=1)
    q, m = divmod(N, 100)
    last, split = below - 1, m * (q + 1)
    rank = np.where(last <= split, last // (q + 1), np.minimum(m + (last - split) // q, 99))
    return np.where(np.isnan(window).any(axis=1), np.nan, np.where(below <= 0, 0, rank))


def extremes(so_far: np.ndarray, values: np.ndarray) -> tuple:
    """Running highest and lowest value; ``so_far`` has both before the first."""
    return tuple(f.accumulate(np.concatenate([[s], values]))[1:] for f, s in ((np.fmax, so_far[0]), (np.fmin, so_far[1])))


def advance(state: np.ndarray, close: np.ndarray, iv: np.ndarray) -> tuple:
    """(columns, new state) after some further days of a product, in order."""
    scalars, (returns, vols, ivs) = state[:SCALARS], state[SCALARS:].reshape(3, N)
    with np.errstate(all="ignore"):
        before = np.concatenate([scalars[:1], close[:-1]])
        ratio = np.where(before == 0, np.nan, close / before)
        returns = np.concatenate([returns, np.where(ratio > 0, np.log(ratio), np.nan)])
        hvm, hvy = volatility(returns, K.HV_SHORT), volatility(returns, K.HV_LONG)
        vols, ivs = np.concatenate([vols, hvm]), np.concatenate([ivs, iv])
        hv_max, hv_min = extremes(scalars[1:3], hvm)
        iv_max, iv_min = extremes(scalars[3:5], iv)
        columns = {
            "hvm": hvm, "hvy": hvy, "hv_ratio": np.where(hvy == 0, np.nan, hvm / hvy), "hv_pct": percentile(vols), "hv_max": hv_max,
            "hv_min": hv_min, "iv_pct": percentile(ivs), "iv_max": iv_max, "iv_min": iv_min,
        }
    last = [close[-1], hv_max[-1], hv_min[-1], iv_max[-1], iv_min[-1]]
    return columns, np.concatenate([last, returns[-N:], vols[-N:], ivs[-N:]])


def update_series(key: tuple, frames, state: GroupState):
    """New days of one product, in the order of their dates; a day not behind the last one is returned as late, without values."""
    rows = pd.concat(list(frames)).sort_values(["trade_date", "close"], kind="stable")
    rows["exchange"], rows["group_id"] = key
    last, held = state.get if state.exists else (-1 << 31, None)
    held = np.full(SCALARS + 3 * N, np.nan) if held is None else np.frombuffer(bytes(held))
    day = np.array([(d - EPOCH).days for d in rows["trade_date"]], np.int64)
    rows["late"] = (day <= last) | np.concatenate([[False], day[1:] == day[:-1]])
    new = rows[~rows["late"]]
    if len(new):
        columns, held = advance(held, new["close"].to_numpy(float), new["iv"].to_numpy(float))
        state.update((int(day.max()), held.tobytes()))
        new = new.assign(**columns)
    out = pd.concat([new, rows[rows["late"]]]).reindex(columns=[f.split()[0] for f in OUT.split(", ")])
    for name in ("hv_pct", "iv_pct"):
        out[name] = out[name].astype("float64").astype("Int32")
    yield out


def update_stream(days: DataFrame) -> DataFrame:
    """Stream of index days (trade_date, exchange, group_id, close, iv) to a stream of series days."""
    return days.groupBy("exchange", "group_id").applyInPandasWithState(
        update_series, OUT, "last int, held binary", "append", GroupStateTimeout.NoTimeout)


def sync_series(spark, landing: str, out: str, checkpoint: str, max_files: int = None) -> StreamingQuery:
    """Load all index days that landed since the last run into the stored series, then stop."""
    reader = spark.readStream.schema(IN)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (
        update_stream(reader.parquet(landing)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
