"""Batches and recomputed tables take effect once, whatever fails in between."""

import datetime

import pytest
from pyspark.sql import functions as F

from voltide import schemas
from voltide.operators import aggregate, contracts, ledger, maintain
from voltide.plans import monitor
from voltide.streaming import daily_sync

DAY = datetime.date(2021, 1, 4)
KEYS = ["trade_date", "k"]
SCHEMA = "trade_date date, k string, v int"


def rows(spark, *values):
    return spark.createDataFrame([(DAY + datetime.timedelta(days=d), k, v) for d, k, v in values], SCHEMA)


def table(spark, path):
    return sorted(((r.trade_date - DAY).days, r.k, r.v) for r in spark.read.schema(SCHEMA).parquet(path).collect())


class Stop(Exception):
    pass


def failing(monkeypatch, module, name, at, before=False):
    """Let the ``at``-th call of a function fail, after its work or before."""
    real, calls = getattr(module, name), []

    def wrapped(*args, **kwargs):
        calls.append(1)
        if before and len(calls) == at:
            raise Stop
        out = real(*args, **kwargs)
        if len(calls) == at:
            raise Stop
        return out

    monkeypatch.setattr(module, name, wrapped)


def test_a_replayed_batch_is_skipped(spark, tmp_path):
    path = str(tmp_path / "t")

    def merge(batch, *values):
        return maintain.merge_day(spark, rows(spark, *values), path, SCHEMA, KEYS, batch=batch)

    assert merge("s-0", (0, "a", 1), (1, "a", 2)) and merge("s-1", (0, "a", 3), (39, "b", 4)) and merge("s-2")
    now = table(spark, path)
    assert now == [(0, "a", 3), (1, "a", 2), (39, "b", 4)]
    assert not merge("s-0", (0, "a", 1), (1, "a", 2)) and not merge("s-2", (5, "x", 5))  # older than what is stored
    assert table(spark, path) == now
    noted = ledger.entries(spark, path).where("state = 'published' AND n_rows > 0").collect()
    assert sorted((r.batch, r.part, r.n_rows) for r in noted) == [("s-0", "2021-01-04", 1), ("s-0", "2021-01-05", 1), ("s-1", "2021-01-04", 1), ("s-1", "2021-02-12", 1)]
    assert spark.read.parquet(f"{path}/_staged/s-1").count() == 0 and merge(None, (0, "a", 9))


def test_a_batch_that_failed_while_days_were_replaced(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    maintain.merge_day(spark, rows(spark, (0, "a", 1), (0, "b", 1), (1, "a", 1)), path, SCHEMA, KEYS, batch="s-0")
    new = rows(spark, (0, "a", 2), (1, "c", 2))
    with monkeypatch.context() as patch:
        failing(patch, maintain, "append_day", 1, before=True)
        with pytest.raises(Stop):
            maintain.merge_day(spark, new, path, SCHEMA, KEYS, batch="s-1")
    # what a failure between deleting and moving files leaves: a day has lost its rows
    maintain.append_day(rows(spark, (0, "zzz", 0)), path)
    assert maintain.merge_day(spark, new, path, SCHEMA, KEYS, batch="s-1")
    assert table(spark, path) == [(0, "a", 2), (0, "b", 1), (1, "a", 1), (1, "c", 2)]
    assert ledger.states(spark, path, "s-1") == {"staged", "published"} and ledger.states(spark, path, "s-9") == set()


@pytest.mark.parametrize("name,at,before", [("mark", 1, True), ("mark", 1, False), ("mark", 2, True), ("mark", 2, False)])
def test_the_stream_goes_on_where_it_failed(spark, tmp_path, monkeypatch, name, at, before):
    landing, out, check = (str(tmp_path / n) for n in ("landing", "out", "check"))

    def land(*docs):
        spark.createDataFrame([("X", "k", DAY, d) for d in docs], schemas.RAW_PAYLOADS).write.mode("append").parquet(landing)

    def ingest(payloads):
        k, v = F.split("payload", ":").getItem(0), F.split("payload", ":").getItem(1).cast("int")
        return payloads.select("trade_date", k.alias("k"), v.alias("v"))

    def sync():
        daily_sync.stream_daily_sync(spark, landing, out, check, ingest, KEYS, SCHEMA).awaitTermination()

    land("a:1", "b:1")
    sync()
    land("a:2")
    with monkeypatch.context() as patch:
        failing(patch, ledger, name, at, before)
        with pytest.raises(Exception):
            sync()
    sync()
    land("c:3")
    sync()
    assert table(spark, out) == [(0, "a", 2), (0, "b", 1), (0, "c", 3)]
    published = ledger.entries(spark, out).where("state = 'published'").groupBy("batch").agg(F.max("n_rows").alias("n")).collect()
    assert sorted((r.batch[-2:], r.n) for r in published if r.n) == [("-0", 2), ("-1", 2), ("-2", 3)]


QUOTES = [("SHFE", "cu2103C57000", "cu", "C", 57000.0, 58810.0, 2220.0), ("SHFE", "cu2103P57000", "cu", "P", 57000.0, 58810.0, 400.0),
          ("SHFE", "odd", "cu", "C", 1.0, 1.0, 1.0), ("DCE", "c2105-C-2700", "玉米", "C", 2700.0, 2700.0, 90.0)]


def stored_quotes(spark, path, days=6):
    rows = [(DAY + datetime.timedelta(days=d), e, p, g, o, k, u, c + d, 10 + d, 5, 0.5, 1, "old") for d in range(days) for e, p, g, o, k, u, c in QUOTES]
    maintain.append_day(spark.createDataFrame(rows, schemas.SOLVED_QUOTES), path)


def state(frames):
    return [sorted(map(repr, f.select(sorted(f.columns)).collect())) for f in frames]


def test_recomputed_tables(spark, tmp_path, calendar):
    quotes, siv = str(tmp_path / "q"), str(tmp_path / "s")
    stored_quotes(spark, quotes)
    solved = contracts.quote_iv(spark.read.schema(schemas.SOLVED_QUOTES).parquet(quotes), calendar).select(*schemas.SOLVED_QUOTES.fieldNames())
    want = state([solved, aggregate.siv(solved)])
    got = monitor.recompute_stored(spark, quotes, siv, calendar, "r1", parts_per_step=2)
    assert state(got) == want and got[0].where("iv_status = 'ok'").count() == 18
    assert state(monitor.recompute_stored(spark, quotes, siv, calendar, "r1")) == want


@pytest.mark.parametrize("module,name,at,before", [
    ("monitor", "append_day", 3, True), ("monitor", "append_day", 4, True), ("ledger", "mark", 2, True), ("ledger", "mark", 2, False),
    ("ledger", "mark", 4, False), ("monitor", "append_day", 7, False), ("monitor", "append_day", 8, True), ("ledger", "mark", 5, True)])
def test_a_killed_run_resumes(spark, tmp_path, calendar, monkeypatch, module, name, at, before):
    quotes, siv = str(tmp_path / "q"), str(tmp_path / "s")
    stored_quotes(spark, quotes)
    solved = contracts.quote_iv(spark.read.schema(schemas.SOLVED_QUOTES).parquet(quotes), calendar).select(*schemas.SOLVED_QUOTES.fieldNames())
    want = state([solved, aggregate.siv(solved)])
    with monkeypatch.context() as patch:
        failing(patch, {"monitor": monitor, "ledger": ledger}[module], name, at, before)
        with pytest.raises(Stop):
            monitor.recompute_stored(spark, quotes, siv, calendar, "r", parts_per_step=2)
    steps = ledger.entries(spark, quotes).where("batch = 'r/step' AND n_rows > 0").select("part").distinct().count()
    solves = []
    real = monitor.quote_iv
    monkeypatch.setattr(monitor, "quote_iv", lambda frame, cal: solves.append(frame.select("trade_date").distinct().count()) or real(frame, cal))
    assert state(monitor.recompute_stored(spark, quotes, siv, calendar, "r", parts_per_step=2)) == want
    assert sum(solves) == 6 - steps  # marked days are not solved again
