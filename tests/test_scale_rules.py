"""What must hold for large tables: no hidden limits, full keys, pruned reads."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from voltide.operators import calendar as cal, joins, maintain, tables, term
from voltide.plans import monitor
from voltide.session import shared_folder

DAY = datetime.date(2021, 1, 4)


def test_term_structure_has_no_limit_unless_asked(spark):
    rows = [(DAY, "X", "g", DAY + datetime.timedelta(days=30 * k), float(k), 0.0) for k in range(1, 31)]
    quotes = spark.createDataFrame(rows, "trade_date date, exchange string, group_id string, delivery date, close double, settle double")
    full = term.term_structure(quotes)
    assert sorted(r.pos for r in full.collect()) == list(range(30))
    assert term.term_structure(quotes, max_contracts=4).count() == 4
    assert len(term.term_matrix(full, list(range(30))).columns) == 33
    with pytest.raises(Exception, match="no column for position"):
        term.term_matrix(full, list(range(8))).collect()


def test_one_group_on_two_exchanges_stays_one_row(spark):
    series = spark.createDataFrame([(DAY, "A", "g", 1.0), (DAY, "CSI", "csidx300", 2.0)], "trade_date date, exchange string, group_id string, close double")
    siv = spark.createDataFrame([(DAY, "A", "g", 0.1), (DAY, "B", "g", 0.2), (DAY, "CFFE", "IO", 0.3)],
                                "trade_date date, exchange string, group_id string, iv double")
    got = {r.group_id: r.iv for r in joins.join_options(series, siv).collect()}
    assert got == {"g": 0.1, "csidx300": 0.3} and joins.join_options(series, siv).count() == 2
    assert joins.join_options(series.drop("exchange"), siv.where("exchange <> 'B'")).count() == 2


def test_merge_reads_the_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "store")
    days = spark.range(40).select(F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("trade_date"), F.col("id").alias("x"))
    maintain.append_day(days.unionByName(spark.sql("SELECT CAST(NULL AS date) AS trade_date, 99L AS x")), path)
    stored = spark.read.schema(days.schema).parquet(path)

    def files(frame):
        """How many files the frame's scan read."""
        frame = frame.select("*")  # metrics count for the first run of a plan
        frame.collect()
        scan = frame._jdf.queryExecution().executedPlan()
        while scan.children().size():
            scan = scan.children().head()
        return scan.metrics().get("numFiles").get().value()

    touched = maintain.touched_days(stored, days.where("x IN (0, 39)"))
    assert sorted(r.x for r in touched.collect()) == [0, 39]
    assert files(stored) == 41 and files(touched) == 2
    lost = maintain.touched_days(stored, days.where("x = 7").unionByName(days.limit(1).withColumn("trade_date", F.lit(None).cast("date"))))
    assert sorted(r.x for r in lost.collect()) == [7, 99] and files(lost) == 2
    assert maintain.touched_days(stored, days.limit(0)).count() == 0
    many = maintain.touched_days(stored, days.where("x < 9").unionByName(lost.select(days.columns)), most=5)
    assert sorted(r.x for r in many.collect()) == [*range(9), 99]


def test_scratch_tables_are_below_a_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    assert shared_folder(spark, "x").startswith(root.rstrip("/"))


def plan(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_one_row_per_key_is_picked_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "rows")
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id",
                                   F.concat(F.lit("v"), "id").alias("v"))
    hot.repartition(4).write.parquet(path)
    frame = spark.read.schema(hot.schema).parquet(path)
    for last, want in ((True, 2997), (False, 0)):
        picked = tables.pick_by(frame, ["k"], ["id"], last=last)
        assert {r.k: (r.id, r.v) for r in picked.collect()}["hot"] == (want, f"v{want}") and picked.count() == 2001
    text = plan(picked.select("*"))
    assert "SortAggregate" not in text and text.count("WindowGroupLimit") == 2
    assert text.rindex("WindowGroupLimit") > text.index("Exchange hashpartitioning(k")  # below it: before the shuffle


def test_missing_order_values_lose(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", 2.0, 2), ("b", None, 3)], "k string, o double, v int")
    assert sorted((r.k, r.v) for r in tables.pick_by(rows, ["k"], ["o"], last=True).collect()) == [("a", 2), ("b", 3)]
    assert sorted((r.k, r.v) for r in tables.pick_by(rows, ["k"], [F.col("o")], last=False).collect()) == [("a", 1), ("b", 3)]


def test_sessions_are_looked_up_in_one_calendar(spark, calendar, tmp_path):
    calendar.write.parquet(str(tmp_path / "calendar"))
    calendar = spark.read.parquet(str(tmp_path / "calendar"))
    anchors = spark.range(400).select(F.date_add(F.lit(DAY), (F.col("id") % 200).cast("int")).alias("day"), (F.col("id") % 21 - 10).cast("int").alias("n"))
    found = cal.nth_session(anchors.repartition(3), "day", "n", calendar.where("cal_date <> '2021-03-03'"))
    found = found.select("*")
    found.collect()
    text = found._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
    # all look into the result of one subquery
    assert len(set(re.findall(r"Subquery subquery#(\d+)", text))) == 1 and "ReusedSubquery" in text
    days = [(r.cal_date, r.is_session, r.is_session and not r.closed) for r in calendar.where("cal_date <> '2021-03-03'").collect()]
    opened, sessions = sorted(d for d, _, o in days if o), sorted(d for d, s, _ in days if s)
    for r in found.collect():
        if str(r.day) == "2021-03-03":
            assert r.session_date is None
        elif r.n > 0:
            assert r.session_date == [d for d in opened if d >= r.day][r.n - 1]
        else:
            place = sum(d <= r.day for d in sessions) + r.n
            assert r.session_date == (sessions[place] if 0 <= place < len(sessions) else None)
    far = cal.nth_session(spark.sql("SELECT DATE'1900-01-01' AS day, 1 AS n UNION ALL SELECT DATE'2022-06-30', 99 UNION ALL SELECT NULL, 1"), "day", "n", calendar)
    assert [r.session_date for r in far.collect()] == [None] * 3


def test_positions_are_rank_differences(spark):
    ladder = [DAY + datetime.timedelta(days=30 * k) for k in range(1, 9)]
    rows = [("X", "g", DAY + datetime.timedelta(days=t), d, float(k + t), 0.0) for t in range(0, 250, 7) for k, d in enumerate(ladder)]
    rows += [("X", "alone", DAY, ladder[0], 1.0, 0.0), (None, "g", DAY, ladder[0], 1.0, 0.0), ("X", "g", None, ladder[0], 1.0, 0.0)]
    quotes = spark.createDataFrame(rows, "exchange string, group_id string, trade_date date, delivery date, close double, settle double")
    given = spark.createDataFrame([("X", "g", d) for d in ladder[::2]], "exchange string, group_id string, delivery date")
    for deliveries, known, most in ((None, ladder, None), (given, ladder[::2], None), (given, ladder[::2], 2)):
        want = {}
        for e, g, t, d, price, _ in rows:
            if e and t and t <= d and (deliveries is None or g == "g"):
                own = known if g == "g" else ladder[:1]
                if most is None or sum(x > d for x in own) < most:
                    key = (g, t, sum(t <= x < d for x in own))
                    want[key] = want.get(key, 0) + price
        got = term.term_structure(quotes, deliveries, max_contracts=most).collect()
        assert {(r.group_id, r.trade_date, r.pos): r.price for r in got} == want and len(got) == len(want)


def test_late_options_stop_the_monitor(spark, tmp_path):
    days = spark.range(300).select(F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("trade_date"), F.lit("A").alias("exchange"), F.lit("g").alias("group_id"),
                                   F.lit("g1").alias("product_id"), (100 + F.col("id") % 7).cast("double").alias("close"), F.lit(5).cast("bigint").alias("open_interest"))
    days.write.parquet(str(tmp_path / "futures"))
    options = days.select("*", F.lit(100.0).alias("strike"), F.lit(100.0).alias("u_price"), F.lit(5).cast("bigint").alias("volume"), F.lit(0.2).alias("iv"), F.lit(9).alias("rdays"))
    options.write.parquet(str(tmp_path / "options"))
    futures, options = (spark.read.parquet(str(tmp_path / n)) for n in ("futures", "options"))
    last = str(DAY + datetime.timedelta(days=299))
    out = monitor.run_monitor(futures, options, as_of=last, anchor_group="g")
    assert out.count() == 1 and not any(str(tmp_path) in f for f in out.inputFiles())  # the quotes are not read again
    late = options.where(F.col("trade_date") < last)
    assert monitor.run_monitor(futures, late, as_of=last, anchor_group="g").count() == 0
    with pytest.raises(ValueError, match="options of A end on 2021-10-29"):
        monitor.run_monitor(futures, late, as_of=last, anchor_group="g", on_stale="raise")
    assert monitor.run_monitor(futures, late, anchor_group="g").count() == 1
    assert monitor.run_monitor(futures, options, as_of=last, anchor_group="g", on_stale="raise").count() == 1


def test_generated_methods_stay_small_enough_to_be_compiled(spark):
    from voltide.session import configure

    assert configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_documents_spread_by_their_number(spark, monkeypatch):
    from voltide.plans import documents

    monkeypatch.setattr(documents, "TASK_LINES", 1000)
    folder = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    for render in (documents.shfe_futures, documents.czce_futures, documents.cffe):
        assert render(spark, folder).rdd.getNumPartitions() == -(-lines // 1000) > 1
    # documents of a day too: their numbers go to as many tasks, once
    for render in (documents.dce_futures, documents.dce_options, documents.czce_futures, documents.czce_options):
        daily = render(spark, folder, daily=True)
        assert daily.rdd.getNumPartitions() == -(-lines // 1000)
        text = plan(daily.select("*"))
        assert text.count("Exchange hashpartitioning(exchange") == 1 and "RoundRobin" not in text
        assert sorted(daily.groupBy("exchange", "trade_date").count().select("count").distinct().collect()) == [(1,)]


def test_option_rows_of_documents_are_not_shuffled_to_their_closes(spark):
    from voltide.sources import exchanges

    record = '{"o_curinstrument":[{"INSTRUMENTID":"cu2103C4000  ","PRODUCTGROUPID":"cu","CLOSEPRICE":"1,002.5","OPENINTEREST":"7.9999999","VOLUME":"1,234"}]}'
    payloads = spark.range(50).select(F.lit("SHFE").alias("exchange"), F.lit(DAY).alias("trade_date"), F.lit(record).alias("payload"))
    closes = spark.createDataFrame([(DAY, "cu2103", 1.0), (DAY, "cu2103", 3.0), (DAY, "total", 9.0)], "trade_date date, product_id string, close double")
    out = exchanges.ingest_shfe_options(payloads, closes)
    row = out.distinct().collect()
    assert [tuple(r) for r in row] == [(DAY, "SHFE", "cu2103C4000", "cu", "C", 4000.0, 3.0, 1002.5, 1234, 8)] and out.count() == 50
    text = plan(out.select("*"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Exchange hashpartitioning" not in text


def test_a_name_is_matched_once(spark):
    from voltide.functions import text

    names = {
        "cu2103C4000": ("cu2103", "C", 4000.0), "\n 白糖21P5x": ("白糖21", "P", 5.0), "a1C2 b3P4": ("a1", "C", 2.0), "a1C2P3": ("a1C2", "P", 3.0),
        "C": None, "cuC4000": None, "": None, "\x01a\x01b\x01": None, "x\n": None, "a1C٣": ("a1", "C", None), None: None,
    }
    rows = spark.createDataFrame([(n,) for n in names], "n string").repartition(2)
    out = rows.select("n", text.parse_option_name(F.col("n")).alias("o")).select("n", "o.*")
    assert {r.n: tuple(r[1:]) for r in out.collect()} == {n: want or (None,) * 3 for n, want in names.items()}
    assert "regexp_extract" not in plan(out.select("*"))


def test_json_documents_are_rendered_before_they_are_read(spark):
    from voltide.plans import documents
    from voltide.sources import exchanges

    out = exchanges.ingest_shfe_futures(documents.shfe_futures(spark, "/root/testdata/sf0.001"))
    text = plan(out.select("*"))
    assert "StructsToJson" in text and not re.search(r"from_json\([^\n]*StructsToJson", text)


def test_staged_days_are_published_without_a_shuffle(spark, tmp_path, monkeypatch):
    path, staged = str(tmp_path / "store"), str(tmp_path / "staged")
    days = spark.range(400).select(F.date_add(F.lit(DAY), (F.col("id") % 4).cast("int")).alias("trade_date"), F.col("id").alias("x"))
    maintain.append_day(days.where("x < 300"), path)
    maintain.append_day(days.where("trade_date > '2021-01-05'"), staged)
    with monkeypatch.context() as m:
        m.setattr(type(days), "hint", lambda *a: pytest.fail("rows that are read from whole days were dealt out again"))
        maintain.publish(spark, staged, path, days.schema, "b")
    stored = spark.read.schema(days.schema).parquet(path)
    assert sorted(r.x for r in stored.collect()) == sorted([x for x in range(400) if x % 4 > 1 or x < 300])
    files = {str(p.parent.name) for p in (tmp_path / "store").glob("trade_date=*/*.parquet")}
    assert len(files) == 4 and len(list((tmp_path / "store").glob("trade_date=*/*.parquet"))) == 4
