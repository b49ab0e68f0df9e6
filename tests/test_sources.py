# -*- coding: utf-8 -*-
import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from voltide import schemas
from voltide.operators import aggregate, joins, maintain
from voltide.sources import documents, exchanges, files
from voltide.streaming.daily_sync import stream_daily_sync

DAY = datetime.date(2021, 1, 5)


def payloads(spark, *texts, day=DAY):
    rows = [("X", "k", day, t) for t in texts]
    return spark.createDataFrame(rows, schemas.RAW_PAYLOADS)


def shfe_doc(rows):
    names = list(exchanges.SHFE_FUTURES)
    return json.dumps({"o_curinstrument": [dict(zip(names, r)) for r in rows], "other": 1}, ensure_ascii=False)


SHFE_ROWS = [
    ("2103", "cu_f    ", 10, "", 12.5, 9, 11.0, "11.2", 200, -3, "1,234"),
    ("2104", "cu_f    ", "-", 10, 12.5, 9, 12.0, 11.2, "100", 4, 50),
    ("2105", "cu_f    ", 10, 10, 12.5, 9, 13.0, 11.2, 0, 0, 0),
    ("2106", "cu_f    ", 10, 10, 12.5, 9, 13.0, 11.2, None, 0, 0),
    ("小计", "cu_f    ", "", "", "", "", "", "", 300, 1, 1284),
    ("", "总计", "", "", "", "", "", "", 300, 1, 1284),
]


def test_shfe_futures(spark):
    doc = payloads(spark, shfe_doc(SHFE_ROWS), "{}", "")
    out = {r.product_id: r for r in exchanges.ingest_shfe_futures(doc).collect()}
    assert set(out) == {"cu2103", "cu2104", "total"}
    assert out["cu2103"].group_id == "cu_f" and out["cu2103"].volume == 1234 and out["cu2103"].open == 0.0
    assert out["cu2104"].pre_settle == 0.0
    index = aggregate.futures_index(exchanges.ingest_shfe_futures(doc)).first()
    assert index.close == round((11 * 200 + 12 * 100) / 300, 3)


def test_shfe_options(spark):
    names = list(exchanges.SHFE_OPTIONS)
    rows = [("cu2103C57000 ", "cu ", "2220", "7", "12"), ("cu2103P57000", "cu", 10, 7, 0), ("小计", "cu", "", "9", "0"),
            ("合计", "", "", "9", "12"), ("odd", "cu", 1, 1, 3)]
    doc = json.dumps({"o_curinstrument": [dict(zip(names, r)) for r in rows]}, ensure_ascii=False)
    under = spark.createDataFrame([(DAY, "cu2103", 58810.0), (DAY, "cu2103", 58810.0), (DAY, "total", 1.0)],
                                  "trade_date date, product_id string, close double")
    out = {r.product_id: r for r in exchanges.ingest_shfe_options(payloads(spark, doc), under).collect()}
    assert set(out) == {"cu2103C57000", "total", "odd"}
    row = out["cu2103C57000"]
    assert (row.otype, row.strike, row.u_price, row.close, row.volume) == ("C", 57000.0, 58810.0, 2220.0, 12)
    assert out["odd"].otype is None and out["odd"].u_price is None


def cffe_doc(rows):
    body = "".join(
        "<dailydata>" + "".join(f"<{k}>{v}</{k}>" if v != "" else f"<{k}/>" for k, v in r.items()) + "</dailydata>" for r in rows
    )
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<wrap><dailydatas>{body}</dailydatas></wrap>'


def test_cffe(spark):
    base = {"tradingday": "20210105", "closeprice": "5000", "preopeninterest": "90", "openinterest": "100", "volume": "7",
            "openprice": "", "settlementprice": "5001"}
    doc = payloads(spark, cffe_doc([
        {"instrumentid": "IF2101", "productid": "IF", **base},
        {"instrumentid": "IF2102", "productid": "IF", **{**base, "closeprice": "5100", "openinterest": "300"}},
        {"instrumentid": "IO2106-C-5400", "productid": "IO", **{**base, "closeprice": "350.6"}},
    ]), day=datetime.date(1999, 1, 1))
    rows = exchanges.ingest_cffe_futures(doc)
    out = {r.product_id: r for r in rows.collect()}
    assert set(out) == {"IF2101", "IF2102", "total"}
    assert out["IF2101"].oi_change == 10 and out["IF2101"].trade_date == DAY and out["IF2101"].high is None
    assert out["total"].close == 5000.0
    assert aggregate.index_on_totals(rows).where("product_id = 'total'").first().close == 5075.0
    index = spark.createDataFrame([(DAY, "csidx300", 5569.78)], "trade_date date, group_id string, close double")
    options = {r.product_id: r for r in exchanges.ingest_cffe_options(doc, index).collect()}
    assert options["IO2106-C-5400"].u_price == 5569.78 and options["IO2106-C-5400"].strike == 5400.0
    assert "total" in options


def html(titles, rows, head):
    cell = lambda tag, xs: "<tr class=r>" + "".join(f"<{tag} align='right'>{x}</{tag}>" for x in xs) + "</tr>"
    if head:
        return f"<p>x</p><table id=a><thead>{cell('td', titles)}</thead><tbody>{''.join(cell('td', r) for r in rows)}</tbody></table><table></table>"
    return f"<TABLE>{cell('th', titles)}{''.join(cell('td', r) for r in rows)}</TABLE><table><tr><td>no</td></tr></table>"


def test_dce(spark):
    titles = list(exchanges.DCE_FUTURES)
    rows = [["2105", "\n玉米 ", "-", "1", "2", "0", "<b>2,700</b>&nbsp;", "2,701", "1,000", "-5", "9"],
            ["2107", "玉米", "1", "1", "2", "0", "2800", "2", "0", "0", "0"],
            ["2105", "杂项", "1", "1", "2", "0", "10", "2", "5", "0", "1"],
            ["", "玉米小计", "", "", "", "", "", "", "1,000", "-5", "9"],
            ["", "总计", "", "", "", "", "", "", "1,000", "-5", "9"]]
    out = {(r.group_id, r.product_id): r for r in exchanges.ingest_dce_futures(payloads(spark, html(titles, rows, False))).collect()}
    assert set(out) == {("玉米", "c2105"), ("杂项", "2105"), ("玉米", "total")}
    row = out[("玉米", "c2105")]
    assert (row.close, row.settle, row.open_interest, row.pre_settle) == (2700.0, 2701.0, 1000, 0.0)
    titles = list(exchanges.DCE_OPTIONS)
    rows = [["c2105-C-2700", "玉米", "12.5", "3", "1,2"], ["", "玉米小计", "", "3", "0"], ["", "总计", "", "", ""]]
    under = spark.createDataFrame([(DAY, "c2105", 2700.0)], "trade_date date, product_id string, close double")
    got = {r.product_id: r for r in exchanges.ingest_dce_options(payloads(spark, html(titles, rows, False)), under).collect()}
    assert set(got) == {"c2105-C-2700", "total"} and got["c2105-C-2700"].u_price == 2700.0 and got["c2105-C-2700"].volume == 12


@pytest.mark.parametrize("new", [True, False])
def test_czce(spark, new):
    titles = ["合约代码" if new else "品种月份", "昨结算", "今开盘", "最高价", "最低价", "今收盘", "今结算", "成交量(手)",
              "持仓量" if new else "空盘量", "增减量"]
    rows = [["SR103", "1", "1", "2", "0", "5,200.00", "3", "7", "4", "1"], ["小计", "", "", "", "", "", "", "7", "4", "1"],
            ["CF105", "1", "1", "2", "0", "15000", "3", "7", "6", "1"], ["小计", "", "", "", "", "", "", "7", "6", "1"],
            ["总计", "", "", "", "", "", "", "14", "10", "2"]]
    out = [(r.group_id, r.product_id, r.close) for r in exchanges.ingest_czce_futures(payloads(spark, html(titles, rows, True))).collect()]
    assert sorted(out) == [("CF", "CF105", 15000.0), ("CF", "total", 0.0), ("SR", "SR103", 5200.0), ("SR", "total", 0.0)]
    titles = ["合约代码" if new else "品种代码", "今收盘", "持仓量" if new else "空盘量", "成交量(手)"]
    rows = [["SR103C5000", "224", "9", "5"], ["小计", "", "9", "5"], ["合计", "", "9", "5"]]
    under = spark.createDataFrame([(DAY, "SR103", 5216.0)], "trade_date date, product_id string, close double")
    got = {r.product_id: r for r in exchanges.ingest_czce_options(payloads(spark, html(titles, rows, True)), under).collect()}
    assert set(got) == {"SR103C5000", "total"} and got["total"].group_id == "SR" and got["SR103C5000"].u_price == 5216.0


def test_empty_documents(spark):
    for doc in ("", "<html></html>", "<table></table>", "no markup"):
        one = payloads(spark, doc)
        assert exchanges.ingest_dce_futures(one).count() == exchanges.ingest_czce_futures(one).count() == 0
        assert exchanges.ingest_cffe_futures(one).count() == exchanges.ingest_calendar(one).count() == 0


def test_long_document(spark):
    titles = list(exchanges.DCE_OPTIONS)
    rows = [[f"c2105-C-{i}", "玉米", "<i>1</i>" * 1, "3", str(i)] for i in range(1, 20001)]
    under = spark.createDataFrame([(DAY, "c2105", 2700.0)], "trade_date date, product_id string, close double")
    assert exchanges.ingest_dce_options(payloads(spark, html(titles, rows, False)), under).count() == 20000


def test_index_sources(spark):
    doc = json.dumps([{"indx_code": "000300", "tradedate": "2021-01-05 00:00:00", "tclose": "5368.5", "lclose": "1", "changes": "2"}])
    row = exchanges.ingest_csi_series(payloads(spark, doc)).first()
    assert (row.trade_date, row.group_id, row.close) == (DAY, "csidx300", 5368.5)
    page = ('<div class="item"><i class="g_name">上证50</i><i class="g_num">1</i><i class="time">更新：2021-01-05 15:30:00</i></div>'
            '<div class="item"><i class="g_name">\n沪深300 </i><i class="g_num">5368.5</i><i class="time">更新：2021-01-05 {}</i></div>')
    assert exchanges.ingest_csi_daily(payloads(spark, page.format("15:01:03"))).first().close == 5368.5
    assert exchanges.ingest_csi_daily(payloads(spark, page.format("15:01:00"))).count() == 0
    assert exchanges.ingest_csi_daily(payloads(spark, page.format("15:30:00"), day=datetime.date(2021, 1, 6))).count() == 0


def test_calendar_source(spark):
    doc = "<a><b><doc><pubdate>2021-02-11</pubdate><title>春节休市</title></doc><doc><pubdate>2021-02-10</pubdate></doc></b></a>"
    out = {str(r.cal_date): (r.title, r.closed) for r in exchanges.ingest_calendar(payloads(spark, doc)).collect()}
    assert out == {"2021-02-11": ("春节休市", True), "2021-02-10": (None, False)}


def test_binary_charset(spark, tmp_path):
    path = tmp_path / "2021-01-05.htm"
    titles = list(exchanges.DCE_OPTIONS)
    path.write_bytes(html(titles, [["c2105-C-1", "玉米", "1", "2", "3"]], False).encode("gb18030"))
    doc = documents.read_binary_payloads(spark, str(tmp_path), "DCE", "options")
    rows = documents.html_table_rows(doc, header="th").collect()
    assert rows[0].cells[1] == "玉米" and rows[0].trade_date == DAY


def test_html_skips_other_rows(spark):
    doc = "<table><thead><tr><td>a</td></tr></thead><tbody><tr></tr><tr><td>1 &lt; 2</td></tr></tbody></table>"
    rows = documents.html_table_rows(payloads(spark, doc)).collect()
    assert [(r.row_pos, r.titles, r.cells) for r in rows] == [(1, ["a"], ["1 < 2"])]


def quote(spark, rows):
    df = spark.createDataFrame(rows, "trade_date date, product_id string, close double")
    names = {"exchange": F.lit("X"), "group_id": F.lit("g")}
    full = df.withColumns(names)
    for f in schemas.FUTURES_QUOTES.fields:
        if f.name not in full.columns:
            full = full.withColumn(f.name, F.lit(None).cast(f.dataType))
    return full.select(*schemas.FUTURES_QUOTES.fieldNames())


def stored(spark, path):
    rows = spark.read.schema(schemas.FUTURES_QUOTES).parquet(path).collect()
    return sorted((str(r.trade_date), r.product_id, r.close) for r in rows)


def test_append_and_merge(spark, tmp_path):
    path = str(tmp_path / "q")
    d1, d2 = DAY, DAY + datetime.timedelta(days=1)
    keys = ["trade_date", "exchange", "group_id", "product_id"]
    maintain.append_day(quote(spark, [(d1, "a", 1.0), (d1, "b", 2.0)]), path)
    for _ in range(2):
        maintain.append_day(quote(spark, [(d2, "a", 3.0)]), path)
    maintain.append_day(quote(spark, []), path)
    assert stored(spark, path) == [("2021-01-05", "a", 1.0), ("2021-01-05", "b", 2.0), ("2021-01-06", "a", 3.0)]
    for _ in range(2):
        maintain.merge_day(spark, quote(spark, [(d1, "b", 5.0), (d1, "c", 6.0)]), path, schemas.FUTURES_QUOTES, keys)
    assert stored(spark, path) == [("2021-01-05", "a", 1.0), ("2021-01-05", "b", 5.0), ("2021-01-05", "c", 6.0),
                                   ("2021-01-06", "a", 3.0)]
    df = spark.read.schema(schemas.FUTURES_QUOTES).parquet(path)
    assert maintain.drop_last_date(df).count() == 3
    days = spark.createDataFrame([(d1 + datetime.timedelta(days=i),) for i in range(4)], "trade_date date")
    assert maintain.missing_dates(days, df).count() == 2
    assert maintain.missing_dates(days, df.limit(0)).count() == 4
    assert maintain.missing_dates(days, df.where(F.col("trade_date") == d2), holes=True).count() == 3


def test_csv_and_contract_files(spark, tmp_path):
    for month, price in ((3, 1.0), (6, 2.0), (9, 3.0)):
        folder = tmp_path / f"2021-{month:02d}-15.csv"
        quote(spark, [(DAY, "a", price)]).toPandas().to_csv(folder, index=False)
    (tmp_path / "notes.csv").write_text(",".join(schemas.FUTURES_QUOTES.fieldNames()) + "\n")
    rows = files.read_contract_files(spark, str(tmp_path), max_contracts=2).collect()
    assert sorted((str(r.delivery), r.close) for r in rows) == [("2021-06-15", 2.0), ("2021-09-15", 3.0)]
    assert files.read_quotes(spark, str(tmp_path)).count() == 3


def test_stream(spark, tmp_path):
    landing, out, check = (str(tmp_path / n) for n in ("landing", "out", "check"))
    os.makedirs(landing)

    def sync():
        stream_daily_sync(spark, landing, out, check, exchanges.ingest_shfe_futures, order=["volume"]).awaitTermination()

    payloads(spark, shfe_doc(SHFE_ROWS)).write.mode("append").parquet(landing)
    sync()
    first = stored(spark, out)
    assert ("2021-01-05", "cu2103", 11.0) in first and len(first) == 3
    payloads(spark, "{}").write.mode("append").parquet(landing)
    sync()
    assert stored(spark, out) == first
    late = [("2103", "cu_f", 10, 10, 12, 9, 11.5, 11.2, 200, -3, 1)]
    payloads(spark, shfe_doc(late)).write.mode("append").parquet(landing)
    payloads(spark, shfe_doc(late), day=DAY + datetime.timedelta(days=1)).write.mode("append").parquet(landing)
    sync()
    assert stored(spark, out) == sorted([r for r in first if r[1] != "cu2103"] + [
        ("2021-01-05", "cu2103", 11.5), ("2021-01-06", "cu2103", 11.5)])


def test_option_group_ids(spark):
    rows = [("CSI", "csidx300", "IO"), ("SHFE", "cu_f", "cu"), ("DCE", "玉米", "玉米"), ("CZCE", "SR", "SR")]
    df = spark.createDataFrame(rows, "exchange string, group_id string, want string")
    out = df.withColumn("got", joins.option_group_id(F.col("group_id"), F.col("exchange"))).collect()
    assert all(r.got == r.want for r in out)
