# -*- coding: utf-8 -*-
"""The same results as plain SQL for another engine (DuckDB) over the same tables.

Written apart from the Spark plans; only fixed values are shared: the constants,
the coefficients of the normal law and the names that rendered documents use.
"""

from voltide import constants as K
from voltide.functions import normal
from voltide.plans import documents as docs, views

ORACLE = {}


def _case(column: str, names: dict, position: int = None) -> str:
    whens = " ".join(
        f"WHEN '{kind}' THEN '{value if position is None else value[position]}'" for kind, value in names.items()
    )
    return f"CASE {column} {whens} END"


def half_even(x: str, scale: int) -> str:
    unit = float(10 ** scale)
    return f"round_even(round(({x}) * 1e9) / 1e9 * {unit!r}::DOUBLE, 0) / {unit!r}::DOUBLE"


def grid(x: str) -> str:
    return f"(round(({x}) * 1e10) / 1e10)"


def rnd(x: str, scale: int = 6, alias: str = None) -> str:
    # adding zero turns a negative zero into plain zero
    value = half_even(x, scale)
    return f"CASE WHEN {value} = 0 THEN 0.0::DOUBLE ELSE {value} END AS {alias or x}"


def day(x: str, alias: str = None) -> str:
    return f"strftime({x}, '%Y-%m-%d') AS {alias or x}"


KEYS = day("trade_date") + ", exchange, group_id"
STAMP = "strftime(add_month, '%y%m')"

VIEWS = {
    "lines": f"""
        SELECT l.*, p_type AS group_id, p_retailprice, CAST(l_shipdate AS DATE) AS trade_date,
               {_case('p_type', views.PRODUCTS, 0)} AS exchange, {_case('p_type', views.PRODUCTS, 1)} AS code,
               CAST(date_trunc('month', l_shipdate) AS DATE) + to_months(l_linenumber + 2) AS add_month,
               l_extendedprice / l_quantity AS px
        FROM lineitem l JOIN part ON l_partkey = p_partkey""",
    "fq": """
        SELECT trade_date, exchange, CAST(l_partkey AS VARCHAR) AS product_id, group_id,
               px * (1 - l_tax) AS pre_settle, px AS open, px * (1 + l_tax) AS high, px * (1 - l_discount) AS low,
               px AS close, px * (1 - l_discount / 2) AS settle, CAST(l_quantity AS BIGINT) AS open_interest,
               CAST(l_quantity - 5 * l_linenumber AS BIGINT) AS oi_change,
               CAST(l_quantity * l_linenumber AS BIGINT) AS volume
        FROM lines""",
    "cq": """
        SELECT trade_date, exchange, group_id, px AS close,
               CASE WHEN l_tax > 0 THEN px * (1 - l_tax) ELSE 0.0 END AS settle,
               last_day(CAST(date_trunc('quarter', trade_date) AS DATE) + to_months(CAST(l_linenumber * 3 + 2 AS INTEGER))) AS delivery
        FROM lines""",
    "oq0": """
        SELECT *, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE -1.0 END::DOUBLE AS cp,
               CASE WHEN l_linestatus = 'O' THEN 'C' ELSE 'P' END AS otype,
               round_even(p_retailprice * (0.80::DOUBLE + 0.05::DOUBLE * l_linenumber), 0) AS strike,
               CASE WHEN group_id IN ('STANDARD', 'MEDIUM') THEN '-' ELSE '' END AS dash,
               CASE WHEN exchange = 'CZCE' THEN strftime(add_month, '%y%m')[2:] ELSE strftime(add_month, '%y%m') END AS stamp
        FROM lines""",
    "oq": """
        SELECT trade_date, exchange, code || stamp || dash || otype || dash || CAST(CAST(strike AS BIGINT) AS VARCHAR) AS product_id,
               group_id, otype, strike, p_retailprice AS u_price,
               greatest(0.0::DOUBLE, cp * (p_retailprice - strike)) + p_retailprice * (0.01::DOUBLE + l_discount) AS close,
               CAST(l_quantity * l_linenumber AS BIGINT) AS volume, CAST(l_quantity AS BIGINT) AS open_interest,
               l_discount * 4 AS iv, CAST(l_quantity AS INTEGER) * 7 + 1 AS rdays, cp, code, stamp, add_month, dash,
               CAST(l_partkey AS VARCHAR) AS part
        FROM oq0""",
    "pin": """
        SELECT trade_date, group_id, part AS product_id, open_interest, u_price AS s, strike AS k, 0.12::DOUBLE AS r,
               rdays / 365.0::DOUBLE AS t, 0.1::DOUBLE + iv AS v, cp, close AS price
        FROM oq""",
    "idx": f"""
        SELECT trade_date, exchange, group_id, {half_even('sum(close * open_interest) / sum(open_interest)', 3)} AS close
        FROM fq GROUP BY ALL""",
    "sivs": f"""
        SELECT trade_date, exchange, group_id,
               {half_even("sum(CASE WHEN iv > 0.01 THEN iv * w * close * volume * least(rdays, 10) END) / nullif(sum(CASE WHEN iv > 0.01 THEN w * close * volume * least(rdays, 10) END), 0)", 3)} AS iv
        FROM weighted GROUP BY ALL""",
    "weighted": """
        SELECT *, CASE WHEN abs(strike - u_price) / u_price > 0.25 THEN 0.0
                       ELSE power((abs(strike - u_price) / u_price - 0.25) / 0.25, 2) END AS w
        FROM oq""",
    "rets": """
        SELECT *, ln(close / lag(close) OVER (PARTITION BY exchange, group_id ORDER BY trade_date)) AS ret FROM idx""",
    "hv": """
        SELECT trade_date, exchange, group_id, close,
               CASE WHEN count(ret) OVER a = 20 THEN sqrt(250 * var_samp(ret) OVER a) END AS hvm,
               CASE WHEN count(ret) OVER b = 250 THEN sqrt(250 * var_samp(ret) OVER b) END AS hvy
        FROM rets
        WINDOW a AS (PARTITION BY exchange, group_id ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
               b AS (PARTITION BY exchange, group_id ORDER BY trade_date ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)""",
}


def percent_of(below: str) -> str:
    return f"CASE WHEN {below} = 0 THEN 0 WHEN {below} <= 151 THEN ({below} - 1) // 3 ELSE 50 + ({below} - 151) // 2 END"


def percentile_view(source: str, column: str, out: str) -> str:
    """The reading of the rule by sorted thresholds, via the sorted window."""
    return f"""
        SELECT * EXCLUDE (win, cur), CASE WHEN len(list_filter(win, lambda x: x IS NOT NULL)) = 250
               THEN {percent_of('len(list_filter(win, lambda x: x < cur))')} END AS {out}
        FROM (SELECT *, {grid(column)} AS cur,
                     list({grid(column)}) OVER (PARTITION BY exchange, group_id ORDER BY trade_date
                                               ROWS BETWEEN 249 PRECEDING AND CURRENT ROW) AS win FROM {source})"""


def extremes_view(source: str, column: str, top: str, bottom: str) -> str:
    frame = "OVER (PARTITION BY exchange, group_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING)"
    return f"SELECT *, max({column}) {frame} AS {top}, min({column}) {frame} AS {bottom} FROM {source}"


VIEWS.update({
    "hvp": percentile_view("hv", "hvm", "hv_pct"),
    "hve": extremes_view("hvp", "hvm", "hv_max", "hv_min"),
    "joined": "SELECT h.*, s.iv FROM hve h LEFT JOIN sivs s USING (trade_date, exchange, group_id)",
    "ivp": percentile_view("joined", "iv", "iv_pct"),
    "ser": "SELECT *, hvm / nullif(hvy, 0) AS hv_ratio FROM (" + extremes_view("ivp", "iv", "iv_max", "iv_min") + ")",
    "snap": "SELECT * FROM ser WHERE hv_ratio IS NOT NULL AND trade_date = (SELECT max(trade_date) FROM fq WHERE group_id = 'STANDARD')",
})

# calendar -----------------------------------------------------------------------------
_in = lambda values: ", ".join(f"'{v}'" for v in values)
VIEWS.update({
    "cal": f"""
        SELECT cal_date, isodow(cal_date) < 6 AND strftime(cal_date, '%m-%d') NOT IN ({_in(views.HOLIDAYS)}) AS is_session,
               strftime(cal_date, '%m-%d') IN ({_in(views.DETAIL_CLOSED)}) AS closed
        FROM (SELECT CAST(unnest(generate_series(
                  CAST(date_trunc('month', min(l_shipdate)) AS DATE) - INTERVAL 4 MONTH,
                  CAST(max(l_shipdate) AS DATE) + INTERVAL 18 MONTH, INTERVAL 1 DAY)) AS DATE) AS cal_date FROM lineitem)""",
    "opens": "SELECT cal_date, row_number() OVER (ORDER BY cal_date) AS i FROM cal WHERE is_session AND NOT closed",
    "sess": "SELECT cal_date, row_number() OVER (ORDER BY cal_date) AS i FROM cal WHERE is_session",
})


def nth(source: str, anchor: str, shift: str, out: str) -> str:
    """n-th session by as-of joins: the first open day not before the anchor
    (or the last session not after it), then n - 1 further ones."""
    return f"""
        SELECT a.*, CASE WHEN a.{anchor} < (SELECT min(cal_date) FROM cal) OR a.{anchor} > (SELECT max(cal_date) FROM cal) THEN NULL
                         WHEN a.{shift} > 0 THEN f2.cal_date ELSE b2.cal_date END AS {out}
        FROM {source} a
        ASOF LEFT JOIN opens f ON a.{anchor} <= f.cal_date
        ASOF LEFT JOIN sess b ON a.{anchor} >= b.cal_date
        LEFT JOIN opens f2 ON f2.i = f.i + a.{shift} - 1
        LEFT JOIN sess b2 ON b2.i = b.i + a.{shift} + 1"""


_RULES = " UNION ALL ".join(
    f"SELECT '{p}' AS product, '{a}' AS anchor, {o} AS off, {n} AS shift, "
    f"{'NULL' if f is None else repr(f)}::DATE AS vf, {'NULL' if u is None else repr(u)}::DATE AS vt"
    for p, a, o, n, f, u in K.EXPIRY_RULES
)
_FRIDAY = "m + to_days(CAST((5 - isodow(m) + 7) % 7 + 14 AS INTEGER))"
VIEWS.update({
    "rules": _RULES,
    "months": """SELECT CAST(unnest(generate_series(date_trunc('month', min(cal_date)), date_trunc('month', max(cal_date)) + INTERVAL 2 MONTH,
                 INTERVAL 1 MONTH)) AS DATE) AS month FROM cal""",
    "ruled": f"""
        SELECT product, month, shift, CAST(CASE anchor WHEN 'third_friday' THEN {_FRIDAY}
               WHEN 'first_weekday' THEN m + to_days(CASE isodow(m) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END)
               ELSE last_day(m) - to_days(CASE isodow(last_day(m)) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END) END AS DATE) AS anchor_day
        FROM (SELECT *, CAST(month + to_months(off) AS DATE) AS m FROM months, rules
              WHERE (vf IS NULL OR month >= vf) AND (vt IS NULL OR month < vt))""",
    "expiries": "SELECT product, month, expiry FROM (" + nth("ruled", "anchor_day", "shift", "expiry") + ")",
    "dated": """
        SELECT o.*, expiry, datediff('day', trade_date, expiry) + 1 AS left_days
        FROM oq o LEFT JOIN expiries e ON e.product = o.code AND e.month = CAST(o.add_month AS DATE)""",
    "under": """
        SELECT trade_date, code || stamp AS u_id, max(px) AS u_price FROM oq0 GROUP BY ALL""",
})
VIEWS["cqp"] = "SELECT *, CASE WHEN settle <> 0 THEN settle ELSE close END AS price FROM cq"
VIEWS["deliv"] = "SELECT DISTINCT exchange, group_id, delivery FROM cq"


def term(kept: str) -> str:
    return f"""
        SELECT q.exchange, q.group_id, q.trade_date, q.pos, sum(q.price) AS price FROM (
            SELECT c.exchange, c.group_id, c.trade_date, c.price, CAST(p.pos AS INTEGER) AS pos
            FROM cqp c JOIN (
                SELECT t.exchange, t.group_id, t.trade_date, t.delivery, count(d.delivery) AS pos
                FROM (SELECT DISTINCT exchange, group_id, trade_date, delivery FROM cq JOIN {kept} USING (exchange, group_id, delivery)) t
                LEFT JOIN deliv d ON d.exchange = t.exchange AND d.group_id = t.group_id
                     AND d.delivery >= t.trade_date AND d.delivery < t.delivery
                GROUP BY ALL) p USING (exchange, group_id, trade_date, delivery)) q
        GROUP BY ALL"""


VIEWS["term"] = term("deliv")
VIEWS["newfiles"] = "SELECT * FROM deliv WHERE delivery IN (SELECT DISTINCT delivery FROM deliv ORDER BY 1 DESC LIMIT 12)"
VIEWS["termfiles"] = term("newfiles")


def sql(text: str, *extra: str) -> str:
    """Prefix a query with the views it needs (directly or through others)."""
    import re

    needed, todo = [], [text, *extra]
    while todo:
        piece = todo.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", piece):
                needed.append(name)
                todo.append(VIEWS[name])
    order, seen = [], set()

    def visit(name):
        if name in seen:
            return
        seen.add(name)
        for other in needed:
            if other != name and re.search(rf"(?:FROM|JOIN|,)\s+{other}\b", VIEWS[name]):
                visit(other)
        order.append(name)

    for name in needed:
        visit(name)
    if not order:
        return text
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n" + text


def put(name: str, text: str) -> None:
    ORACLE[name] = sql(text)


# --- aggregations -----------------------------------------------------------------------
put("futures_index", f"SELECT {KEYS}, close FROM idx")
put("total_rows", f"""
    SELECT {KEYS}, product_id, open_interest, volume, {rnd('close')} FROM fq
    UNION ALL
    SELECT {KEYS}, 'total', open_interest, volume, {rnd('close')} FROM (
        SELECT * FROM fq QUALIFY row_number() OVER (PARTITION BY trade_date, exchange, group_id
                                                   ORDER BY product_id, open_interest, volume, close) = 1)""")
put("index_on_totals", f"""
    SELECT {KEYS}, product_id, open_interest, {rnd('close')} FROM fq
    UNION ALL
    SELECT {day('q.trade_date', 'trade_date')}, q.exchange, q.group_id, 'total', q.open_interest, idx.close FROM (
        SELECT * FROM fq QUALIFY row_number() OVER (PARTITION BY trade_date, exchange, group_id
                                                   ORDER BY product_id, open_interest, close) = 1) q
    JOIN idx USING (trade_date, exchange, group_id)""")
_SIZES = {"volume": "volume", "turnover": "close * volume", "rdays": "rdays", "tr": "close * volume * least(rdays, 10)"}
for _name, _size in _SIZES.items():
    _ratio = (f"sum(CASE WHEN iv > 0.01 THEN iv * w * {_size} END) / "
              f"nullif(sum(CASE WHEN iv > 0.01 THEN w * {_size} END), 0)")
    put(f"siv_{_name}", f"SELECT {KEYS}, {half_even(_ratio, 3)} AS iv FROM weighted GROUP BY weighted.trade_date, exchange, group_id")
put("siv_on_totals", f"""
    SELECT {KEYS}, product_id, {rnd('iv')} FROM oq
    UNION ALL SELECT {KEYS}, 'total', iv FROM sivs""")
put("last_date", f"SELECT {day('max(trade_date)', 'trade_date')} FROM fq")
put("series_extremes", "SELECT exchange, group_id, max(close) AS close_max, min(close) AS close_min FROM idx GROUP BY ALL")

# --- time series ------------------------------------------------------------------------
put("log_return", f"SELECT {KEYS}, {rnd('ret', 6, 'log_return')} FROM rets")
put("hist_vol", f"SELECT {KEYS}, {rnd('hvm', 6, 'hv20')} FROM hv")
put("hv_ratio", f"SELECT {KEYS}, {rnd('hvm')}, {rnd('hvy')}, {rnd('hvm / nullif(hvy, 0)', 6, 'hv_ratio')} FROM hv")
put("order_value_volatility", f"""
    WITH s AS (SELECT CAST(o_orderdate AS DATE) AS trade_date, o_orderpriority AS group_id,
                      {half_even('sum(o_totalprice) / count(*)', 3)} AS close FROM orders GROUP BY ALL),
    q AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY group_id ORDER BY trade_date)) AS ret FROM s)
    SELECT {day('trade_date')}, group_id,
           {rnd('CASE WHEN count(ret) OVER a = 20 THEN sqrt(250 * var_samp(ret) OVER a) END', 6, 'hvm')},
           {rnd('CASE WHEN count(ret) OVER b = 250 THEN sqrt(250 * var_samp(ret) OVER b) END', 6, 'hvy')}
    FROM q WINDOW a AS (PARTITION BY group_id ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
                  b AS (PARTITION BY group_id ORDER BY trade_date ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)""")
put("rolling_percentile", f"SELECT {KEYS}, CAST(hv_pct AS DOUBLE) AS hv_pct FROM hvp")
_TOP = """top AS (SELECT exchange, group_id, list_sort(list(v)) AS vals FROM (
            SELECT exchange, group_id, round(close * 1e10) / 1e10 AS v FROM idx
            QUALIFY row_number() OVER (PARTITION BY exchange, group_id ORDER BY v DESC) <= 250) GROUP BY ALL)"""
VIEWS["top"] = _TOP[len("top AS ("):-1]
put("percentile_of_value", f"""
    SELECT {day('i.trade_date', 'trade_date')}, i.exchange, i.group_id,
           CAST(CASE WHEN len(vals) < 250 THEN 50 ELSE {percent_of(f"len(list_filter(vals, lambda x: x < {grid('i.close * 1.5')}))")} END AS INTEGER) AS percentile
    FROM idx i JOIN top USING (exchange, group_id)""")
put("percentile_thresholds", """
    SELECT exchange, group_id, CAST(n AS INTEGER) AS rank, vals[CASE WHEN n < 50 THEN 3 * (n + 1) ELSE 150 + 2 * (n - 49) END + 1] AS threshold
    FROM top, range(99) AS g(n) WHERE len(vals) = 250""")
put("expanding_extremes", f"SELECT {KEYS}, {rnd('hv_max')}, {rnd('hv_min')} FROM hve")
_MA = ", ".join(
    rnd(f"CASE WHEN count(close) OVER w{n} = {n} THEN avg(close) OVER w{n} END", 6, f"ma{n}") for n in (5, 10, 20)
)
_MAW = ", ".join(
    f"w{n} AS (PARTITION BY exchange, group_id ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 10, 20)
)
put("moving_averages", f"SELECT {day('idx.trade_date', 'trade_date')}, exchange, group_id, {_MA} FROM idx WINDOW {_MAW}")
put("latest_snapshot", f"""
    SELECT {KEYS}, close FROM idx WHERE idx.trade_date = (SELECT max(trade_date) FROM fq WHERE group_id = 'STANDARD')""")
VIEWS["cpct"] = extremes_view("(" + percentile_view("idx", "close", "per") + ")", "close", "\"max\"", "\"min\"")
put("tail5", f"""
    SELECT {day('c.trade_date', 'trade_date')}, exchange, group_id, strftime(c.trade_date, '%m%d') AS label, close,
           CAST(per AS DOUBLE) AS per, "max", "min"
    FROM cpct c QUALIFY row_number() OVER (PARTITION BY exchange, group_id ORDER BY c.trade_date DESC) <= 5""")
put("term_structure", f"SELECT {KEYS}, pos, {rnd('price', 4)} FROM term")
put("term_pct_change", f"""
    SELECT {day('a.trade_date', 'trade_date')}, a.exchange, a.group_id, a.pos, {rnd('(a.price - b.price) / b.price', 6, 'pct')}
    FROM term a LEFT JOIN term b ON a.exchange = b.exchange AND a.group_id = b.group_id AND a.trade_date = b.trade_date
         AND b.pos = a.pos - 1""")
_P = ", ".join(rnd(f"coalesce(sum(CASE WHEN pos = {i} THEN price END), 0.0)", 4, f"p{i}") for i in range(8))
put("term_matrix", f"SELECT {KEYS}, {_P} FROM term GROUP BY term.trade_date, exchange, group_id")
put("contract_files", f"SELECT {KEYS}, pos, {rnd('price', 4)} FROM termfiles")

# --- normalisation ----------------------------------------------------------------------
_PID = ("CASE WHEN volume = 350 THEN '总计' WHEN volume = 300 THEN '{sub}' ELSE product_id END")
put("to_numeric", f"""
    SELECT {day('trade_date')}, {_PID.format(sub='小计')} AS product_id,
           {rnd('CASE WHEN pre_settle = close THEN 0.0 ELSE pre_settle END', 6, 'pre_settle')}, 0.0::DOUBLE AS open,
           {half_even('close', 2)} AS close, -1.0::DOUBLE AS settle,
           CASE open_interest WHEN 13 THEN -1 WHEN 17 THEN 0 ELSE open_interest * 1000 END AS open_interest, volume FROM fq""")
put("normalize_futures", f"""
    SELECT {KEYS}, {_PID.format(sub='total')} AS product_id,
           {rnd('CASE WHEN pre_settle = close THEN 0.0 ELSE pre_settle END', 6, 'pre_settle')}, 0.0::DOUBLE AS open,
           {rnd('high')}, {rnd('low')}, {half_even('close', 2)} AS close, -1.0::DOUBLE AS settle,
           open_interest * 1000 AS open_interest, oi_change, volume
    FROM fq WHERE volume <> 350 AND open_interest NOT IN (13, 17)""")
put("normalize_options", f"""
    SELECT {KEYS}, {_PID.format(sub='total')} AS product_id, otype, strike, u_price,
           {rnd("CASE WHEN otype = 'C' THEN close ELSE 0.0 END", 6, 'close')},
           CASE WHEN open_interest IN (17, 50) THEN 0 ELSE volume END AS volume, open_interest
    FROM oq WHERE volume <> 350 AND open_interest <> 13 AND (open_interest NOT IN (17, 50) OR volume = 300)""")
put("quarantine_futures", f"""
    SELECT {day('trade_date')}, exchange, group_id || '  ' AS group_id, {_PID.format(sub='小计')} AS product_id,
           CASE open_interest WHEN 13 THEN '' WHEN 17 THEN '0' WHEN 19 THEN 'n/a' ELSE format('{{:,}}', open_interest * 1000) END AS open_interest,
           CAST(volume AS VARCHAR) || '.0' AS volume,
           CASE WHEN volume = 350 THEN 'grand_total' WHEN open_interest = 13 THEN 'missing_open_interest' WHEN open_interest = 17 THEN 'no_open_interest'
                ELSE 'unreadable_open_interest' END AS reject_reason
    FROM fq WHERE volume = 350 OR open_interest IN (13, 17, 19)""")
put("drop_sum_rows", f"SELECT {KEYS}, product_id, volume FROM fq WHERE volume % 100 <> 0")
put("fix_zero_close", f"SELECT {KEYS}, product_id, {rnd('CASE WHEN oi_change < 0 OR close = 0 THEN settle ELSE close END', 6, 'close')} FROM fq")
put("dedupe_last", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
           l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate
    FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
          ORDER BY lineitem.l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC,
                   l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1)""")
put("group_filter", f"SELECT CASE WHEN group_id IN ('STANDARD', 'MEDIUM') THEN 'in' ELSE 'out' END AS side, {KEYS}, product_id, volume FROM fq")
put("oi_change", "SELECT l_orderkey, l_linenumber, CAST(l_quantity * 100 AS BIGINT) - CAST(l_quantity * 90 AS BIGINT) AS oi_change FROM lineitem")
put("date_membership", f"""
    SELECT {KEYS}, product_id, volume FROM fq
    WHERE fq.trade_date > DATE '1996-01-01' AND fq.trade_date <= DATE '1999-12-31'
      AND fq.trade_date IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT')""")

# --- joins --------------------------------------------------------------------------------
put("underlying_join", f"""
    SELECT {day('o.trade_date', 'trade_date')}, exchange, group_id, product_id, code || stamp AS u_id, volume, {rnd('u.u_price', 6, 'u_price')}
    FROM oq o LEFT JOIN under u ON u.trade_date = o.trade_date AND u.u_id = o.code || o.stamp""")
put("futures_options_join", f"SELECT {KEYS}, close, iv FROM idx LEFT JOIN sivs USING (trade_date, exchange, group_id)".replace(
    KEYS, "strftime(idx.trade_date, '%Y-%m-%d') AS trade_date, exchange, group_id"))
# the futures id of the view is the option id for every product
put("options_group_id", f"""
    SELECT {day('trade_date')}, exchange, CASE WHEN fq.group_id = 'STANDARD' THEN 'csidx300' ELSE lower(fq.group_id) || '_f' END AS group_id, product_id,
           CASE WHEN fq.group_id = 'STANDARD' THEN 'IO' WHEN exchange = 'SHFE' THEN lower(fq.group_id) ELSE lower(fq.group_id) || '_f' END AS opt_group_id,
           volume FROM fq""")
_CODES = {kind: K.DCE_CODES.get(name, "") for kind, name in docs.DCE_NAMES.items()}
put("attach_code", f"""
    SELECT {day('trade_date')}, {_case('fq.group_id', docs.DCE_NAMES)} AS group_id,
           {_case('fq.group_id', _CODES)} || product_id AS product_id, volume FROM fq""")

# --- text and numbers -----------------------------------------------------------------------
put("date_labels", f"""
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS trade_date, strftime(o_orderdate, '%m%d') AS label,
           CASE WHEN CAST(o_orderdate AS DATE) IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity > 48) THEN 'd' ELSE '' END AS d FROM orders""")
put("parse_option_name", f"""
    SELECT {day('trade_date')}, product_id,
           CASE WHEN dash = '' THEN code || stamp ELSE '' END AS plain_u_id, CASE WHEN dash = '' THEN otype ELSE '' END AS plain_otype,
           CASE WHEN dash = '' THEN strike ELSE -1.0 END AS plain_strike,
           CASE WHEN dash = '-' THEN code || stamp ELSE '' END AS dashed_u_id, CASE WHEN dash = '-' THEN otype ELSE '' END AS dashed_otype,
           CASE WHEN dash = '-' THEN strike ELSE -1.0 END AS dashed_strike FROM oq""")
put("parse_contract", f"""
    SELECT {day('trade_date')}, product_id, code AS product, strftime(add_month, '%Y-%m-%d') AS month, otype, strike FROM oq""")
put("fill_year", """
    WITH q AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d, CAST(l_quantity AS INTEGER) AS n,
                      year(CAST(l_shipdate AS DATE) + 732) AS y FROM lineitem)
    SELECT l_orderkey, l_linenumber, strftime(d, '%Y-%m-%d') AS as_of, lpad(CAST(n AS VARCHAR), 2, '0') AS year_text,
           CAST((SELECT max(g) FROM range(1800, 2100) r(g) WHERE g % 100 = n AND g < y) AS VARCHAR) || strftime(d, '-%m-01') AS two_digits,
           CAST((SELECT max(g) FROM range(1800, 2100) r(g) WHERE g % 10 = n % 10 AND g < y) AS VARCHAR) || strftime(d, '-%m-01') AS one_digit
    FROM q""")
put("text_functions", f"""
    SELECT {day('trade_date')}, product_id, regexp_replace(product_id, '[0-9]+', '', 'g') AS no_digits, lower(group_id) AS no_suffix,
           product_id AS no_mark, CASE WHEN code = 'IO' THEN 'csidx300' || dash || otype || dash || CAST(CAST(strike AS BIGINT) AS VARCHAR) ELSE product_id END AS underlying,
           strftime(oq.trade_date, '%Y-%m-%d') AS from_compact, strftime(oq.trade_date, '%Y-%m-%d') AS from_midnight,
           CASE WHEN otype = 'P' THEN 1 ELSE 0 END AS is_closed, strftime(oq.trade_date, '%m%d') AS label FROM oq""")
put("math_functions", f"""
    SELECT {day('trade_date')}, product_id, open_interest, {rnd('ln(price / s)', 8, 'ln_x')}, {rnd('sqrt(price / s)', 8, 'sqrt_x')},
           {rnd('(price / s) * (price / s)', 8, 'square_x')}, {rnd('abs(s - k)', 6, 'abs_x')}, {half_even('price / s', 3)} AS half_even_x FROM pin""")


def cdf(x: str) -> str:
    """The published approximation, as in the module for the normal law."""
    def poly(cs):
        out = f"{cs[0]!r}::DOUBLE"
        for c in cs[1:]:
            out = f"({out} * abs({x}) + {c!r}::DOUBLE)"
        return out

    frac = f"(abs({x}) + 0.65::DOUBLE)"
    for n in (4, 3, 2, 1):
        frac = f"(abs({x}) + {n}.0::DOUBLE / {frac})"
    bell = f"exp(-0.5::DOUBLE * {x} * {x})"
    upper = (f"CASE WHEN abs({x}) < {normal.SPLIT} THEN {bell} * {poly(normal.NUMERATOR)} / {poly(normal.DENOMINATOR)} "
             f"WHEN abs({x}) <= 37 THEN {bell} / {frac} / {normal.ROOT_TWO_PI}::DOUBLE ELSE 0.0 END")
    return f"(CASE WHEN {x} > 0 THEN 1.0 - ({upper}) ELSE ({upper}) END)"


def pdf(x: str) -> str:
    return f"(exp(-0.5::DOUBLE * {x} * {x}) * 0.3989422804014327::DOUBLE)"


put("norm_functions", f"""
    SELECT {day('trade_date')}, product_id, open_interest, {rnd('x')}, round({cdf('x')}, 10) AS cdf, round({pdf('x')}, 10) AS pdf
    FROM (SELECT *, (s - k) / 25.0::DOUBLE AS x FROM pin)""")
put("formats", f"""
    SELECT {day('trade_date')}, product_id,
           CASE WHEN iv > 0 THEN printf('%.1f', {half_even('(iv + rdays / 10000::DOUBLE) * 100', 1)}) ELSE '-' END AS iv_text,
           CASE WHEN iv > 0 THEN CAST(rdays AS VARCHAR) ELSE '-' END AS days_text FROM oq""")

# --- calendar ----------------------------------------------------------------------------------
put("trading_calendar", f"SELECT {day('cal_date')}, CAST(is_session AS INTEGER) AS is_session, CASE WHEN closed THEN 1 ELSE -1 END AS closed FROM cal")
put("sessions", f"""
    SELECT {day('cal_date', 'trade_date')} FROM opens, (SELECT CAST(max(l_shipdate) AS DATE) AS last FROM lineitem)
    WHERE cal_date BETWEEN last - 500 AND last""")
put("open_days", f"""
    SELECT 'detail' AS check, {KEYS}, product_id, volume FROM fq JOIN opens ON cal_date = fq.trade_date
    UNION ALL
    SELECT 'session' AS check, {KEYS}, product_id, volume FROM fq JOIN sess ON cal_date = fq.trade_date""".replace("strftime(trade_date", "strftime(fq.trade_date"))
VIEWS["shifts"] = """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS anchor,
    CASE WHEN l_linestatus = 'O' THEN l_linenumber ELSE -l_linenumber END AS shift FROM lineitem"""
put("nth_session", f"""
    SELECT l_orderkey, l_linenumber, {day('anchor')}, shift, {day('session_date')} FROM ({nth('shifts', 'anchor', 'shift', 'session_date')}) q
    """.replace("strftime(anchor", "strftime(q.anchor"))
put("expiry_table", f"SELECT product, {day('month')}, {day('expiry')} FROM expiries e WHERE e.expiry IS NOT NULL".replace(
    "strftime(month", "strftime(e.month").replace("strftime(expiry", "strftime(e.expiry"))
put("contract_expiry", """
    SELECT strftime(d.trade_date, '%Y-%m-%d') AS trade_date, product_id, strftime(d.expiry, '%Y-%m-%d') AS expiry,
           CAST(greatest(left_days, 0) AS INTEGER) AS rdays FROM dated d""")
put("business_anchors", f"""
    SELECT strftime(m, '%Y-%m-%d') AS month, strftime({_FRIDAY}, '%Y-%m-%d') AS third_friday,
           strftime((SELECT min(d) FROM generate_series(m, last_day(m), INTERVAL 1 DAY) g(d) WHERE isodow(d) < 6), '%Y-%m-%d') AS first_weekday,
           strftime((SELECT max(d) FROM generate_series(m, last_day(m), INTERVAL 1 DAY) g(d) WHERE isodow(d) < 6), '%Y-%m-%d') AS last_weekday
    FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders)""")
put("month_starts", """
    WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS a FROM orders),
    m AS (SELECT DISTINCT CAST(date_trunc('month', g) AS DATE) AS s FROM (SELECT unnest(generate_series(
            (SELECT min(a) FROM d) - INTERVAL 1200 DAY, (SELECT max(a) FROM d), INTERVAL 1 DAY)) AS g))
    SELECT strftime(a, '%Y-%m-%d') AS as_of, strftime(s, '%Y-%m-%d') AS month_start FROM d JOIN m ON s >= a - 1100 AND s <= a""")
put("report_day", """
    SELECT event_id, strftime(CASE WHEN hour(ts) < 8 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END, '%Y-%m-%d') AS report_day FROM events""")


# --- pricing -------------------------------------------------------------------------------------
def staged(model: str, source: str = "pin") -> str:
    drift = "0.5 * v * v" if model == "b76" else "r + 0.5 * v * v"
    return f"""(SELECT *, {cdf('z1')} AS n1, {cdf('z2')} AS n2, {pdf('d1')} AS p1 FROM (
        SELECT *, cp * d1 AS z1, cp * (d1 - v * sqrt(t)) AS z2, exp(-r * t) AS disc FROM (
        SELECT *, (ln(s / k) + ({drift}) * t) / (v * sqrt(t)) AS d1 FROM {source})))"""


_PRICE = {"b76": "cp * (s * n1 - k * n2) * disc", "bs": "cp * (s * n1 - k * n2 * disc)"}
for _m in ("b76", "bs"):
    _c = "disc" if _m == "b76" else "1.0"
    _theta = f"(-(s * {_c} * p1 * v / (2 * sqrt(t))) - cp * r * k * disc * n2" + (" + cp * r * s * disc * n1" if _m == "b76" else "") + ") / 240"
    put(f"{_m}_price", f"SELECT {day('trade_date')}, product_id, open_interest, {rnd(_PRICE[_m], 6, 'price')} FROM {staged(_m)}")
    put(f"{_m}_greeks", f"""
        SELECT {day('trade_date')}, product_id, open_interest, {rnd(_PRICE[_m], 6, 'price')},
               {rnd(f'cp * {_c} * n1 * s * 0.01', 6, 'delta')}, {rnd(f'{_c} * p1 / (s * v * sqrt(t)) * s * s * 0.0001', 6, 'gamma')},
               {rnd(_theta, 6, 'theta')}, {rnd(f's * {_c} * p1 * sqrt(t) / 100', 6, 'vega')}
        FROM {staged(_m)}""")


def tree(source: str, vol: str, out: str, n: int = K.TREE_STEPS, keep=(0,)) -> str:
    """Tree values as nested subselects, one list of node values per level."""
    inner = f"""SELECT *, exp({vol} * sqrt(t / {n})) AS u_, exp(-r * t / {n}) AS q_ FROM {source}"""
    inner = f"SELECT *, (1 - 1 / u_) / (u_ - 1 / u_) AS p_ FROM ({inner})"
    inner = f"SELECT *, [greatest(0.0, cp * (s * power(u_, {n} - 2 * j) - k)) for j in range({n + 1})] AS l_ FROM ({inner})"
    kept = ""
    for level in range(n - 1, -1, -1):
        step = (f"[greatest(q_ * (p_ * l_[j + 1] + (1 - p_) * l_[j + 2]), cp * (s * power(u_, {level} - 2 * j) - k), 0.0) "
                f"for j in range({level + 1})]")
        extra = f", {step} AS {out}{level}" if level in keep and level else ""
        inner = f"SELECT * REPLACE ({step} AS l_){extra} FROM ({inner})"
    return f"(SELECT * EXCLUDE (l_, p_, q_), l_[1] AS {out} FROM ({inner}))"


put("crr_price", f"SELECT {day('trade_date')}, product_id, open_interest, {rnd('pr', 6, 'price')} FROM {tree('pin', 'v', 'pr')}")
_base = tree("pin", "v", "pr", keep=(0, 1, 2)).replace("EXCLUDE (l_, p_, q_)", "EXCLUDE (l_, p_, q_, u_), u_ AS up")
_bump = tree(f"{_base}", "(v * 1.001)", "pb")
_g = lambda i, j: f"(pr2[{i}] - pr2[{j}]) / (s * power(up, {4 - 2 * i}) - s * power(up, {4 - 2 * j}))"
put("crr_greeks", f"""
    SELECT {day('trade_date')}, product_id, open_interest, {rnd('pr', 5, 'price')},
           {rnd('(pr1[1] - pr1[2]) / (s * up - s / up) * s * 0.01', 5, 'delta')},
           {rnd(f'({_g(1, 2)} - {_g(2, 3)}) / (0.5 * (s * up * up - s / up / up)) * s * s * 0.0001', 5, 'gamma')},
           {rnd('(pr2[2] - pr) / (2 * t / 15 * 240)', 5, 'theta')}, {rnd('(pb - pr) / (0.001 * v * 100)', 5, 'vega')}
    FROM {_bump}""")


def european_iv(model: str, method: str) -> str:
    """The iteration as a recursive query; one step per row and level."""
    carry = "exp(-r * t)" if model == "b76" else "1.0"
    slope = f"s * {carry} * {pdf('(1.0)')} * sqrt(t)" if method == "chord" else f"s * {carry} * p1 * sqrt(t)"
    start = "0.01" if method == "chord" else "greatest(sqrt(2 * abs(ln(s / k)) / t), 0.1)"
    true_floor = "cp * (s - k) * exp(-r * t)" if model == "b76" else "cp * (s - k * exp(-r * t))"
    live = f"price > 0 AND price > {true_floor}" if method == "newton" else "price > 0 AND price > CASE WHEN cp > 0 THEN (s - k) * exp(-r * t) ELSE k * exp(-r * t) - s END"
    return f"""
    steps AS (
        SELECT id, 0 AS i, s, k, r, t, cp, price, {start}::DOUBLE AS v, NULL::DOUBLE AS iv FROM numbered WHERE {live}
        UNION ALL
        SELECT id, i + 1, s, k, r, t, cp, price, v + dx,
               CASE WHEN abs(dx) < 0.00001 THEN round(v, 4) WHEN v + dx <= 0 THEN 0 WHEN i + 1 = 50 THEN round(v + dx, 4) END
        FROM (SELECT *, (price - ({_PRICE[model]})) / ({slope}) AS dx FROM {staged(model, '(SELECT * FROM steps WHERE iv IS NULL)')})
        WHERE i < 50
    )"""


for _m in ("b76", "bs"):
    for _way, _suffix in (("chord", ""), ("newton", "_newton")):
        _head = sql("SELECT * FROM pin")
        _ctes = _head[len("WITH "):_head.rindex("SELECT * FROM pin")]
        ORACLE[f"{_m}_iv{_suffix}"] = f"""WITH RECURSIVE {_ctes},
        numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM pin), {european_iv(_m, _way)}
        SELECT strftime(n.trade_date, '%Y-%m-%d') AS trade_date, product_id, open_interest, coalesce(f.iv, 0.0) AS iv
        FROM numbered n LEFT JOIN (SELECT id, iv FROM steps WHERE iv IS NOT NULL) f USING (id)"""


def american_iv(source_ctes: str, numbered: str, final: str) -> str:
    base = tree("(SELECT * FROM steps WHERE iv IS NULL AND i < 50)", "v", "pr").replace("EXCLUDE (l_, p_, q_)", "EXCLUDE (l_, p_, q_, u_)")
    both = tree(base, "(v * 1.001)", "pb")
    return f"""WITH RECURSIVE {source_ctes},
    numbered AS MATERIALIZED ({numbered}),
    steps AS (
        SELECT id, 0 AS i, s, k, r, t, cp, price, 0.3::DOUBLE AS v, NULL::DOUBLE AS iv FROM numbered
        WHERE price > 0 AND price > cp * (s - k)
        UNION ALL
        SELECT id, i + 1, s, k, r, t, cp, price, v + coalesce(dx, 0),
               CASE WHEN dx IS NULL OR abs(dx) < 0.00001 THEN round(v, 4) WHEN v + dx <= 0 THEN 0 WHEN i + 1 = 50 THEN round(v + dx, 4) END
        FROM (SELECT *, (price - pr) / nullif((pb - pr) / (v * 0.001), 0) AS dx FROM {both})
    )
    {final}"""


_head = sql("SELECT * FROM pin")
ORACLE["american_iv"] = american_iv(
    _head[len("WITH "):_head.rindex("SELECT * FROM pin")],
    "SELECT *, row_number() OVER () AS id FROM pin",
    """SELECT strftime(n.trade_date, '%Y-%m-%d') AS trade_date, product_id, open_interest, coalesce(f.iv, 0.0) AS iv
       FROM numbered n LEFT JOIN (SELECT id, iv FROM steps WHERE iv IS NOT NULL) f USING (id)""",
)
_head = sql("SELECT * FROM dated")
_DATED = _head[len("WITH "):_head.rindex("SELECT * FROM dated")]
_SOLVE = """SELECT *, row_number() OVER () AS id, u_price AS s, strike AS k, 0.12::DOUBLE AS r, left_days / 365.0::DOUBLE AS t, close AS price FROM dated"""
_STATUS = """CASE WHEN expiry IS NULL THEN 'no_calendar' WHEN left_days <= 0 THEN 'expired' WHEN close <= cp * (u_price - strike) THEN 'below_intrinsic' ELSE 'ok' END"""
ORACLE["quote_iv"] = american_iv(_DATED, _SOLVE, f"""
    SELECT strftime(n.trade_date, '%Y-%m-%d') AS trade_date, exchange, group_id, product_id, volume, coalesce(f.iv, 0.0) AS iv,
           CAST(left_days AS INTEGER) AS rdays, {_STATUS} AS iv_status
    FROM numbered n LEFT JOIN (SELECT id, iv FROM steps WHERE iv IS NOT NULL) f USING (id)""")
# index options by the European chord iteration, all others on the tree
_tree_sql = american_iv(_DATED, _SOLVE, "")
_euro = european_iv("b76", "chord").strip().replace("steps", "euro").replace(
    "FROM numbered WHERE", "FROM numbered WHERE code = 'IO' AND price > cp * (s - k) AND")
ORACLE["quote_iv_by_exercise_style"] = _tree_sql.replace(
    "FROM numbered\n        WHERE price > 0", "FROM numbered\n        WHERE code <> 'IO' AND price > 0") + f""", {_euro}
    SELECT strftime(n.trade_date, '%Y-%m-%d') AS trade_date, exchange, group_id, product_id, volume, coalesce(f.iv, 0.0) AS iv,
           CAST(left_days AS INTEGER) AS rdays, {_STATUS} AS iv_status
    FROM numbered n LEFT JOIN (SELECT id, iv FROM steps WHERE iv IS NOT NULL UNION ALL SELECT id, iv FROM euro WHERE iv IS NOT NULL) f USING (id)"""
ORACLE["recompute_history"] = american_iv(_DATED, _SOLVE, f"""
    SELECT strftime(td, '%Y-%m-%d') AS trade_date, exchange, group_id,
           {half_even("sum(CASE WHEN iv > 0.01 THEN iv * w END) / nullif(sum(CASE WHEN iv > 0.01 THEN w END), 0)", 3)} AS iv
    FROM (SELECT n.trade_date AS td, exchange, group_id, f.iv,
                 CASE WHEN abs(k - s) / s > 0.25 THEN 0.0 ELSE power((abs(k - s) / s - 0.25) / 0.25, 2) END * close * volume * least(left_days, 10) AS w
          FROM numbered n LEFT JOIN (SELECT id, iv FROM steps WHERE iv IS NOT NULL) f USING (id))
    GROUP BY td, exchange, group_id""")
ORACLE["recompute_stored"] = f"""SELECT q.*, s.iv AS siv FROM ({ORACLE['quote_iv']}) q LEFT JOIN ({ORACLE['recompute_history']}) s USING (trade_date, exchange, group_id)"""
put("route_model", f"""
    SELECT {KEYS}, product_id, volume, code AS product, CASE WHEN code IN ('IO', 'au') THEN 'b76' ELSE 'crr' END AS by_style, 'crr' AS by_default FROM oq""")
ORACLE["quote_status"] = american_iv(_DATED, _SOLVE, f"""
    SELECT *, CASE WHEN iv_status IN ('ok', 'total') THEN '' ELSE iv_status END AS reject_reason FROM (
    SELECT strftime(CASE WHEN volume % 8 = 4 THEN n.trade_date + 400 ELSE n.trade_date END, '%Y-%m-%d') AS trade_date, exchange, group_id,
           CASE volume % 8 WHEN 0 THEN 'total' WHEN 1 THEN 'odd' WHEN 2 THEN 'zz' || regexp_replace(product_id, '^[A-Za-z]+', '')
                WHEN 3 THEN 'cu9001C100' ELSE product_id END AS product_id, volume,
           CASE WHEN volume % 8 = 0 THEN 'total' WHEN volume % 8 = 1 THEN 'unparsed' WHEN volume % 8 = 2 THEN 'unsupported_product'
                WHEN volume % 8 = 3 OR expiry IS NULL THEN 'no_calendar' WHEN volume % 8 = 4 OR left_days <= 0 THEN 'expired'
                WHEN volume % 8 = 5 OR (volume % 8 = 6 AND cp * (u_price - strike) <= 0) THEN 'no_price'
                WHEN volume % 8 = 6 OR close <= cp * (u_price - strike) THEN 'below_intrinsic' ELSE 'ok' END AS iv_status
    FROM numbered n)""")
_both = staged("bs", "(SELECT * EXCLUDE (n1, n2, p1, z1, z2, disc, d1), " + _PRICE["b76"] + " AS b76 FROM " + staged("b76", tree("pin", "v", "pr")) + ")")
put("sql_functions", f"""
    SELECT {day('trade_date')}, product_id, open_interest, round(b76, 6) AS b76, round({_PRICE['bs']}, 6) AS bs, round(pr, 6) AS crr,
           round({cdf('x')}, 10) AS cdf, round(exp(-0.5 * x * x) * 0.3989422804014327, 10) AS pdf FROM (SELECT *, (s - k) / 25 AS x FROM {_both})""")

ORACLE["sql_implied_vol"], ORACLE["sql_european_implied_vol"] = ORACLE["american_iv"], ORACLE["b76_iv"]

# --- reports -----------------------------------------------------------------------------------
_PERCENTS = ["hvm", "hv_min", "hv_max", "hvy", "iv", "iv_min", "iv_max", "hv_ratio"]
_PCT = "CAST(hv_pct AS DOUBLE) AS hv_pct, CAST(iv_pct AS DOUBLE) AS iv_pct"
put("monitor_snapshot", f"SELECT {day('trade_date')}, group_id, {', '.join(rnd(c) for c in _PERCENTS)}, {_PCT} FROM snap")
put("product_series", f"SELECT {KEYS}, close, {', '.join(rnd(c) for c in _PERCENTS)}, {_PCT} FROM ser")
ORACLE["series_stream"] = ORACLE["product_series"]
_NAMES = {kind: K.DISPLAY_NAMES[gid] for kind, gid in docs.REPORT_IDS.items() if gid in K.DISPLAY_NAMES}


def shown(source: str) -> str:
    cells = ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE printf('%.1f', {half_even(f'{c} * 100', 1)}) END AS {c}" for c in _PERCENTS)
    return f"""SELECT {_case('group_id', _NAMES)} AS name, {cells},
               coalesce(CAST(hv_pct AS VARCHAR), '-') AS hv_pct,
               coalesce(CAST(CASE WHEN hv_pct IS NOT NULL THEN iv_pct END AS VARCHAR), '-') AS iv_pct
               FROM {source} WHERE {_case('group_id', _NAMES)} IS NOT NULL"""


put("notification_table", shown("snap"))
put("write_report", shown("snap"))
_ORDER = ["name", *_PERCENTS, "hv_pct", "iv_pct"]
put("markdown_rows", f"SELECT '| ' || {' || chr(32) || chr(124) || chr(32) || '.join(_ORDER)} || ' |' AS line FROM ({shown('snap')})")
_REASON = """CASE WHEN iv_pct >= 90 THEN 'iv percentile high' WHEN iv_pct <= 15 THEN 'iv percentile low'
             WHEN iv_pct IS NULL AND iv IS NOT NULL AND iv >= iv_max * 0.9 THEN 'iv near maximum'
             WHEN iv_pct IS NULL AND iv IS NOT NULL AND iv <= iv_min * 1.1 THEN 'iv near minimum' END"""
put("iv_alerts", f"""
    SELECT {KEYS}, iv, CAST(iv_pct AS DOUBLE) AS iv_pct, {_REASON} AS alert_reason FROM ser
    WHERE hv_ratio IS NOT NULL AND ({_REASON}) IS NOT NULL""")
VIEWS["display"] = shown("ser").replace("IS NOT NULL", "IS NOT NULL") + " AND hv_ratio IS NOT NULL"
VIEWS["alerted"] = f"""
    SELECT name, iv, iv_pct, iv_max, iv_min, {_REASON.replace('iv_pct', 'np').replace('iv_max', 'nx').replace('iv_min', 'nn').replace('iv IS', 'ni IS').replace('iv >=', 'ni >=').replace('iv <=', 'ni <=')} AS alert_reason
    FROM (SELECT *, TRY_CAST(iv_pct AS DOUBLE) AS np, TRY_CAST(iv AS DOUBLE) AS ni, TRY_CAST(iv_max AS DOUBLE) AS nx,
                 TRY_CAST(iv_min AS DOUBLE) AS nn FROM display)"""
put("iv_alerts_on_display", """
    SELECT name, iv, iv_pct, iv_max, iv_min, alert_reason, count(*) AS n FROM alerted WHERE alert_reason IS NOT NULL GROUP BY ALL""")
put("alert_lines", r"""
    SELECT '> ' || name || ': iv ' || iv || ' p ' || iv_pct || '  ' || chr(10) || '  ' AS line FROM alerted WHERE alert_reason IS NOT NULL""")

# the daily run with the order values as one more exchange
_saved = dict(VIEWS)
VIEWS["idx0"] = VIEWS["idx"]
VIEWS["idx"] = f"""SELECT * FROM idx0 UNION ALL
    SELECT CAST(o_orderdate AS DATE), 'CSI', o_orderpriority, {half_even('sum(o_totalprice) / count(*)', 3)} FROM orders GROUP BY 1, 3"""
VIEWS["joined"] = "SELECT h.*, s.iv FROM hve h LEFT JOIN sivs s ON s.trade_date = h.trade_date AND s.group_id = h.group_id"
put("run_monitor", f"""
    SELECT {day('ser.trade_date', 'trade_date')}, group_id, {', '.join(rnd(c, 4) for c in _PERCENTS)}, {_PCT} FROM ser
    WHERE hv_ratio IS NOT NULL AND ser.trade_date = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderpriority = '3-MEDIUM')""")
VIEWS.clear()
VIEWS.update(_saved)

# --- storage ------------------------------------------------------------------------------------
put("merge_keep_last", f"""
    SELECT l_orderkey, l_linenumber, strftime(d, '%Y-%m-%d') AS trade_date, round(p, 2) AS l_extendedprice, l_quantity, l_linestatus
    FROM (SELECT *, CAST(l_shipdate AS DATE) AS d, CASE WHEN l_linestatus = 'O' THEN l_extendedprice + 1 ELSE l_extendedprice END AS p FROM lineitem
          QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                  ORDER BY CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END DESC, l_shipdate DESC, l_extendedprice DESC, l_quantity DESC) = 1)""")
put("drop_last_date", f"SELECT {KEYS}, close FROM idx WHERE idx.trade_date < (SELECT max(trade_date) FROM fq)")
put("missing_dates", """
    SELECT 'after last' AS kind, strftime(cal_date, '%Y-%m-%d') AS trade_date FROM opens
    WHERE cal_date > (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)
    UNION ALL
    SELECT 'hole', strftime(cal_date, '%Y-%m-%d') FROM opens WHERE cal_date NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""")
put("freshness", """
    SELECT exchange, strftime(d, '%Y-%m-%d') AS last_date, CAST(d >= x AS INTEGER) AS is_fresh,
           CAST(min(d) OVER () >= x AS INTEGER) AS all_fresh
    FROM (SELECT exchange, max(trade_date) AS d FROM fq GROUP BY exchange),
         (SELECT CAST(max(l_shipdate) AS DATE) AS x FROM lineitem)""")
put("append_day", f"SELECT {KEYS}, CASE WHEN idx.trade_date >= DATE '2000-01-01' THEN close + 1 ELSE close END AS close FROM idx")
put("read_quotes", f"""
    SELECT {KEYS}, product_id, {', '.join(rnd(c) for c in ('pre_settle', 'open', 'high', 'low', 'close', 'settle'))},
           open_interest, oi_change, volume FROM fq""")

# --- documents ------------------------------------------------------------------------------------
VIEWS["dq"] = """
    SELECT *, l_extendedprice - l_tax AS d_pre, l_extendedprice + 1 AS d_high, l_extendedprice - 1 AS d_low, l_extendedprice + l_discount AS d_settle,
           CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 100 END AS d_oi, CAST(l_quantity AS BIGINT) - 25 AS d_oc,
           CAST(l_quantity AS BIGINT) * 70 AS d_vol, strftime(add_month, '%y%m') AS ym,
           CAST(CAST(round_even(p_retailprice * (0.80::DOUBLE + 0.05::DOUBLE * l_linenumber), 0) AS BIGINT) AS VARCHAR) AS k,
           CASE WHEN l_linestatus = 'O' THEN 'C' ELSE 'P' END AS ot
    FROM lines"""


# one document a day: a total row for each product of a document
_DAILY = f"(SELECT DISTINCT trade_date, exchange, group_id, code, l_partkey // {docs.SHEET_PARTS} AS sheet FROM dq) dq"


def doc_quotes(group: str, contract: str, pre: str, total: tuple, totals: str = "dq") -> str:
    oi, oc, vol = total
    blank = ", ".join(f"0.0::DOUBLE AS {c}" for c in ("pre_settle", "open", "high", "low", "close", "settle"))
    return f"""
    SELECT {day('dq.trade_date', 'trade_date')}, exchange, {group} AS group_id, {contract} AS product_id, {rnd(pre, 6, 'pre_settle')},
           0.0::DOUBLE AS open, {rnd('d_high', 6, 'high')}, {rnd('d_low', 6, 'low')}, {rnd('l_extendedprice', 6, 'close')},
           {rnd('d_settle', 6, 'settle')}, d_oi AS open_interest, d_oc AS oi_change, d_vol AS volume FROM dq WHERE d_oi > 0
    UNION ALL
    SELECT {day('dq.trade_date', 'trade_date')}, exchange, {group} AS group_id, 'total' AS product_id, {blank},
           {oi} AS open_interest, {oc} AS oi_change, {vol} AS volume FROM {totals}"""


_DASHED_PRE = "CASE WHEN l_tax = 0 THEN 0.0 ELSE d_pre END"
_CN = _case("group_id", docs.DCE_NAMES)
_CC = _case("group_id", _CODES)
_shfe = doc_quotes("code || '_f'", "code || ym", _DASHED_PRE, ("1", "d_oc", "d_vol"))
_i = _shfe.index("UNION ALL")
put("ingest_shfe_futures", _shfe[:_i] + _shfe[_i:].replace("0.0::DOUBLE AS pre_settle", rnd(_DASHED_PRE, 6, "pre_settle")).replace(
    "0.0::DOUBLE AS high", rnd("d_high", 6, "high")).replace("0.0::DOUBLE AS low", rnd("d_low", 6, "low")).replace(
    "0.0::DOUBLE AS settle", rnd("d_settle", 6, "settle")))
put("ingest_dce_futures", doc_quotes(_CN, f"{_CC} || ym", _DASHED_PRE, ("5", "-1", "7")))
put("ingest_czce_futures", doc_quotes("code", "code || ym[2:]", "d_pre", ("5", "-1", "7")))
put("ingest_dce_futures_daily", doc_quotes(_CN, f"{_CC} || ym", _DASHED_PRE, ("5", "-1", "7"), _DAILY))
put("ingest_czce_futures_daily", doc_quotes("code", "code || ym[2:]", "d_pre", ("5", "-1", "7"), _DAILY))


def doc_options(group: str, dash: str, ym: str, total_vol: str, total_oi: str, total_close: str, where: str = "TRUE", totals: str = "dq") -> str:
    return f"""
    SELECT {day('dq.trade_date', 'trade_date')}, exchange, {group} AS group_id, code || {ym} || '{dash}' || ot || '{dash}' || k AS product_id, ot AS otype,
           CAST(k AS DOUBLE) AS strike, {rnd('u.u_price', 6, 'u_price')}, {rnd('l_extendedprice', 6, 'close')}, d_vol AS volume, d_oi AS open_interest
    FROM dq LEFT JOIN under u ON u.trade_date = dq.trade_date AND u.u_id = code || {ym} WHERE {where}
    UNION ALL
    SELECT {day('dq.trade_date', 'trade_date')}, exchange, {group} AS group_id, 'total' AS product_id, '' AS otype, -1.0::DOUBLE AS strike,
           NULL::DOUBLE AS u_price, {total_close} AS close, {total_vol} AS volume, {total_oi} AS open_interest FROM {totals}"""


put("ingest_shfe_options", doc_options("code", "", "ym", "0", "d_oi", rnd("l_extendedprice", 6, "close").rsplit(" AS ", 1)[0], "l_linenumber <> 7"))
put("ingest_dce_options", doc_options(_CN, "-", "ym", "0", "5", "0.0::DOUBLE"))
put("ingest_czce_options", doc_options("code", "", "ym[2:]", "0", "5", "0.0::DOUBLE"))
put("ingest_dce_options_daily", doc_options(_CN, "-", "ym", "0", "5", "0.0::DOUBLE", totals=_DAILY))
put("ingest_czce_options_daily", doc_options("code", "", "ym[2:]", "0", "5", "0.0::DOUBLE", totals=_DAILY))
VIEWS["cffe_idx"] = f"""
    SELECT trade_date, exchange, group_id, {half_even('sum(l_extendedprice * (d_oi + 100)) / sum(d_oi + 100)', 3)} AS close FROM dq GROUP BY ALL"""
put("ingest_cffe_futures", f"""
    SELECT {day('dq.trade_date', 'trade_date')}, exchange, group_id, code || ym AS product_id, {rnd('l_extendedprice', 6, 'close')},
           d_oi + 100 AS open_interest, d_oc AS oi_change, d_settle AS settle FROM dq
    UNION ALL
    SELECT {day('c.trade_date', 'trade_date')}, exchange, group_id, 'total', close, oi, oc, settle FROM cffe_idx c JOIN (
        SELECT trade_date, exchange, group_id, d_oi + 100 AS oi, d_oc AS oc, d_settle AS settle FROM dq
        QUALIFY row_number() OVER (PARTITION BY trade_date, exchange, group_id ORDER BY code || ym, l_extendedprice, d_oi, d_oc, d_settle) = 1
    ) f USING (trade_date, exchange, group_id)""")
put("ingest_cffe_options", f"""
    SELECT {day('dq.trade_date', 'trade_date')}, exchange, 'IO' AS group_id, 'IO' || ym || '-' || ot || '-' || k AS product_id, ot AS otype,
           CAST(k AS DOUBLE) AS strike, {rnd('e.close', 6, 'u_price')}, {rnd('l_extendedprice', 6, 'close')}, d_vol AS volume, d_oi + 100 AS open_interest
    FROM dq LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS trade_date, {half_even('sum(o_totalprice) / count(*)', 3)} AS close
                       FROM orders GROUP BY 1) e ON e.trade_date = dq.trade_date
    UNION ALL
    SELECT {day('dq.trade_date', 'trade_date')}, exchange, 'IO', 'total', '', -1.0::DOUBLE, NULL::DOUBLE, {rnd('l_extendedprice', 6, 'close')},
           d_vol, d_oi + 100 FROM dq
    QUALIFY row_number() OVER (PARTITION BY dq.trade_date, exchange ORDER BY ym || '-' || ot || '-' || k, l_extendedprice, d_oi, d_oc, d_settle) = 1""")
# option documents with fair prices: the underlying is the highest part price among the lines of its contract and day
_PRICED = _DATED[:_DATED.rindex("dated AS (")] + "dated AS (" + VIEWS["dated"].replace("FROM oq o", "FROM docs o") + ")"
_PRICED = _PRICED.replace("oq AS (", f"""docs AS (
    SELECT o.*, {{group}} AS doc_group, {{stamp}} AS doc_stamp, CAST(l_quantity AS BIGINT) * 70 AS d_vol,
           greatest(0.0::DOUBLE, cp * (p_retailprice - strike)) + p_retailprice * (0.01::DOUBLE + l_discount) AS close,
           max(p_retailprice) OVER (PARTITION BY {{contract}}) AS u_price FROM (SELECT * REPLACE ({{code}} AS code) FROM oq0) o WHERE {{where}}),
oq AS (""", 1)


def document_siv(group: str, stamp: str, where: str = "TRUE", code: str = "code", contract: str = None) -> str:
    contract = contract or f"trade_date, exchange, code, {stamp}"
    priced = _PRICED.format(group=group, stamp=stamp, where=where, code=code, contract=contract)
    return american_iv(priced, _SOLVE, f"""
    SELECT strftime(td, '%Y-%m-%d') AS trade_date, exchange, group_id,
           {half_even("sum(CASE WHEN iv > 0.01 THEN iv * w END) / nullif(sum(CASE WHEN iv > 0.01 THEN w END), 0)", 3)} AS iv
    FROM (SELECT n.trade_date AS td, exchange, doc_group AS group_id, f.iv,
                 CASE WHEN abs(k - s) / s > 0.25 THEN 0.0 ELSE power((abs(k - s) / s - 0.25) / 0.25, 2) END * close * d_vol * least(left_days, 10) AS w
          FROM numbered n LEFT JOIN (SELECT id, iv FROM steps WHERE iv IS NOT NULL) f USING (id))
    GROUP BY td, exchange, group_id""")


_YM = "strftime(add_month, '%y%m')"
ORACLE["shfe_options_siv"] = document_siv("code", _YM, "l_linenumber <> 7")
ORACLE["dce_options_siv"] = document_siv(_CN, _YM)
ORACLE["czce_options_siv"] = document_siv("code", f"{_YM}[2:]")
ORACLE["cffe_options_siv"] = document_siv("'IO'", _YM, code="'IO'", contract="trade_date")
put("ingest_csi_series", """
    SELECT strftime(o_orderdate, '%Y-%m-%d') AS trade_date, 'CSI' AS exchange, 'csidx300' AS group_id, o_totalprice AS close FROM orders""")
put("ingest_csi_daily", """
    SELECT strftime(o_orderdate, '%Y-%m-%d') AS trade_date, 'CSI' AS exchange, 'csidx300' AS group_id, o_totalprice AS close
    FROM orders WHERE o_orderstatus NOT IN ('P', 'O')""")
put("ingest_calendar", """
    SELECT strftime(o_orderdate, '%Y-%m-%d') AS cal_date,
           CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderpriority = '2-HIGH' THEN '休市' ELSE ' & ' END AS title,
           CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS closed FROM orders""")
put("html_page_rows", """
    SELECT CAST(pos AS BIGINT) AS pos, p AS page, CASE pos WHEN 2 THEN url WHEN 3 THEN n ELSE '-' END AS url,
           CASE pos WHEN 2 THEN n || ' < ∞' WHEN 3 THEN n END AS size, CASE WHEN pos > 2 THEN p END AS carried
    FROM (SELECT CAST(page_id AS VARCHAR) AS p, url, CAST(length(html) AS VARCHAR) AS n FROM pages), (VALUES (2), (3), (4)) t(pos)""")
VIEWS["landed"] = """
    SELECT trade_date, exchange, code || '_f' AS group_id, code || ym AS product_id, l_extendedprice AS c, d_oi AS o, d_vol AS v, 0 AS b FROM dq WHERE d_oi > 0
    UNION ALL SELECT trade_date, exchange, code || '_f', 'total', 0.0, 1, d_vol, 0 FROM dq
    UNION ALL SELECT trade_date, exchange, code || '_f', code || ym, l_extendedprice + 1, d_oi, d_vol, 1 FROM dq WHERE d_oi > 0 AND trade_date >= DATE '2001-06-01'
    UNION ALL SELECT trade_date, exchange, code || '_f', 'total', 0.0, 1, d_vol, 1 FROM dq WHERE trade_date >= DATE '2001-06-01'"""
put("stream_sync", f"""
    SELECT {day('l.trade_date', 'trade_date')}, exchange, group_id, product_id, {rnd('c', 6, 'close')}, o AS open_interest, v AS volume
    FROM landed l QUALIFY row_number() OVER (PARTITION BY l.trade_date, exchange, group_id, product_id ORDER BY b DESC, v DESC, o DESC, c DESC) = 1""")
