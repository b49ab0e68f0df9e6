# -*- coding: utf-8 -*-
"""Fixed values shared by the jobs.

Everything here is a value that results depend on: markers used by the
exchanges, product codes, display names, contract naming patterns, the expiry
rule table and the numeric settings of the volatility models.
"""

# --- fixed values: markers found in exchange documents -----------------------
TOTAL_KEY = "total"
SUBTOTAL_MARK = "小计"
GRAND_TOTAL_MARK = "总计"
SUM_ROW_MARK = "合计"
CLOSED_MARK = "休市"
CSI_ITEM_NAME = "沪深300"
CSI_GROUP = "csidx300"
CSI_AFTER_TIME = "15:01:00"
SOURCE_CHARSET = "GB18030"

# --- fixed values: model settings ----------------------------------------------
ANNUAL_ROWS = 250          # annualisation of daily variance and percentile window
HV_SHORT = 20
HV_LONG = 250
ANNUAL_DAYS = 365          # t = days / 365 for implied volatility
GREEK_DAYS = 240           # theta is quoted per trading day
INTEREST_RATE = 0.12
TREE_STEPS = 15
MAX_STRIKE_BIAS = 0.25
MIN_SIV_IV = 0.01
RDAYS_CAP = 10
YEAR_FILL_DAYS = 732
SOLVER_STEPS = 50
SOLVER_TOL = 1e-5
CHORD_START = 0.01
NEWTON_START = 0.3
VEGA_BUMP = 0.001
ALERT_HIGH = 90
ALERT_LOW = 15
ALERT_NEAR_MAX = 0.9
ALERT_NEAR_MIN = 1.1
PERCENTILE_DEFAULT = 50

# --- fixed values: contract naming patterns -----------------------------------
OPTION_NAME = r"(\w+\d+)(C|P)(\d+)"
OPTION_NAME_DASHED = r"(\w+\d+)-(C|P)-(\d+)"
CONTRACT_NAME = r"^([a-z|A-Z]+)([0-9]+)([0-9]{2})(C|P|-C-|-P-)([0-9]+)$"
ISO_DATE = r"(\d{4}-\d{2}-\d{2})"

# --- fixed values: commodity name -> contract code (Dalian exchange) ------------
DCE_CODES = {
    "玉米": "c",
    "玉米淀粉": "cs",
    "豆一": "a",
    "豆二": "b",
    "豆粕": "m",
    "豆油": "y",
    "棕榈油": "p",
    "纤维板": "fb",
    "胶合板": "bb",
    "鸡蛋": "jd",
    "粳米": "rr",
    "生猪": "lh",
    "聚乙烯": "l",
    "聚氯乙烯": "v",
    "聚丙烯": "pp",
    "焦炭": "j",
    "焦煤": "jm",
    "铁矿石": "i",
    "乙二醇": "eg",
    "苯乙烯": "eb",
    "液化石油气": "pg",
}

# --- fixed values: group id -> name shown in reports -----------------------------
DISPLAY_NAMES = {
    "csidx300": "300",
    "cu_f": "沪铜",
    "al_f": "沪铝",
    "zn_f": "沪锌",
    "pb_f": "沪铅",
    "ni_f": "沪镍",
    "sn_f": "沪锡",
    "au_f": "沪金",
    "ag_f": "沪银",
    "rb_f": "螺纹",
    "hc_f": "热卷",
    "ss_f": "ss",
    "sc_f": "原油",
    "fu_f": "燃油",
    "lu_f": "LU",
    "bu_f": "沥青",
    "ru_f": "橡胶",
    "nr_f": "20胶",
    "sp_f": "纸浆",
    "豆一": "豆一",
    "玉米": "玉米",
    "苯乙烯": "EB",
    "乙二醇": "eg",
    "铁矿石": "铁",
    "焦炭": "焦炭",
    "鸡蛋": "鸡蛋",
    "焦煤": "焦煤",
    "聚乙烯": "塑料",
    "生猪": "生猪",
    "豆粕": "豆粕",
    "棕榈油": "棕榈",
    "液化石油气": "LPG",
    "聚丙烯": "pp",
    "粳米": "粳米",
    "聚氯乙烯": "pvc",
    "豆油": "豆油",
    "AP": "苹果",
    "CF": "郑棉",
    "CJ": "红枣",
    "FG": "玻璃",
    "MA": "郑醇",
    "OI": "郑油",
    "RM": "菜粕",
    "SA": "纯碱",
    "SF": "硅铁",
    "SM": "锰硅",
    "SR": "白糖",
    "TA": "TA",
    "UR": "尿素",
    "ZC": "动煤",
}

# --- fixed values: futures group whose options use another group id ---------------
OPTION_GROUPS = {"csidx300": "IO"}
# the exchange of the options this map leads to
INDEX_OPTION_EXCHANGE = "CFFE"

# --- fixed values: groups with European exercise (routing by exercise style) -------
EUROPEAN_GROUPS = ["csidx300", "au_f"]
EUROPEAN_PRODUCTS = ["IO", "au"]

# --- fixed values: expiry rules ----------------------------------------------------
# (product, anchor, month offset from the contract month, n-th session from the
# anchor, first contract month the rule holds for, first month it no longer does).
# n > 0 counts open sessions forward, n < 0 counts sessions backward; both start
# with the anchor day itself.
EXPIRY_RULES = (
    [("IO", "third_friday", 0, 1, None, None)]
    + [(p, "last_weekday", -1, -5, None, None) for p in ("cu", "al", "zn", "au", "ru")]
    + [("sc", "last_weekday", -1, -13, None, None)]
    + [(p, "first_weekday", -1, 5, None, None) for p in ("m", "c", "i", "pg", "l", "v", "pp", "p")]
    + [("SR", "last_weekday", -2, -5, None, "2019-09-01")]
    + [("SR", "first_weekday", -1, 3, "2019-09-01", None)]
    + [(p, "first_weekday", -1, 3, None, None) for p in ("CF", "RM", "MA", "TA", "ZC")]
)
