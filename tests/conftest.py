import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from voltide.session import configure  # noqa: E402

# --- fixed values: closures used by the expiry anchors (weekdays) --------------------
HOLIDAY_RANGES = [
    ("2018-01-01", "2018-01-01"), ("2018-02-15", "2018-02-21"), ("2018-04-05", "2018-04-06"), ("2018-04-30", "2018-05-01"),
    ("2018-06-18", "2018-06-18"), ("2018-09-24", "2018-09-24"), ("2018-10-01", "2018-10-05"), ("2018-12-31", "2018-12-31"),
    ("2019-01-01", "2019-01-01"), ("2019-02-04", "2019-02-08"), ("2019-04-05", "2019-04-05"), ("2019-05-01", "2019-05-03"),
    ("2019-06-07", "2019-06-07"), ("2019-09-13", "2019-09-13"), ("2019-10-01", "2019-10-07"),
    ("2020-01-01", "2020-01-01"), ("2020-01-24", "2020-01-30"), ("2020-04-06", "2020-04-06"), ("2020-05-01", "2020-05-05"),
    ("2020-06-25", "2020-06-26"), ("2020-10-01", "2020-10-08"),
    ("2021-01-01", "2021-01-01"), ("2021-02-11", "2021-02-17"), ("2021-04-05", "2021-04-05"), ("2021-05-03", "2021-05-05"),
    ("2021-06-14", "2021-06-14"),
]
DETAIL_CLOSED = ["2020-01-31"]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture(scope="session")
def calendar(spark):
    import pandas as pd

    from voltide.operators.calendar import calendar_from_lists

    days = [str(d.date()) for a, b in HOLIDAY_RANGES for d in pd.date_range(a, b)]
    return calendar_from_lists(spark, "2017-01-01", "2022-06-30", days, DETAIL_CLOSED).cache()
