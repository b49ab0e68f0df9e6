"""Trading calendar operators.

A calendar table has one row per day (cal_date, is_session, closed).
``is_session`` is the published session list. ``closed`` comes from the
detailed calendar of the exchange and is NULL for days it does not list, which
count as open. The table is bounded by the number of days, not by the quotes,
and is small enough for Spark to broadcast on its own estimate.
"""

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voltide.operators.tables import fixed_table


def calendar_days(bounds: DataFrame) -> DataFrame:
    """Every day from ``first`` to ``last`` of a one-row table."""
    return bounds.select(F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("cal_date"))


def build_calendar(days: DataFrame, holidays: DataFrame = None, details: DataFrame = None) -> DataFrame:
    """Sessions are the weekdays that are no holidays; ``details`` adds the
    exchange's own (cal_date, closed) rows."""
    out = days.withColumn("is_session", F.weekday("cal_date") < 5)
    if holidays is not None:
        off = holidays.select("cal_date", F.lit(True).alias("_off")).distinct()
        out = out.join(off, "cal_date", "left").select(
            "cal_date", (F.col("is_session") & F.col("_off").isNull()).alias("is_session")
        )
    if details is None:
        return out.withColumn("closed", F.lit(None).cast("boolean"))
    listed = details.groupBy("cal_date").agg(F.bool_or("closed").alias("closed"))
    return out.join(listed, "cal_date", "left")


def calendar_from_lists(spark: SparkSession, first, last, holidays=(), closed=()) -> DataFrame:
    """Calendar from Python lists of ISO dates (the usual form of a yearly notice)."""
    bounds = spark.range(1).select(
        F.lit(str(first)).cast("date").alias("first"), F.lit(str(last)).cast("date").alias("last")
    )
    off = fixed_table(spark, [(str(d),) for d in holidays], "cal_date date") if holidays else None
    detail = fixed_table(spark, [(str(d), True) for d in closed], "cal_date date, closed boolean") if closed else None
    return build_calendar(calendar_days(bounds), off, detail)


def is_open(check_detail: bool = True) -> Column:
    session = F.col("is_session")
    if not check_detail:
        return session
    return session & ~F.coalesce(F.col("closed"), F.lit(False))


def open_days(df: DataFrame, calendar: DataFrame, date_col: str = "trade_date", check_detail: bool = True) -> DataFrame:
    """Rows that fall on an open session."""
    days = calendar.where(is_open(check_detail)).select(F.col("cal_date").alias(date_col))
    return df.join(days, date_col, "left_semi")


def report_day(ts: Column, hour: int = 8) -> Column:
    """Day a run belongs to: before ``hour`` (UTC) it is still the day before."""
    return F.to_date(ts - F.make_dt_interval(hours=F.lit(hour)))


def sessions(calendar: DataFrame, as_of, days: int = 500) -> DataFrame:
    """Open weekdays of the last ``days`` days up to ``as_of``."""
    as_of = F.lit(as_of).cast("date") if isinstance(as_of, (str, datetime.date)) else as_of
    return calendar.where(
        is_open()
        & (F.weekday("cal_date") < 5)
        & F.col("cal_date").between(F.date_sub(as_of, days), as_of)
    ).select(F.col("cal_date").alias("trade_date"))


def month_starts_of(df: DataFrame, as_of: str, days: int = 1100) -> DataFrame:
    """First days of the months within ``days`` days up to each row's date."""
    first = F.date_sub(F.col(as_of), days)
    start = F.when(F.dayofmonth(first) == 1, first).otherwise(F.add_months(F.trunc(first, "month"), 1))
    return df.select(
        "*", F.explode(F.sequence(start, F.col(as_of), F.expr("interval 1 month"))).alias("month_start")
    )


def month_starts(spark: SparkSession, as_of, days: int = 1100) -> DataFrame:
    """First days of the months whose calendar a run on ``as_of`` loads."""
    one = spark.range(1).select(F.lit(str(as_of)).cast("date").alias("_as_of"))
    return month_starts_of(one, "_as_of", days).select("month_start")


def first_weekday(month: Column) -> Column:
    return F.date_add(month, F.when(F.weekday(month) >= 5, F.lit(7) - F.weekday(month)).otherwise(F.lit(0)))


def last_weekday(month: Column) -> Column:
    end = F.last_day(month)
    return F.date_sub(end, F.greatest(F.lit(0), F.weekday(end) - 4))


def third_friday(month: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(month, 1), "FRI"), 14)


def session_index(calendar: DataFrame) -> Column:
    """The calendar as one value: its first day, the counts of every day since, and the sorted open days and sessions.

    ``days`` has for each day how many open days come before it and how many
    sessions there are up to it, ``known`` is false for days that the calendar
    leaves out. A lookup is a place in an array. The running counts go through
    the whole calendar, one row per day, once.
    """
    bounds = calendar.agg(F.min("cal_date").alias("first"), F.max("cal_date").alias("last"))
    listed = calendar.select("cal_date", is_open().alias("o"), F.col("is_session").alias("s"), F.lit(True).alias("known"))
    filled = calendar_days(bounds).select("cal_date", *[F.lit(False).alias(c) for c in ("o", "s", "known")])
    days = listed.unionByName(filled).groupBy("cal_date").agg(*[F.max(c).alias(c) for c in ("o", "s", "known")])
    run = Window.orderBy("cal_date").rowsBetween(Window.unboundedPreceding, 0)
    counted = days.select("*", F.sum(F.col("o").cast("int")).over(run).alias("n_open"), F.sum(F.col("s").cast("int")).over(run).alias("upto"))
    day = F.struct("cal_date", "known", (F.col("n_open") - F.col("o").cast("int")).alias("before"), "upto")
    return counted.agg(F.struct(
        F.min("cal_date").alias("first"),
        F.array_sort(F.collect_list(day)).alias("days"),
        F.array_sort(F.collect_list(F.when(F.col("o"), F.col("cal_date")))).alias("opened"),
        F.array_sort(F.collect_list(F.when(F.col("s"), F.col("cal_date")))).alias("sessions"),
    )).scalar()


def nth_session(df: DataFrame, anchor_col: str, shift_col: str, calendar: DataFrame, out: str = "session_date") -> DataFrame:
    """The n-th session from an anchor day, the anchor counting as the first.

    Forward (n > 0) only open days count; backward (n < 0) every published
    session counts, whatever the detailed calendar says. The calendar is one
    value that is built once, and every row looks its session up in it: no join
    and no shuffle. NULL for an anchor that is not in the calendar.
    """
    index, n = session_index(calendar), F.col(shift_col)
    day = F.get(index["days"], F.datediff(anchor_col, index["first"]))
    forward = F.get(index["opened"], (day["before"] + n - 1).cast("int"))
    backward = F.get(index["sessions"], (day["upto"] + n).cast("int"))
    return df.withColumn(out, F.when(day["known"], F.when(n > 0, forward).otherwise(backward)))
