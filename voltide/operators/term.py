"""Term structure: prices by position of the contract on the delivery ladder."""

from pyspark.sql import DataFrame, Window, functions as F

from voltide import constants as K
from voltide.functions.text import month_day

LADDER = ["exchange", "group_id"]


def settle_or_close():
    """Settlement price, or the close where there is none."""
    return F.when(F.coalesce(F.col("settle"), F.lit(0.0)) != 0, F.col("settle")).otherwise(F.col("close"))


def newest_deliveries(paths: DataFrame, path_col: str = "path", max_contracts: int = None) -> DataFrame:
    """The delivery dates among file paths that contain an ISO date, or the newest ``max_contracts`` of them."""
    found = F.nullif(F.regexp_extract(path_col, K.ISO_DATE, 1), F.lit(""))
    dates = paths.select(F.try_to_date(found, "yyyy-MM-dd").alias("delivery")).where(F.col("delivery").isNotNull())
    dates = dates.distinct()
    return dates if max_contracts is None else dates.orderBy(F.col("delivery").desc()).limit(max_contracts)


def ladder_ranks(ladder: DataFrame, days: DataFrame, keys=LADDER) -> DataFrame:
    """(keys, day, before, upto, total): how many delivery dates of its product come before each day, and up to it.

    ``ladder`` has the delivery dates, ``days`` the days to place among them; both
    are reduced to distinct ones, so the calendar bounds the running count.
    """
    marks = ladder.select(*keys, F.col("delivery").alias("day"), F.lit(1).alias("_mark"))
    marks = marks.unionByName(days.select(*keys, "day", F.lit(0).alias("_mark")))
    marks = marks.groupBy(*keys, "day").agg(F.max("_mark").alias("_mark"))
    product = Window.partitionBy(*keys)
    upto = F.sum("_mark").over(product.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return marks.select(*keys, "day", (upto - F.col("_mark")).alias("before"), upto.alias("upto"), F.sum("_mark").over(product).alias("total"))


def combine_contracts(placed: DataFrame, keys=LADDER) -> DataFrame:
    """Add the prices of all contracts per day and position, absent ones as 0."""
    return placed.groupBy(*keys, "trade_date", "pos").agg(F.sum("price").alias("price"))


def term_structure(quotes: DataFrame, deliveries: DataFrame = None, max_contracts: int = None, keys=LADDER) -> DataFrame:
    """Long-form term structure (keys, trade_date, pos, price).

    A contract's position on a day is the number of delivery dates d of its
    product with day <= d < its own delivery. All contracts contribute, or
    only the newest ``max_contracts`` of a product. ``deliveries`` names
    the dates; by default they are those of the quotes, which are then read
    once.

    The quotes are added up first, to one row per day and contract. A position
    is the difference of two ranks on the ladder, of the delivery and of the
    day, which one running count gives for all days of a product at once.
    """
    daily = (
        quotes.where(F.col("trade_date") <= F.col("delivery"))
        .withColumn("price", settle_or_close())
        .groupBy(*keys, "trade_date", "delivery").agg(F.sum("price").alias("price"))
    )
    ladder = daily if deliveries is None else deliveries
    asked = daily.select(*keys, F.col("trade_date").alias("day")).unionByName(daily.select(*keys, F.col("delivery").alias("day")))
    ranks = ladder_ranks(ladder, asked, keys).where(F.col("total") > 0)
    start = ranks.select(*keys, F.col("day").alias("trade_date"), F.col("before").alias("_start"))
    end = ranks.select(*keys, F.col("day").alias("delivery"), F.col("before").alias("_end"), (F.col("total") - F.col("upto")).alias("_newer"))
    placed = daily.join(start, [*keys, "trade_date"]).join(end, [*keys, "delivery"])
    if max_contracts is not None:
        placed = placed.where(F.col("_newer") < max_contracts)
    return combine_contracts(placed.withColumn("pos", (F.col("_end") - F.col("_start")).cast("int")), keys)


def term_matrix(term: DataFrame, positions: list, keys=LADDER) -> DataFrame:
    """Wide form with one column per position; missing prices are 0.

    A position without a column stops the job instead of getting lost.
    """
    unknown = F.raise_error(F.concat(F.lit("no column for position "), F.col("pos").cast("string"))).cast("int")
    term = term.withColumn("pos", F.when(F.col("pos").isin(positions), F.col("pos")).otherwise(unknown))
    return term.groupBy(*keys, "trade_date").pivot("pos", positions).sum("price").na.fill(0.0)


def term_pct_change(term: DataFrame, keys=LADDER) -> DataFrame:
    """Relative change from one position to the next on the same day."""
    frame = Window.partitionBy(*keys, "trade_date").orderBy("pos")
    before, before_pos = F.lag("price").over(frame), F.lag("pos").over(frame)
    change = (F.col("price") - before) / F.nullif(before, F.lit(0.0))
    return term.withColumn("pct", F.when(before_pos == F.col("pos") - 1, change))


def format_dates(df: DataFrame, deliveries: DataFrame = None, date_col: str = "trade_date") -> DataFrame:
    """Add ``label``, the month and day of each row, and ``d``, which marks the delivery days of a table with ``delivery``."""
    out = df.withColumn("label", month_day(F.col(date_col)))
    if deliveries is None:
        return out.withColumn("d", F.lit(""))
    days = deliveries.select(F.col("delivery").alias(date_col), F.lit("d").alias("d")).distinct()
    return out.drop("d").join(days, date_col, "left").withColumn("d", F.coalesce("d", F.lit("")))
