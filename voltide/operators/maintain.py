"""Writing and maintaining the stored tables."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voltide.operators import ledger
from voltide.operators.tables import pick_by

# touched partitions that a plan lists one by one; more of them are joined
MOST_LISTED = 4096


def append_day(df: DataFrame, path: str, date_col: str = "trade_date", rebalance: bool = True) -> None:
    """Write days as partitions; a day that is written again is replaced.

    The rebalance hint lets adaptive execution merge small days into one file
    and split a day that is too large for one task; rows that are read from
    such files need no second shuffle. A replay of the same batch leaves the
    table as it was, and an empty batch changes nothing.
    """
    (
        (df.hint("rebalance", F.col(date_col)) if rebalance else df)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(date_col)
        .parquet(path)
    )


def merge_keep_last(old: DataFrame, new: DataFrame, keys: list, order: list = None) -> DataFrame:
    """Union of stored and new rows with the last row per key.

    New rows win over stored ones; ``order`` settles copies within one side.
    """
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    return pick_by(both, keys, ["_batch", *(order or [])], last=True).drop("_batch")


def merge_day(spark: SparkSession, new: DataFrame, path: str, schema, keys: list, order: list = None,
              date_col: str = "trade_date", batch: str = None) -> bool:
    """Merge new rows into a stored table, rewriting only the days they touch; whether anything was done.

    With ``batch``, a name that a replay repeats, the merge happens once: the
    merged days are staged beside the table and marked, then they replace the
    stored ones and are marked again. A replay of a published batch does
    nothing, however much newer the table is by then. A replay of a batch that
    was only staged publishes the staged days, which are whole even where a
    failure left the stored ones half replaced.
    """
    if batch is None:
        new = new.persist()
        try:
            append_day(merged_days(spark, new, path, schema, keys, order, date_col), path, date_col)
        finally:
            new.unpersist()
        return True
    states = ledger.states(spark, path, batch)
    if ledger.PUBLISHED in states:
        return False
    staged_path = f"{path}/_staged/{batch}"
    if ledger.STAGED not in states:
        new = new.persist()
        try:
            merged = merged_days(spark, new, path, schema, keys, order, date_col)
            merged.hint("rebalance", F.col(date_col)).write.mode("overwrite").partitionBy(date_col).parquet(staged_path)
            merged = ledger.stored(spark, staged_path, merged.schema)
            ledger.mark(merged, path, batch, ledger.STAGED, date_col)
        finally:
            new.unpersist()
    publish(spark, staged_path, path, schema, batch, date_col)
    return True


def publish(spark: SparkSession, staged_path: str, path: str, schema, batch: str, date_col: str = "trade_date") -> None:
    """Replace stored days by staged ones and mark the batch as published; the staged rows go."""
    staged = spark.read.schema(schema).parquet(staged_path)
    append_day(staged, path, date_col, rebalance=False)
    ledger.mark(staged, path, batch, ledger.PUBLISHED, date_col)
    staged.where(F.lit(False)).write.mode("overwrite").parquet(staged_path)


def merged_days(spark: SparkSession, new: DataFrame, path: str, schema, keys: list, order: list = None,
                date_col: str = "trade_date") -> DataFrame:
    """The touched days as they are after the merge. ``new`` is read twice and should be cached."""
    old = ledger.stored(spark, path, schema)
    old = new.where(F.lit(False)) if old is None else touched_days(old, new, date_col)
    return merge_keep_last(old.select(*new.columns), new, keys, order)


def touched_days(stored: DataFrame, new: DataFrame, date_col: str = "trade_date", most: int = MOST_LISTED) -> DataFrame:
    """Stored rows of the days that ``new`` touches.

    Up to ``most`` days are listed in the plan, so only their files are read,
    whatever lies between them. More days than that are a semi-join within
    their first and last day.
    """
    days = new.select(date_col).distinct()
    listed = [r[0] for r in days.limit(most + 1).collect()]
    if len(listed) <= most:
        return stored.where(among(F.col(date_col), listed))
    low, high = new.agg(F.min(date_col), F.max(date_col)).first()
    within = stored.where(F.col(date_col).between(F.lit(low), F.lit(high)) | F.col(date_col).isNull())
    return within.join(days.withColumnRenamed(date_col, "_day"), F.col(date_col).eqNullSafe(F.col("_day")), "left_semi")


def among(column: Column, values: list) -> Column:
    """Whether a column is one of some values, NULL being a value."""
    known = column.isin([v for v in values if v is not None])
    return F.coalesce(known, F.lit(None in values))


def drop_last_date(df: DataFrame, date_col: str = "trade_date") -> DataFrame:
    """All rows but those of the last date."""
    return df.where(F.col(date_col) < df.agg(F.max(date_col)).scalar())


def missing_dates(sessions: DataFrame, stored: DataFrame, holes: bool = False, date_col: str = "trade_date") -> DataFrame:
    """Sessions still to load: those after the last stored date.

    All of them where nothing is stored. With ``holes`` also earlier sessions
    without any stored row.
    """
    if holes:
        return sessions.join(stored.select(date_col), date_col, "left_anti")
    last = stored.agg(F.max(date_col)).scalar()
    return sessions.where(last.isNull() | (F.col(date_col) > last))


def freshness(df: DataFrame, expected, date_col: str = "trade_date", keys=("exchange",)) -> DataFrame:
    """Per exchange its last date, whether it reaches ``expected`` and whether all do."""
    expected = F.lit(expected).cast("date") if isinstance(expected, str) else expected
    per = df.groupBy(*keys).agg(F.max(date_col).alias("last_date"))
    marked = per.withColumn("is_fresh", F.coalesce(F.col("last_date") >= expected, F.lit(False)))
    return marked.withColumn("all_fresh", F.bool_and("is_fresh").over(Window.partitionBy(F.lit(0))))


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a report table; it has one row per product."""
    df.write.mode("overwrite").format(fmt).option("header", True).save(path)
