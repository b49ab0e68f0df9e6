"""Markers of what was written to a stored table, kept beside its partitions.

A marker is a set of rows appended in one write, so it is there as a whole or
not at all. The folder's name keeps it out of the table: readers of the table
skip names with an underscore in front.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "batch string, state string, part string, n_rows bigint"
STAGED, PUBLISHED = "staged", "published"


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at a path, or None before the first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(batch, state, part, n_rows): a row for each partition that a batch staged or published."""
    found = stored(spark, f"{path}/_ledger", SCHEMA)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def states(spark: SparkSession, path: str, batch: str) -> set:
    return {r.state for r in entries(spark, path).where(F.col("batch") == batch).select("state").distinct().collect()}


def mark(rows: DataFrame, path: str, batch: str, state: str, date_col: str) -> None:
    """Note that a batch reached a state, with the partitions of ``rows`` and how many rows they have."""
    spark = rows.sparkSession
    parts = rows.groupBy(F.col(date_col).cast("string").alias("part")).agg(F.count("*").alias("n_rows"))
    nothing = spark.range(1).select(F.lit(None).cast("string").alias("part"), F.lit(0).cast("bigint").alias("n_rows"))
    # a batch without rows is noted too
    noted = parts.unionByName(nothing).select(F.lit(batch).alias("batch"), F.lit(state).alias("state"), "part", "n_rows")
    noted.coalesce(1).write.mode("append").parquet(f"{path}/_ledger")
