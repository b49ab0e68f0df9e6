"""Stored quote history as CSV or Parquet files."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltide import constants as K, schemas
from voltide.operators.term import newest_deliveries


def read_quotes(spark: SparkSession, path: str, schema=schemas.FUTURES_QUOTES, fmt: str = "csv") -> DataFrame:
    """Quote history with a stated schema; no pass over the data to infer it."""
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def read_contract_files(spark: SparkSession, folder: str, schema=schemas.FUTURES_QUOTES, max_contracts: int = None) -> DataFrame:
    """Quotes of the dated contract files of a folder, or of the newest ones.

    The delivery date is the ISO date in the file's path. With
    ``max_contracts`` the newest dates are found on file names alone (at most
    that many reach the driver); as a filter on the path they prune whole
    files from the scan.
    """
    quotes = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.csv"
    ).csv(folder)
    found = F.regexp_extract(F.col("_metadata.file_path"), K.ISO_DATE, 1)
    dated = quotes.select("*", F.try_to_date(found, "yyyy-MM-dd").alias("delivery"))
    if max_contracts is None:
        return dated.where(F.col("delivery").isNotNull())
    # only the path column of binaryFile is used, so no content is read
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.csv"
    ).load(folder).select("path")
    newest = [str(r.delivery) for r in newest_deliveries(names, "path", max_contracts).collect()]
    return quotes.where(found.isin(newest)).select("*", F.try_to_date(found, "yyyy-MM-dd").alias("delivery"))
