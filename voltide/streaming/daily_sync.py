"""Daily load of landed documents as a file stream.

The stream's checkpoint remembers which documents were taken, so no job needs
the last stored date. Every batch takes effect once: the table's ledger notes
its name, made of the stream's id and the batch's number, with the days it
wrote, and a replayed batch is skipped or finished from what it had staged. A
document without rows leaves the stored history alone.
"""

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from voltide import schemas
from voltide.operators.maintain import merge_day

SYNC_KEYS = ("trade_date", "exchange", "group_id", "product_id")


def stream_payloads(spark: SparkSession, landing: str, max_files: int = None) -> DataFrame:
    """Parquet files of documents as a stream."""
    reader = spark.readStream.schema(schemas.RAW_PAYLOADS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(landing)


def sync_stream(stream: DataFrame, ingest: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                keys: list, schema=schemas.FUTURES_QUOTES, order: list = None,
                date_col: str = "trade_date") -> StreamingQuery:
    """Run ``ingest`` over every batch of documents and merge the rows by day.

    A late or corrected document replaces the rows it names and keeps the
    others of its day. ``date_col`` is the partition column of the table.
    """
    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        merge_day(spark, ingest(batch), out, schema, keys, order, date_col, f"{stream_id}-{batch_id}")

    return (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_daily_sync(spark: SparkSession, landing: str, out: str, checkpoint: str,
                      ingest: Callable[[DataFrame], DataFrame],
                      keys=SYNC_KEYS,
                      schema=schemas.FUTURES_QUOTES, order: list = None, date_col: str = "trade_date",
                      max_files: int = None) -> StreamingQuery:
    """Load everything that landed since the last run, then stop."""
    stream = stream_payloads(spark, landing, max_files)
    return sync_stream(stream, ingest, out, checkpoint, list(keys), schema, order, date_col)
