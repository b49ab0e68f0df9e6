"""Small helpers shared by the operators."""

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voltide.session import shared_folder

# more tasks than any job has
MOST_TASKS = 1 << 30


def fixed_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A constant dimension table built inside the plan.

    It comes from one literal over a one-row range, so its size is known when
    the query is planned and Spark broadcasts it without a hint.
    """
    names = [field.split()[0] for field in schema.split(",")]
    records = [dict(zip(names, row)) for row in rows]
    parsed = F.from_json(F.lit(json.dumps(records, ensure_ascii=False)), f"array<struct<{_ddl(schema)}>>")
    return spark.range(1).select(F.inline(parsed))


def _ddl(schema: str) -> str:
    return ",".join(f"{name}:{kind}" for name, kind in (f.split() for f in schema.split(",")))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Rows that several branches of a job read: written once below the shared folder and read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """The rows in the tasks they are in; what follows is planned and compiled apart from what makes them."""
    return df.coalesce(MOST_TASKS)


def pick_by(df: DataFrame, keys: list, order: list, last: bool) -> DataFrame:
    """One whole row per key: the last (or first) in ``order``.

    A ranking with a limit of one: Spark applies the limit in every task before
    the shuffle too, so a key that holds a large share of all rows sends one row
    a task. Rows are sorted as they are, without being copied into aggregation
    buffers.
    """
    ordered = [F.col(c) if isinstance(c, str) else c for c in order]
    ordered = [c.desc_nulls_last() if last else c.asc_nulls_first() for c in ordered]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*ordered))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= 1).drop("_rank")
