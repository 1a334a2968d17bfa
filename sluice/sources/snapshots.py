"""Reference tables as of a moment, and keyed lookups."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.keys import latest_per_key


def asof_snapshot(df: DataFrame, updated: str, cutoff: str | date | datetime, order: Sequence[str] = ()) -> DataFrame:
    """Rows that were updated before the cutoff; null moments are left out. The filter reaches the scan.

    Where the source keeps current rows only, one updated later is missing, not shown as it was.
    """
    out = df.where(F.col(updated) < F.lit(cutoff))
    return out.orderBy(*order) if order else out


def asof_snapshots(df: DataFrame, updated: str, calendar: DataFrame) -> DataFrame:
    """The snapshots at the end of every month of a calendar, with _batch_id: a row stands in every batch that ends after its update.

    The batches of a row are a range, so it is exploded from them; nothing is compared with all others.
    """
    span = calendar.agg(F.min("batch_start").alias("__a"), F.max("batch_start").alias("__b"))
    month = F.trunc(F.to_date(updated), "month")
    rows = df.where(F.col(updated).isNotNull()).crossJoin(F.broadcast(span)).where((F.col("__a").isNotNull()) & (month <= F.col("__b")))
    months = F.sequence(F.greatest(month, F.col("__a")), F.col("__b"), F.expr("interval 1 month"))
    rows = rows.select(*df.columns, F.explode(months).alias("__m"))
    return rows.select(F.date_format("__m", "yyyy-MM").alias("_batch_id"), *df.columns)


def keyed_lookup(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows by key, the last in `order` wins; the column `order` goes."""
    return latest_per_key(rows, keys, [order]).drop(order)


def read_lookup(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """CSV files with a header as a keyed lookup; the last line of a key wins, and of several files that of the greatest path.

    A line's place is its file, the split in it, and a number that rises within the split.
    """
    rows = spark.read.csv(path, header=True, schema=schema)
    line = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return keyed_lookup(rows.withColumn("__line", line), keys, "__line")


def jdbc_snapshot(spark: SparkSession, url: str, table: str, updated: str, cutoff: str, **options: str) -> DataFrame:
    """asof_snapshot over JDBC: the comparison is pushed to the database."""
    return asof_snapshot(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), updated, cutoff)
