"""Row ids, one row for each key, and order-insensitive fingerprints of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_id(*columns: str | Column, sep: str = "|", null: str = "~") -> Column:
    """SHA-256 of the columns as text, joined by `sep`, nulls as `null`: the same row has the same id in every run."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.sha2(F.concat_ws(sep, *(F.coalesce(c.cast("string"), F.lit(null)) for c in cols)), 256)


def latest_per_key(df: DataFrame, keys: Sequence[str], latest: Sequence[str]) -> DataFrame:
    """Of each key the row that is greatest in `latest`, nulls last, and then in the other columns.

    A null key is a key. As the order is total, and descending throughout, it is a
    grouped maximum of structs: rows are combined before the shuffle and a hot key
    costs no more than others. Column order is kept; repeated rows become one.
    """
    rest = [c for c in df.columns if c not in keys and c not in latest]
    best = df.groupBy(*keys).agg(F.max(F.struct(*latest, *rest)).alias("__best"))
    return best.select(*(F.col(c) if c in keys else F.col(f"__best.{c}").alias(c) for c in df.columns))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key the first row in any order; Spark limits each task's rows of a key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def fingerprint(df: DataFrame, strict: bool = True) -> DataFrame:
    """One row (rows, digest): the row count and the sum of row hashes, whatever the order of rows.

    A strict hash also tells which columns are null; the other one skips nulls.
    """
    columns = [x for c in df.columns for x in ([F.col(c), F.col(c).isNull()] if strict else [F.col(c)])]
    digest = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")) if df.columns else F.lit(None).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(digest, F.lit(0).cast("decimal(38,0)")).alias("digest"))


def text_fingerprint(df: DataFrame, sep: str = "|", null: str = "~") -> DataFrame:
    """As fingerprint, from 60 bits of the MD5 of each row as text: another engine can compute it."""
    row = F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in df.columns))
    part = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("digest"))


def fingerprints(tables: Mapping[str, DataFrame], strict: bool = True) -> DataFrame:
    """(table, rows, digest): one scan of each table."""
    parts = [fingerprint(df, strict).select(F.lit(name).alias("table"), "rows", "digest") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fingerprint_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table, rows_before, rows_after, equal): tables of either side; a table that one side lacks is not equal."""
    b = before.select("table", F.col("rows").alias("rows_before"), F.col("digest").alias("__b"))
    a = after.select("table", F.col("rows").alias("rows_after"), F.col("digest").alias("__a"))
    equal = F.col("rows_before").eqNullSafe(F.col("rows_after")) & F.col("__b").eqNullSafe(F.col("__a"))
    return b.join(a, "table", "full_outer").select("table", "rows_before", "rows_after", equal.alias("equal"))
