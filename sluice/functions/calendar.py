"""Month batches: YYYY-MM ids, their half-open bounds, and the window in which late rows are accepted."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LATE_DAYS = 7
#: What a month looks like as text, in Python and in Spark alike.
MONTH = r"^\d{4}-(0[1-9]|1[0-2])$"


class Month(int):
    """A month as the number of months since year 0, so that months are added and compared as numbers."""

    @classmethod
    def of(cls, text: str) -> Month:
        year, dash, month = text.partition("-")
        if (len(year), dash, len(month)) != (4, "-", 2) or not (year + month).isdecimal() or not 1 <= int(month) <= 12:
            raise ValueError(f"not a month: {text!r}")
        return cls(12 * int(year) + int(month) - 1)

    def __str__(self) -> str:
        return f"{self // 12:04d}-{self % 12 + 1:02d}"

    @property
    def first_day(self) -> date:
        return date.fromisoformat(f"{self}-01")


def parse_month(batch: str) -> date:
    """The first day of a YYYY-MM batch."""
    return Month.of(batch).first_day


def add_months(batch: str, n: int) -> str:
    return str(Month(Month.of(batch) + n))


def context(batch: str, late_days: int = LATE_DAYS) -> dict[str, str]:
    """batch_start, batch_end (exclusive) and late_start as ISO dates, for the placeholders of expression rules."""
    month = Month.of(batch)
    days = {"batch_start": month.first_day, "batch_end": Month(month + 1).first_day, "late_start": month.first_day - timedelta(late_days)}
    return {name: str(day) for name, day in days.items()}


def bounds(batch: Column, late_days: int = LATE_DAYS) -> list[Column]:
    """batch_start, batch_end, late_start as dates, from a YYYY-MM column; null for what is not a month."""
    start = F.to_date(F.when(batch.rlike(MONTH), F.concat(batch, F.lit("-01"))))
    return [start.alias("batch_start"), F.add_months(start, 1).alias("batch_end"), F.date_sub(start, late_days).alias("late_start")]


def _calendar(ends: DataFrame, late_days: int) -> DataFrame:
    """The calendar of the months from a to b, of one row of month starts; nulls give none."""
    months = ends.where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    ids = months.select(F.date_format("m", "yyyy-MM").alias("_batch_id"))
    return ids.select("_batch_id", *bounds(F.col("_batch_id"), late_days))


def batch_calendar(spark: SparkSession, first: str, last: str, late_days: int = LATE_DAYS) -> DataFrame:
    """(_batch_id, batch_start, batch_end, late_start) for every month from first to last."""
    a, b = Month.of(first), Month.of(last)
    if a > b:
        raise ValueError(f"{first} is after {last}")
    return _calendar(spark.range(1).select(F.lit(a.first_day).alias("a"), F.lit(b.first_day).alias("b")), late_days)


def calendar_of(df: DataFrame, moment: str, late_days: int = LATE_DAYS) -> DataFrame:
    """The calendar of the months from the least to the greatest moment in df; no rows without moments."""
    return _calendar(df.agg(*(F.trunc(f(F.to_date(moment)), "month").alias(c) for f, c in ((F.min, "a"), (F.max, "b")))), late_days)


def arrival(moment: str | Column) -> Column:
    """on_time, late (in the window before the batch) or rejected (outside both, or null), by the calendar's columns."""
    d = F.col(moment) if isinstance(moment, str) else moment
    inside = (d >= F.col("late_start")) & (d < F.col("batch_end"))
    return F.when(~F.coalesce(inside, F.lit(False)), "rejected").when(d < F.col("batch_start"), "late").otherwise("on_time")
