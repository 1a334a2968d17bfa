"""Facts, daily features, date dimensions and the sums that reports ask for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.tables import scratch_path


def exact(c: str | Column, kind: str = "decimal(18,2)") -> Column:
    """An amount as a decimal, so that sums do not depend on order; null if it does not fit."""
    return (F.col(c) if isinstance(c, str) else c).try_cast(kind)


def rollup_fact(df: DataFrame, keys: Sequence[str], amounts: Mapping[str, str], counts: Mapping[str, str], rows: str = "rows") -> DataFrame:
    """A row for each key combination, null ones too: the row count, exact sums of amounts, whole sums of counts (null as 0).

    amounts and counts: new name -> column. Summed in each task before the shuffle.
    """
    return df.groupBy(*keys).agg(
        F.count("*").alias(rows),
        *(F.sum(exact(c)).cast("decimal(38,2)").alias(n) for n, c in amounts.items()),
        *(F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(n) for n, c in counts.items()),
    )


def resum(fact: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A fact by fewer keys: sums of sums, in the same types."""
    types = dict(fact.dtypes)
    return fact.groupBy(*keys).agg(*(F.sum(c).cast(types[c]).alias(c) for c in columns))


def ratio(a: str, b: str, scale: float = 1, digits: int = 2) -> Column:
    """a / b * scale, rounded; null where b is 0 or null."""
    return F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) * scale, digits)


def totals(df: DataFrame, sums: Sequence[str], by: Sequence[str] = (), rows: str = "rows", shares: Mapping[str, tuple[str, str, float]] | None = None) -> DataFrame:
    """Row count, sums and rounded shares, of all rows or for each group, null ones too; without rows one row of nulls, or no group.

    shares: new name -> (a, b, scale), the ratio of their sums. A sum of decimals keeps two digits.
    """
    shares, types = shares or {}, dict(df.dtypes)
    of = dict.fromkeys([*sums, *(c for a, b, _ in shares.values() for c in (a, b))])
    sum_of = lambda c: F.sum(c).cast("decimal(38,2)") if types[c].startswith("decimal") else F.sum(c)
    found = df.groupBy(*by).agg(F.count("*").alias(rows), *(sum_of(c).alias(f"__{c}") for c in of))
    return found.select(*by, rows, *(F.col(f"__{c}").alias(c) for c in sums), *(ratio(f"__{a}", f"__{b}", scale).alias(n) for n, (a, b, scale) in shares.items()))


#: Values of a group that one task may sort, and ranges into which a larger group's values are counted at a time.
HELD, RANGES = 10_000, 64


def median_of(df: DataFrame, keys: Sequence[str], column: str, digits: int = 2, held: int = HELD) -> DataFrame:
    """The exact median of a column for each key, rounded; nulls don't count, and none but nulls give null.

    If no group has more than `held` values, that is Spark's own median, which holds a
    group's distinct values in a task. Otherwise the values of larger groups are counted by
    ranges, whose bounds are approximate quantiles; the range that has the middle is
    counted by ranges again, until it has few values or one alone. The bounds need
    not be right, as the counts are exact.
    """
    rows = df.select(F.struct(*keys or [F.lit(0)]).alias("k"), F.col(column).alias("x"))
    large = rows.groupBy("k").agg(F.count("x").alias("inside")).where(F.col("inside") > held)
    # the two middle ranks from 0, what is below the bounds between which both lie, and how many are inside these
    state = _written(large.select("k", F.expr("(inside - 1) div 2").alias("r1"), F.expr("inside div 2").alias("r2"), F.lit(0).cast("long").alias("below"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), "inside", F.lit(False).alias("done")), "median")
    if state.isEmpty():
        return df.groupBy(*keys).agg(F.round(F.median(column), digits).alias(column))
    small = rows.join(state.select("k"), "k", "left_anti").groupBy("k").agg(F.round(F.median("x"), digits).alias(column))
    values = rows.where("x is not null").withColumn("x", F.col("x").cast("double"))
    within = F.expr("lo is null or x between lo and hi")
    while not (open_ := state.where(~F.col("done") & (F.col("inside") > held))).isEmpty():
        inside = values.join(open_, "k").where(within)
        bounds = inside.groupBy("k").agg(F.array_distinct(F.percentile_approx("x", [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).alias("bounds"))
        # a bound is a range of its own: a value that stands very often is found so
        ranged = inside.join(bounds, "k").withColumn("range", 2 * F.size(F.filter("bounds", lambda b: b < F.col("x"))) + F.array_contains("bounds", F.col("x")).cast("int"))
        counts = ranged.groupBy("k", "range").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("z"), *(F.first(c).alias(c) for c in ("r1", "r2", "below")))
        counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("k").orderBy("range")) - F.col("n") + F.col("below"))
        middle = counts.where((F.col("before") <= F.col("r2")) & (F.col("before") + F.col("n") > F.col("r1")))
        # the middle ranks in two ranges: they are the last value of the one and the first of the other
        two = F.count("*") > 1
        lo, hi = F.when(two, F.min_by("z", "before")).otherwise(F.min("a")), F.when(two, F.max_by("a", "before")).otherwise(F.max("z"))
        found = middle.groupBy("k").agg(F.first("r1").alias("r1"), F.first("r2").alias("r2"), F.min("before").alias("below"), lo.alias("lo"), hi.alias("hi"), F.sum("n").alias("inside"), (two | (F.min("a") == F.max("z"))).alias("done"))
        state = _written(state.join(open_.select("k"), "k", "left_anti").unionByName(found), "median")
    rest = values.join(state.where("not done"), "k").where(within).groupBy("k").agg(F.sort_array(F.collect_list("x")).alias("all"), *(F.first(c).alias(c) for c in ("r1", "r2", "below")))
    pick = lambda r: F.get("all", (F.col(r) - F.col("below")).cast("int"))
    ends = state.where("done").select("k", "lo", "hi").unionByName(rest.select("k", pick("r1").alias("lo"), pick("r2").alias("hi")))
    big = ends.select("k", F.round((F.col("lo") + F.col("hi")) / 2, digits).alias(column))
    return small.unionByName(big).select(*(F.col(f"k.{c}").alias(c) for c in keys), column)


def _written(state: DataFrame, name: str) -> DataFrame:
    """A row for each large group, written to the shared folder: later rounds don't compute earlier ones again."""
    path = scratch_path(state.sparkSession, name)
    state.write.parquet(path)
    return state.sparkSession.read.schema(state.schema).parquet(path)


def dimension(df: DataFrame, columns: Mapping[str, str], *lookups: tuple[DataFrame, str, str]) -> DataFrame:
    """A dimension whose key is the source's own: columns (new name -> column) of df with lookups joined to it.

    lookups: (table, column so far, its key, which stands once); what has no match has nulls.
    """
    for table, column, key in lookups:
        df = df.join(table, F.col(column) == table[key], "left")
    return df.select(*(F.col(c).alias(n) for n, c in columns.items()))


def is_weekend(day: str) -> Column:
    return F.dayofweek(day).isin(1, 7)


def window_of(df: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """Rows of start <= day < end: on a partition column the filter prunes."""
    return df.where((F.col(day) >= F.to_date(F.lit(start))) & (F.col(day) < F.to_date(F.lit(end))))


def date_dimension(df: DataFrame, day: str) -> DataFrame:
    """A row for each day from the first to the last in df; none without days."""
    ends = df.agg(F.min(F.to_date(day)).alias("a"), F.max(F.to_date(day)).alias("b"))
    days = ends.where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
    return days.select(
        F.date_format("date", "yyyyMMdd").cast("int").alias("date_key"),
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
        F.dayofweek("date").alias("day_of_week"),
        is_weekend("date").alias("is_weekend"),
    )


def top_k(df: DataFrame, key: str, measure: str, k: int, labels: DataFrame | None = None, label_key: str | None = None) -> DataFrame:
    """The k keys of the greatest sums, ties to the smaller key, with the label columns joined after the limit."""
    top = df.groupBy(key).agg(F.sum(measure).alias(measure)).orderBy(F.col(measure).desc_nulls_last(), F.col(key).asc_nulls_last()).limit(k)
    if labels is None:
        return top
    return top.join(labels, top[key] == labels[label_key or key], "left").drop(labels[label_key or key])
