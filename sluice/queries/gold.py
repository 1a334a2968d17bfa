"""Facts, daily features and reports; silver builds and set-based backfills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.calendar import calendar_of
from sluice.jobs.layers import Dimension, backfill, backfill_range, build_tables, gold_refresh, same_on_disk, silver
from sluice.operators.contracts import Contract, conform
from sluice.operators.keys import latest_per_key, row_id
from sluice.operators.observe import latest_runs, read_runs
from sluice.operators.rollups import date_dimension, dimension, is_weekend, ratio, resum, rollup_fact, top_k, totals, window_of
from sluice.operators.rules import Rule, validate
from sluice.operators.tables import publish, scratch_path
from sluice.queries.book import Book, read

BOOK = Book()

LINES = Contract(
    "lines",
    {"l_orderkey": "bigint", "l_linenumber": "bigint", "l_suppkey": "bigint", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_shipdate": "timestamp_ntz"},
    frozenset({"l_orderkey", "l_linenumber", "l_shipdate"}),
)
RULES = [
    Rule("order_known", "not_null", "l_orderkey", "order required"),
    Rule("quantity_range", "range", "l_quantity", "quantity outside 1..49", {"min": 1, "max": 49}),
    Rule("discount_low", "expression", None, "discount of 10 % and more", {"expr": "l_discount < 0.1"}),
]
#: Valid lines, one for each order and line number: the last shipped, ties to the greater.
LINES_SQL = """lines AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate::DATE AS ship_date FROM lineitem
      WHERE l_quantity BETWEEN 1 AND 49 AND l_discount < 0.1
      QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC) = 1)"""
FACT_SQL = f"""{LINES_SQL}, fact AS (SELECT ship_date, l_suppkey, l_returnflag, count(*)::BIGINT AS lines, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(38,2) AS price,
      sum(l_tax::DECIMAL(18,2))::DECIMAL(38,2) AS tax, sum(l_quantity)::BIGINT AS quantity FROM lines GROUP BY 1, 2, 3)"""
DAILY_SQL = f"""{FACT_SQL}, days AS (SELECT o_orderdate::DATE AS ship_date, count(*)::BIGINT AS orders, max(o_totalprice) AS top_order FROM orders GROUP BY 1),
    daily AS (SELECT ship_date, sum(lines)::BIGINT AS lines, sum(price)::DECIMAL(38,2) AS price, sum(tax)::DECIMAL(38,2) AS tax, sum(quantity)::BIGINT AS quantity,
      round(sum(quantity)::DOUBLE / sum(lines)::DOUBLE, 2) AS lines_mean, round(sum(tax)::DOUBLE / sum(price)::DOUBLE * 100000, 2) AS tax_share,
      dayofweek(ship_date) IN (0, 6) AS is_weekend FROM fact GROUP BY 1),
    summary AS (SELECT daily.*, orders, top_order FROM daily LEFT JOIN days USING (ship_date))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = conform(read(spark, sf_dir, "lineitem").select(*LINES.columns), LINES)
    valid = validate(rows, RULES).valid
    last = latest_per_key(valid, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"])
    return last.withColumn("ship_date", F.to_date("l_shipdate")).drop("l_shipdate")


def fact_of(rows: DataFrame) -> DataFrame:
    return rollup_fact(rows, ["ship_date", "l_suppkey", "l_returnflag"], {"price": "l_extendedprice", "tax": "l_tax"}, {"quantity": "l_quantity"}, rows="lines")


def daily_of(fact: DataFrame) -> DataFrame:
    daily = resum(fact, ["ship_date"], ["lines", "price", "tax", "quantity"])
    return daily.withColumns({"lines_mean": ratio("quantity", "lines"), "tax_share": ratio("tax", "price", 100_000), "is_weekend": is_weekend("ship_date")})


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return orders.groupBy(F.to_date("o_orderdate").alias("ship_date")).agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("top_order"))


@BOOK.query(f"WITH {FACT_SQL} SELECT * FROM fact WHERE ship_date >= DATE '1998-01-25' AND ship_date < DATE '1998-03-01'")
def fact_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_of(window_of(lines(spark, sf_dir), "ship_date", "1998-01-25", "1998-03-01"))


@BOOK.query(f"WITH {DAILY_SQL} SELECT * FROM summary")
def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_of(fact_of(lines(spark, sf_dir))).join(order_days(spark, sf_dir), "ship_date", "left")


@BOOK.query(
    f"""WITH {FACT_SQL},
    before AS (SELECT ship_date, sum(lines)::BIGINT AS lines, sum(price)::DECIMAL(38,2) AS price FROM fact WHERE lines < 2 GROUP BY 1),
    fresh AS (SELECT ship_date, sum(lines)::BIGINT AS lines, sum(price)::DECIMAL(38,2) AS price FROM fact WHERE ship_date >= DATE '1998-01-25' AND ship_date < DATE '1998-03-01' GROUP BY 1)
    SELECT * FROM before WHERE NOT (ship_date >= DATE '1998-01-25' AND ship_date < DATE '1998-03-01') UNION ALL SELECT * FROM fresh"""
)
def gold_window_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    summarise = lambda r: resum(fact_of(r), ["ship_date"], ["lines", "price"])
    before = resum(fact_of(rows).where("lines < 2"), ["ship_date"], ["lines", "price"])
    return gold_refresh(before, rows, "ship_date", "1998-01-25", "1998-03-01", summarise)


@BOOK.query(
    """SELECT strftime(d, '%Y%m%d')::INT AS date_key, d::DATE AS date, year(d)::INT AS year, month(d)::INT AS month, day(d)::INT AS day, (dayofweek(d) + 1)::INT AS day_of_week, dayofweek(d) IN (0, 6) AS is_weekend
    FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders)"""
)
def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return date_dimension(read(spark, sf_dir, "orders"), "o_orderdate")


@BOOK.query("SELECT s_suppkey AS supplier_key, s_name AS supplier, n_name AS nation, r_name AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dim_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    columns = {"supplier_key": "s_suppkey", "supplier": "s_name", "nation": "n_name", "region": "r_name"}
    return dimension(read(spark, sf_dir, "supplier"), columns, (nation, "s_nationkey", "n_nationkey"), (region, "n_regionkey", "r_regionkey"))


@BOOK.query(f"WITH {DAILY_SQL} SELECT is_weekend, count(*)::BIGINT AS days, sum(price)::DECIMAL(38,2) AS price, round(sum(tax)::DOUBLE / sum(price)::DOUBLE * 100000, 2) AS tax_share FROM summary GROUP BY 1")
def weekend_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(daily_summary(spark, sf_dir), ["price"], ["is_weekend"], rows="days", shares={"tax_share": ("tax", "price", 100_000)})


@BOOK.query(f"WITH {DAILY_SQL} SELECT sum(lines)::BIGINT AS lines, sum(price)::DECIMAL(38,2) AS price, count(*)::BIGINT AS days FROM summary")
def kpi_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(daily_of(fact_of(lines(spark, sf_dir))), ["lines", "price"], rows="days")


@BOOK.query(f"WITH {DAILY_SQL} SELECT ship_date, orders, price FROM summary ORDER BY ship_date")
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_summary(spark, sf_dir).select("ship_date", "orders", "price").orderBy("ship_date")


@BOOK.query(
    f"""WITH {FACT_SQL} SELECT l_suppkey, lines, s_name AS label FROM (SELECT l_suppkey, sum(lines)::BIGINT AS lines FROM fact GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15) LEFT JOIN supplier ON l_suppkey = s_suppkey""",
    name="top_zones",
)
def top_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("label"))
    return top_k(fact_of(lines(spark, sf_dir)), "l_suppkey", "lines", 15, labels, "s_suppkey")


#: Lines as the batches of the months they ship in; a line is of the batch of its order's month.
BATCH_RULES = [
    Rule("quantity_range", "range", "l_quantity", "quantity outside 1..49", {"min": 1, "max": 49}),
    Rule("in_window", "expression", None, "outside the batch and its late window", {"expr": "l_shipdate >= '{late_start}' AND l_shipdate < '{batch_end}'"}),
]


def _project() -> dict:
    same = {c: F.col(c) for c in ("l_orderkey", "l_linenumber", "_batch_id", "l_suppkey", "l_extendedprice")}
    return {"line_id": row_id("l_orderkey", "l_linenumber"), "ship_date": F.to_date("l_shipdate"), **same}


def _by_month() -> dict:
    """The same, with the month of the day, which silver on disk is partitioned by."""
    return _project() | {"ship_month": F.date_format("l_shipdate", "yyyy-MM")}


MONTH_KEYS = ["line_id", "ship_date", "ship_month"]
KEYS, LATEST = ["line_id", "ship_date"], ["_batch_id", "l_extendedprice", "l_suppkey"]
BATCHED_SQL = """batched AS (SELECT l.*, date_trunc('month', o_orderdate) AS b, strftime(o_orderdate, '%Y-%m') AS _batch_id FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)"""
SILVER_SQL = """SELECT sha256(l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR) AS line_id, l_orderkey, l_linenumber, l_shipdate::DATE AS ship_date, _batch_id, l_suppkey, l_extendedprice FROM {rows}
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_shipdate::DATE ORDER BY _batch_id DESC, l_extendedprice DESC, l_suppkey DESC) = 1"""
WINDOW_SQL = "l_quantity BETWEEN 1 AND 49 AND l_shipdate >= b - INTERVAL 7 DAY AND l_shipdate < b + INTERVAL 1 MONTH"


def _batched(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM").alias("_batch_id"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", *more).join(orders, "l_orderkey")
    return rows.withColumns({"_source": F.lit("lines"), "_ingested_at": F.lit("2024-01-01")})


def _landed(rows: DataFrame, root: str) -> DataFrame:
    """The rows as a bronze table under root: runs that read it, each a range of batches, don't join again."""
    path = f"{root}/bronze"
    publish(rows, path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@BOOK.query(f"WITH {BATCHED_SQL}, good AS (SELECT * FROM batched WHERE {WINDOW_SQL}) {SILVER_SQL.format(rows='good')}")
def silver_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    calendar = calendar_of(read(spark, sf_dir, "orders"), "o_orderdate")
    rows = _batched(spark, sf_dir)
    early = silver(rows.where("_batch_id < '1998-06'"), BATCH_RULES, _project(), KEYS, LATEST, calendar=calendar).table
    return silver(rows.where("_batch_id >= '1998-06'"), BATCH_RULES, _project(), KEYS, LATEST, calendar=calendar, target=early, update_when="s._batch_id >= t._batch_id").table


@BOOK.query(
    f"""WITH {BATCHED_SQL}, good AS (SELECT * FROM batched WHERE {WINDOW_SQL}), silver AS ({SILVER_SQL.format(rows='good')}),
    gold AS (SELECT DISTINCT ship_date FROM silver WHERE ship_date >= DATE '1996-01-01' AND ship_date < DATE '1999-01-01')
    SELECT 'silver' AS "table", count(*) AS rows_before, count(*) AS rows_after, true AS equal FROM silver UNION ALL SELECT 'gold', count(*), count(*), true FROM gold
    UNION ALL SELECT 'silver_quarantine', count(*), count(*), true FROM batched WHERE NOT ({WINDOW_SQL})"""
)
def rerun_silver_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver, its quarantine and gold are built on disk, twice, and read back."""
    root = scratch_path(spark, "rerun")
    rows = _landed(_batched(spark, sf_dir), root)
    calendar = calendar_of(read(spark, sf_dir, "orders"), "o_orderdate")
    summarise = lambda r: rollup_fact(r, ["ship_date"], {"price": "l_extendedprice"}, {}, rows="lines")

    def build() -> None:
        # two ranges of batches, one after the other
        for part in ("_batch_id < '1998-06'", "_batch_id >= '1998-06'"):
            build_tables(root, rows.where(part), BATCH_RULES, calendar, _by_month(), MONTH_KEYS, LATEST, "ship_month", "s._batch_id >= t._batch_id", ("1996-01-01", "1999-01-01"), summarise, day="ship_date")

    return same_on_disk(build, {t: f"{root}/{t}" for t in ("silver", "gold", "silver_quarantine")}, spark)


@BOOK.query(
    f"""WITH {BATCHED_SQL}, known AS (SELECT l_suppkey, min(strftime(o_orderdate, '%Y-%m')) AS first FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey % 3 <> 1 AND l_discount > 0.05 GROUP BY 1),
    good AS (SELECT batched.* FROM batched LEFT JOIN known USING (l_suppkey) WHERE {WINDOW_SQL} AND coalesce(known.first <= _batch_id, false)) {SILVER_SQL.format(rows='good')}"""
)
def backfill_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM").alias("_batch_id"))
    suppliers = read(spark, sf_dir, "lineitem").where("l_suppkey % 3 <> 1 AND l_discount > 0.05").join(orders, "l_orderkey").select(F.col("l_suppkey").alias("s_suppkey"), "_batch_id")
    calendar = calendar_of(read(spark, sf_dir, "orders"), "o_orderdate")
    return backfill(_batched(spark, sf_dir), BATCH_RULES, calendar, _project(), KEYS, LATEST, refs={"l_suppkey": ("supplier", suppliers, "s_suppkey")}).table


@BOOK.query(
    f"""WITH {BATCHED_SQL}, good AS (SELECT * FROM batched WHERE {WINDOW_SQL} AND b >= DATE '1996-01-01' AND b < DATE '1999-01-01'), silver AS ({SILVER_SQL.format(rows='good')})
    SELECT ship_date, count(*)::BIGINT AS lines, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(38,2) AS price FROM silver
    WHERE ship_date >= DATE '1995-12-25' AND ship_date < DATE '1997-01-01' OR ship_date >= DATE '1997-05-25' AND ship_date < DATE '1999-01-01' GROUP BY 1""",
    name="backfill_range",
)
def backfill_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of months through chosen stages: silver alone, then both over months that overlap, then gold alone of a year whose silver is there."""
    root = scratch_path(spark, "backfill")
    rows = _landed(_batched(spark, sf_dir), root)
    summarise = lambda r: rollup_fact(r, ["ship_date"], {"price": "l_extendedprice"}, {}, rows="lines")
    for first, last, stages in (("1996-01", "1997-12", ["silver"]), ("1997-06", "1998-12", ["silver", "gold"]), ("1996-01", "1996-12", ["gold"])):
        backfill_range(root, rows, first, last, BATCH_RULES, _by_month(), MONTH_KEYS, LATEST, "ship_month", "s._batch_id >= t._batch_id", summarise, stages, day="ship_date")
    return spark.read.parquet(f"{root}/gold")


@BOOK.query(
    f"""WITH {BATCHED_SQL}, flagged AS (SELECT *, array_to_string(list_filter([
      CASE WHEN l_quantity NOT BETWEEN 1 AND 49 THEN 'quantity_range: quantity outside 1..49' END,
      CASE WHEN NOT (l_shipdate >= b - INTERVAL 7 DAY AND l_shipdate < b + INTERVAL 1 MONTH) THEN 'in_window: outside the batch and its late window' END], lambda x: x IS NOT NULL), '; ') AS why FROM batched),
    good AS (SELECT * FROM flagged WHERE why = ''), silver AS ({SILVER_SQL.format(rows='good')})
    SELECT 'silver' AS kind, _batch_id, NULL AS why, count(*)::BIGINT AS n, sum(l_orderkey)::BIGINT AS keys, NULL::BIGINT AS valid, NULL::BIGINT AS quarantined FROM silver GROUP BY 2
    UNION ALL SELECT 'quarantine', _batch_id, why, count(*), sum(l_orderkey)::BIGINT, NULL, NULL FROM flagged WHERE why <> '' GROUP BY 2, 3
    UNION ALL SELECT 'run', _batch_id, NULL, count(*), NULL, count(*) FILTER (why = ''), count(*) FILTER (why <> '') FROM flagged GROUP BY 2"""
)
def silver_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver, its quarantine and the run records, built on disk in two ranges of batches, the second of them twice, and read back."""
    root = scratch_path(spark, "silver")
    rows = _landed(_batched(spark, sf_dir), root)
    calendar = calendar_of(read(spark, sf_dir, "orders"), "o_orderdate")
    for part in ("_batch_id < '1998-06'", "_batch_id >= '1998-06'", "_batch_id >= '1998-06'"):
        build_tables(root, rows.where(part), BATCH_RULES, calendar, _by_month(), MONTH_KEYS, LATEST, "ship_month", "s._batch_id >= t._batch_id", ("1996-01-01", "1999-01-01"), None, ["silver"])
    none = F.lit(None).cast("long")
    table = spark.read.parquet(f"{root}/silver").groupBy("_batch_id").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))
    key = F.get_json_object("_record", "$.l_orderkey").cast("long")
    bad = spark.read.parquet(f"{root}/silver_quarantine").groupBy("_batch_id", F.col("_reasons").alias("why")).agg(F.count("*").alias("n"), F.sum(key).alias("keys"))
    runs = latest_runs(read_runs(spark, f"{root}/runs")).where("status = 'success' AND rows_in = rows_valid + rows_quarantined")
    out = table.select(F.lit("silver").alias("kind"), "_batch_id", F.lit(None).cast("string").alias("why"), "n", "keys", none.alias("valid"), none.alias("quarantined"))
    out = out.unionByName(bad.select(F.lit("quarantine").alias("kind"), "_batch_id", "why", "n", "keys", none.alias("valid"), none.alias("quarantined")))
    return out.unionByName(runs.select(F.lit("run").alias("kind"), F.col("batch_id").alias("_batch_id"), F.lit(None).cast("string").alias("why"), F.col("rows_in").alias("n"), none.alias("keys"), F.col("rows_valid").alias("valid"), F.col("rows_quarantined").alias("quarantined")))


@BOOK.query(
    f"""WITH {BATCHED_SQL}, arrived AS (SELECT l_suppkey, strftime(o_orderdate, '%Y-%m') AS _batch_id, l_suppkey % 3 <> 1 AS fit FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount > 0.05 AND year(o_orderdate) BETWEEN 1996 AND 1998),
    known AS (SELECT l_suppkey, min(_batch_id) AS first, max(_batch_id) AS last FROM arrived WHERE fit GROUP BY 1),
    good AS (SELECT batched.* FROM batched LEFT JOIN known USING (l_suppkey) WHERE year(b) BETWEEN 1996 AND 1998 AND {WINDOW_SQL} AND coalesce(known.first <= _batch_id, false)), silver AS ({SILVER_SQL.format(rows='good')})
    SELECT 'lines' AS kind, _batch_id, count(*)::BIGINT AS n, sum(l_orderkey)::BIGINT AS keys FROM silver GROUP BY 2
    UNION ALL SELECT 'suppliers', last, count(*), sum(l_suppkey)::BIGINT FROM known GROUP BY 2
    UNION ALL SELECT 'unfit suppliers', _batch_id, count(*), sum(l_suppkey)::BIGINT FROM arrived WHERE NOT fit GROUP BY 2"""
)
def backfill_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and lines of three years on disk, in ranges of months: a supplier is known from the batch that brings it first, whichever range that is in."""
    root = scratch_path(spark, "dimensions")
    rows = _landed(_batched(spark, sf_dir, "l_discount"), root)
    arrived = rows.where("l_discount > 0.05").select(F.col("l_suppkey").alias("s_suppkey"), "_batch_id", F.lit("suppliers").alias("_source"), "_ingested_at")
    rows = rows.drop("l_discount")
    fit = Rule("supplier_fit", "expression", "s_suppkey", "not one of ours", {"expr": "s_suppkey % 3 <> 1"})
    columns = {c: F.col(c) for c in ("s_suppkey", "_batch_id")}
    suppliers = Dimension("suppliers", arrived, "s_suppkey", "l_suppkey", columns, ["s_suppkey"], ["_batch_id"], [fit])
    for first, last in (("1996-01", "1997-06"), ("1997-07", "1998-12"), ("1997-01", "1997-12")):
        backfill_range(root, rows, first, last, BATCH_RULES, _by_month(), MONTH_KEYS, LATEST, "ship_month", "s._batch_id >= t._batch_id", None, ["silver"], dimensions=[suppliers])
    found = lambda kind, table, key: spark.read.parquet(f"{root}/{table}").groupBy("_batch_id").agg(F.count("*").alias("n"), F.sum(key).alias("keys")).withColumn("kind", F.lit(kind))
    unfit = found("unfit suppliers", "suppliers_quarantine", F.get_json_object("_record", "$.s_suppkey").cast("long"))
    return found("lines", "silver", "l_orderkey").unionByName(found("suppliers", "suppliers", "s_suppkey")).unionByName(unfit)
