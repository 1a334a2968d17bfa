"""Run records: events stand in for them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import observe
from sluice.operators.rollups import median_of
from sluice.operators.rules import Rule, validate
from sluice.operators.tables import scratch_path
from sluice.queries.book import Book, read

BOOK = Book()
NOW = datetime(2024, 2, 1)

RUNS_SQL = """runs AS (SELECT event_type AS stage, CASE WHEN user_id % 5 = 0 THEN 'all' ELSE 't' || (user_id % 5) END AS "table", 'b' || (user_id % 30) AS batch_id,
    CASE WHEN value > 40 THEN 'failed' ELSE 'success' END AS status, CASE WHEN user_id % 7 > 0 THEN (json_extract_string(props, '$.k'))::BIGINT END AS rows_in,
    (json_extract_string(props, '$.k'))::BIGINT // 2 AS rows_valid, CASE WHEN value < 100 THEN event_id % 3 END AS rows_quarantined, (json_extract_string(props, '$.k'))::BIGINT // 2 AS rows_out,
    value AS duration_s, ts AS finished_at, lpad(event_id::VARCHAR, 12, '0') AS run_id FROM events)"""
LAST_SQL = f"""{RUNS_SQL}, last AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY stage, "table", batch_id ORDER BY finished_at DESC, run_id DESC) = 1),
    gauges AS (SELECT 'last_success_seconds' AS metric, stage, "table", batch_id, epoch_us(finished_at) / 1e6::DOUBLE AS value FROM last WHERE status = 'success'
      UNION ALL SELECT 'duration_seconds', stage, "table", batch_id, duration_s FROM last
      UNION ALL SELECT 'failed', stage, "table", batch_id, CASE WHEN status = 'failed' THEN 1.0::DOUBLE ELSE 0.0 END FROM last
      UNION ALL SELECT 'rows_in', stage, "table", batch_id, rows_in::DOUBLE FROM last WHERE rows_in IS NOT NULL
      UNION ALL SELECT 'rows_quarantined', stage, "table", batch_id, rows_quarantined::DOUBLE FROM last WHERE rows_quarantined IS NOT NULL
      UNION ALL SELECT 'pass_ratio', stage, "table", batch_id, round(rows_valid::DOUBLE / rows_in, 6) FROM last WHERE rows_in > 0)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"),
        F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("t"), F.col("user_id") % 5)).alias("table"),
        F.concat(F.lit("b"), F.col("user_id") % 30).alias("batch_id"),
        F.when(F.col("value") > 40, "failed").otherwise("success").alias("status"),
        F.when(F.col("user_id") % 7 > 0, k).alias("rows_in"),
        F.floor(k / 2).alias("rows_valid"),
        F.when(F.col("value") < 100, F.col("event_id") % 3).alias("rows_quarantined"),
        F.floor(k / 2).alias("rows_out"),
        F.col("value").alias("duration_s"),
        F.col("ts").alias("finished_at"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("run_id"),
    )


@BOOK.query(f"WITH {LAST_SQL} SELECT * FROM gauges")
def run_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.run_gauges(runs(spark, sf_dir))


_PLAIN = r"regexp_replace(({})::DECIMAL(38,6)::VARCHAR, '(\.[0-9]+?)0+$', '\1')"
_AGE = "(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(finished_at)))"


@BOOK.query(
    f"""WITH {LAST_SQL} SELECT 'lake_' || metric || '{{stage="' || stage || '",table="' || "table" || '",batch="' || batch_id || '"}} ' || {_PLAIN.format("value")} AS value FROM gauges
    UNION ALL SELECT unnest(['lake_freshness_seconds{{stage="purchase"}} ' || {_PLAIN.format(_AGE + " / 1e6::DOUBLE")}, 'lake_slo_breached{{stage="purchase"}} ' || ({_AGE} > 26 * 3600 * 1000000::BIGINT)::INT::VARCHAR || '.0'])
      FROM runs WHERE stage = 'purchase' AND status = 'success'"""
)
def gauge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gauges of the latest runs, and the freshness of a stage."""
    found = runs(spark, sf_dir)
    lines = observe.exposition(observe.run_gauges(found), "lake")
    return lines.unionByName(observe.freshness_lines(observe.freshness(found, NOW, 26, stage="purchase"), "lake", "purchase"))


@BOOK.query(
    f"""WITH {RUNS_SQL} SELECT (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(finished_at))) / 1e6::DOUBLE AS freshness_seconds, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(finished_at)) > 26 * 3600 * 1000000::BIGINT AS slo_breached
    FROM runs WHERE stage = 'purchase' AND status = 'success'"""
)
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.freshness(runs(spark, sf_dir), NOW, 26, stage="purchase")


@BOOK.query(
    f"""WITH {RUNS_SQL} SELECT stage, round(sum(duration_s::DECIMAL(18,2))::DOUBLE, 2) AS seconds, coalesce(sum(rows_out), 0)::BIGINT AS rows,
    round(sum(rows_out) / round(sum(duration_s::DECIMAL(18,2))::DOUBLE, 2), 1) AS rows_per_second FROM runs GROUP BY 1"""
)
def stage_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.stage_seconds(runs(spark, sf_dir))


@BOOK.query("SELECT event_type AS stage, round(median(value), 2) AS median_seconds FROM events GROUP BY 1")
def latency_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return median_of(read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("median_seconds")), ["stage"], "median_seconds")


#: Each user's event kinds as inputs and outputs of a stage.
LINEAGE_SQL = """records AS (SELECT event_type AS stage, 't' || (user_id % 20) AS "table", 'b' || (user_id % 6) AS batch_id, event_id,
    ['in' || (event_id % 3), 'in' || (user_id % 5)] AS inputs, ['out' || (user_id % 2), 'out' || (event_id % 2)] AS outputs FROM events),
    last AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY stage, "table", batch_id ORDER BY event_id DESC) = 1)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), c)
    user, event = F.col("user_id"), F.col("event_id")
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"),
        name("t", user % 20).alias("table"),
        name("b", user % 6).alias("batch_id"),
        "event_id",
        F.array(name("in", event % 3), name("in", user % 5)).alias("inputs"),
        F.array(name("out", user % 2), name("out", event % 2)).alias("outputs"),
    )


@BOOK.query(f"""WITH {LINEAGE_SQL} SELECT stage, "table", batch_id, event_id, array_to_string(list_sort(inputs), ',') AS inputs, array_to_string(list_sort(outputs), ',') AS outputs FROM last""")
def lineage_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = observe.lineage_latest(_records(spark, sf_dir), "event_id")
    return last.withColumns({c: F.array_join(c, ",") for c in ("inputs", "outputs")})


@BOOK.query(f"""WITH {LINEAGE_SQL} SELECT DISTINCT unnest(inputs) AS upstream, "table" FROM last""")
def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.lineage_edges(observe.lineage_latest(_records(spark, sf_dir), "event_id"))


@BOOK.query(
    """SELECT 'orders' AS stage, o_orderpriority AS batch_id, 'success' AS status, count(*)::BIGINT AS rows_in, count(*) FILTER (o_totalprice <= 200000)::BIGINT AS rows_valid,
      count(*) FILTER (o_totalprice > 200000)::BIGINT AS rows_quarantined, count(*)::BIGINT AS rows_out, true AS timed, false AS failed FROM orders GROUP BY 2
    UNION ALL SELECT 'orders', 'none', 'failed', NULL, NULL, NULL, NULL, true, true"""
)
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage for each priority writes its orders and leaves a record of what passed; one fails and leaves one too."""
    root = scratch_path(spark, "records")
    orders = read(spark, sf_dir, "orders")
    rule = Rule("price_range", "range", "o_totalprice", "too dear", {"max": 200_000})
    for (priority,) in orders.select("o_orderpriority").distinct().collect():  # five
        with observe.recorded(spark, f"{root}/runs", "orders", priority) as run:
            flagged = run.split(validate(orders.where(F.col("o_orderpriority") == priority), [rule]).flagged)
            run.count(flagged).write.parquet(f"{root}/orders/{priority}")
    try:
        with observe.recorded(spark, f"{root}/runs", "orders", "none") as run:
            run.count(orders.where(F.raise_error(F.lit("no such batch")).isNull())).write.parquet(f"{root}/none")
    except Exception as e:
        if "no such batch" not in str(e):
            raise
    timed = F.col("duration_s").between(0, 86_400) & (F.col("finished_at") >= F.col("started_at"))
    return observe.read_runs(spark, f"{root}/runs").select("stage", "batch_id", "status", "rows_in", "rows_valid", "rows_quarantined", "rows_out", timed.alias("timed"), F.col("error").isNotNull().alias("failed"))


@BOOK.query(f"""WITH {LINEAGE_SQL} SELECT stage, "table", batch_id, array_to_string(list_sort(list_distinct(inputs)), ',') AS inputs, array_to_string(list_sort(list_distinct(outputs)), ',') AS outputs FROM last""")
def lineage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records are written in three runs, the later ones over the earlier, and read back."""
    path = scratch_path(spark, "lineage")
    records = _records(spark, sf_dir).withColumnRenamed("event_id", "run_at")
    last = records.agg(F.max("run_at")).first()[0]
    for k in range(3):
        observe.record_lineage(spark, path, records.where(F.expr(f"run_at * 3 div {1 + (last or 0)} = {k}")))
    return spark.read.parquet(path).select("stage", "table", "batch_id", *(F.array_join(c, ",").alias(c) for c in ("inputs", "outputs")))
