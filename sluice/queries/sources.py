"""Sources, contracts, and the projection into the silver shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.calendar import arrival, bounds, calendar_of
from sluice.jobs.layers import bronze, load_bronze
from sluice.operators.contracts import BreakingSchema, Contract, conform, drift_rows, evolve_union
from sluice.operators.keys import row_id
from sluice.operators.observe import read_runs, table_columns
from sluice.operators.tables import scratch_path
from sluice.queries.book import Book, read
from sluice.sources.files import land_manifest, manifest, manifest_mismatches, parallel_arrays_to_rows, read_batches, read_evolved, read_payloads, verify_manifest, write_batches
from sluice.sources.snapshots import asof_snapshot, asof_snapshots, keyed_lookup, read_lookup

BOOK = Book()
CUTOFF = "1998-01-01"
LOADED = "2024-02-01 00:00:00"

LINES = Contract(
    "lines",
    {
        "l_orderkey": "bigint", "l_linenumber": "bigint", "l_suppkey": "bigint", "l_quantity": "double", "l_extendedprice": "double",
        "l_discount": "double", "l_returnflag": "string", "l_shipdate": "timestamp_ntz", "l_comment": "string",
    },
    frozenset({"l_orderkey", "l_linenumber", "l_shipdate"}),
)
ORDERS = Contract("orders", {"o_orderkey": "double", "o_custkey": "bigint", "o_totalprice": "int", "o_orderdate": "timestamp", "o_clerk": "string", "o_region": "bigint"}, frozenset({"o_orderkey", "o_region"}))


@BOOK.query(
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag, l_shipdate,
    NULL::VARCHAR AS l_comment, l_partkey, l_tax, l_linestatus FROM lineitem"""
)
def read_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(read(spark, sf_dir, "lineitem"), LINES)[0]


@BOOK.query(
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag, l_shipdate,
    NULL::VARCHAR AS l_comment, l_partkey, l_tax, l_linestatus,
    'lines' AS _source, TIMESTAMP '2024-02-01 00:00:00' AS _ingested_at, strftime(l_shipdate, '%Y-%m') AS _batch_id
    FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') = '1997-05'"""
)
def bronze_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bronze(read(spark, sf_dir, "lineitem"), LINES, "lines", LOADED, F.date_format("l_shipdate", "yyyy-MM"))
    return rows.where(F.col("_batch_id") == "1997-05")


@BOOK.query(
    """SELECT t.*, n.nulls FROM (VALUES
    ('o_orderkey', 'widened', 'bigint', 'double'), ('o_custkey', 'same', 'bigint', 'bigint'), ('o_totalprice', 'breaking', 'double', 'int'),
    ('o_orderdate', 'widened', 'timestamp_ntz', 'timestamp'), ('o_clerk', 'missing', NULL, 'string'), ('o_region', 'breaking', NULL, 'bigint'),
    ('o_orderstatus', 'added', 'string', NULL), ('o_orderpriority', 'added', 'string', NULL)) t("column", status, got, want)
    LEFT JOIN (SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice', 'o_orderdate', 'o_orderstatus', 'o_orderpriority']) AS "column",
      unnest([count(*) FILTER (o_orderkey IS NULL), count(*) FILTER (o_custkey IS NULL), count(*) FILTER (o_totalprice IS NULL), count(*) FILTER (o_orderdate IS NULL),
        count(*) FILTER (o_orderstatus IS NULL), count(*) FILTER (o_orderpriority IS NULL)]) AS nulls FROM orders) n USING ("column")"""
)
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    nulls = table_columns({"orders": orders}).select("column", "nulls")
    return drift_rows(spark, ORDERS, dict(orders.dtypes)).join(nulls, "column", "left")


@BOOK.query(
    """SELECT 'months' AS contract, NULL AS problem, count(*)::BIGINT AS rows FROM orders
    UNION ALL SELECT 'orders', 'orders is broken by o_totalprice: double values do not fit a int column, o_region: required, but not in the table', count(*) FILTER (false) FROM orders"""
)
def contract_enforced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by a contract that they fit, and by one that they break in two columns: no row of these is read."""
    orders, out = read(spark, sf_dir, "orders"), None
    for name, contract in (("months", MONTHS), ("orders", ORDERS)):
        try:
            rows, problem = conform(orders, contract)[0], None
        except BreakingSchema as e:
            rows, problem = spark.createDataFrame([], orders.schema), str(e)
        found = rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("contract"), F.lit(problem).cast("string").alias("problem"), "rows")
        out = found if out is None else out.unionByName(found)
    return out


@BOOK.query(
    """SELECT o_orderkey, o_custkey::DOUBLE AS o_custkey, o_totalprice, NULL::VARCHAR AS o_channel FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT o_orderkey, o_custkey + 0.5, NULL, 'web' FROM orders WHERE o_orderkey % 2 = 1"""
)
def schema_evolve_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    old = orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", "o_totalprice")
    new = orders.where("o_orderkey % 2 = 1").select("o_orderkey", (F.col("o_custkey") + F.lit(0.5)).alias("o_custkey"), F.lit("web").alias("o_channel"))
    return evolve_union(old, new)


#: The test tables, as column and type.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _columns_sql(table: str) -> str:
    names, types = zip(*(c.split() for c in TABLES[table].split(", ")))
    nulls = ", ".join(f"count(*) FILTER ({c} IS NULL)" for c in names)
    return f"""SELECT '{table}' AS "table", unnest(range({len(names)}))::INT AS position, unnest({list(names)}) AS "column", unnest({list(types)}) AS type, unnest(nulls) AS nulls, rows FROM (SELECT [{nulls}] AS nulls, count(*) AS rows FROM {table})"""


@BOOK.query(" UNION ALL ".join(map(_columns_sql, TABLES)), name="table_columns")
def table_columns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_columns({t: read(spark, sf_dir, t) for t in TABLES})


@BOOK.query(
    """SELECT vec_id, i::DOUBLE AS time, embedding[i]::DOUBLE AS high, CASE WHEN i <= 5 THEN embedding[i + 10]::DOUBLE END AS low, NULL::DOUBLE AS rain
    FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)"""
)
def parallel_arrays_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.sequence(F.lit(1), F.size("embedding")).cast("array<double>").alias("time"), F.concat("embedding", F.slice("embedding", 1, 3)).alias("high"), F.slice("embedding", 11, 5).alias("low"), F.lit(None).cast("array<double>").alias("rain"))
    return parallel_arrays_to_rows(rows, "time", {"high": "double", "low": "double", "rain": "double"}, keep=["vec_id"])


@BOOK.query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'", name="asof_snapshot")
def asof_snapshot_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof_snapshot(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", CUTOFF, ["o_orderkey"])


@BOOK.query(
    """WITH m AS (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS b FROM orders)
    SELECT strftime(b, '%Y-%m') AS _batch_id, count(*)::BIGINT AS orders, max(o_orderkey) AS last_key
    FROM m JOIN orders ON o_orderdate < b + INTERVAL 1 MONTH GROUP BY 1"""
)
def asof_snapshots_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    snapshots = asof_snapshots(orders, "o_orderdate", calendar_of(orders, "o_orderdate"))
    return snapshots.groupBy("_batch_id").agg(F.count("*").alias("orders"), F.max("o_orderkey").alias("last_key"))


@BOOK.query(
    """SELECT p_brand, p_type, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey DESC) = 1"""
)
def keyed_lookup_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey", "p_name")
    return keyed_lookup(part.withColumn("line", F.col("p_partkey")), ["p_brand", "p_type"], "line")


@BOOK.query("SELECT 'orders_' || strftime(o_orderdate, '%Y-%m') || '.parquet' AS name, count(*)::BIGINT AS rows, true AS digested FROM orders GROUP BY 1")
def landing_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of month files is landed, its manifest written before anything reads it, and verified; the rows of each file beside its digest."""
    path = scratch_path(spark, "landing")
    write_batches(read(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM")), path, "month", "orders")
    recorded = land_manifest(spark, path)
    verify_manifest(recorded, manifest(spark, path))
    rows = read_batches(spark, path).groupBy(F.col("_source_file").alias("name")).agg(F.count("*").alias("rows"))
    digested = F.col("sha256").rlike("^[0-9a-f]{64}$") & (F.col("bytes") > 0)
    return recorded.join(rows, "name", "full_outer").select("name", "rows", F.coalesce(digested, F.lit(False)).alias("digested"))


@BOOK.query(
    """SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 'missing' ELSE 'changed' END AS problem FROM documents
    WHERE doc_id % 7 = 3 OR (doc_id % 5 = 1 AND text <> '')"""
)
def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    recorded = docs.select("doc_id", F.sha2("text", 256).alias("sha256"))
    fresh = docs.where("doc_id % 7 != 3").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 1, "").otherwise(F.col("text")), 256).alias("sha256"))
    return manifest_mismatches(recorded, fresh, ["doc_id"])


@BOOK.query(
    """SELECT strftime(b, '%Y-%m') AS _batch_id, b::DATE AS batch_start, (b + INTERVAL 1 MONTH)::DATE AS batch_end, (b - INTERVAL 7 DAY)::DATE AS late_start
    FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS b FROM orders)"""
)
def batch_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar_of(read(spark, sf_dir, "orders"), "o_orderdate")


@BOOK.query(
    """SELECT l_orderkey, l_linenumber, sha256(concat_ws('|', coalesce(l_orderkey::VARCHAR, '~'), coalesce(l_linenumber::VARCHAR, '~'),
      coalesce(l_suppkey::VARCHAR, '~'), coalesce(strftime(nullif(l_shipdate, TIMESTAMP '1998-05-05'), '%Y-%m-%d %H:%M:%S'), '~'), coalesce(l_returnflag, '~'))) AS row_id FROM lineitem""",
    name="row_id",
)
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    shipped = F.nullif(F.col("l_shipdate"), F.to_timestamp_ntz(F.lit("1998-05-05 00:00:00")))
    return lines.select("l_orderkey", "l_linenumber", row_id("l_orderkey", "l_linenumber", "l_suppkey", shipped, "l_returnflag").alias("row_id"))


@BOOK.query(
    """SELECT event_id, ts::DATE AS event_date, user_id::INT AS user_id, trunc(value)::INT AS whole_value, (epoch_us(ts) // 1000000 - epoch_us(date_trunc('day', ts)) // 1000000)::BIGINT AS day_seconds,
    (json_extract_string(props, '$.k'))::INT AS k FROM events"""
)
def silver_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.to_date("ts").alias("event_date"),
        F.col("user_id").cast("int").alias("user_id"),
        F.col("value").cast("int").alias("whole_value"),
        (F.unix_timestamp(ts) - F.unix_timestamp(F.date_trunc("day", ts))).alias("day_seconds"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


@BOOK.query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_shipdate, o_orderdate, date_trunc('month', o_orderdate) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_orderkey, l_linenumber, strftime(b, '%Y-%m') AS _batch_id,
      CASE WHEN l_shipdate < b - INTERVAL 7 DAY OR l_shipdate >= b + INTERVAL 1 MONTH THEN 'rejected' WHEN l_shipdate < b THEN 'late' ELSE 'on_time' END AS arrival FROM r"""
)
def late_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM").alias("_batch_id"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(orders, "l_orderkey")
    rows = rows.select("l_orderkey", "l_linenumber", "l_shipdate", "_batch_id", *bounds(F.col("_batch_id")))
    return rows.select("l_orderkey", "l_linenumber", "_batch_id", arrival("l_shipdate").alias("arrival"))


# Sources as files: written from the tables into a fresh folder first, then read as they would be landed.


@BOOK.query("SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m') AS _batch_id, 'orders_' || strftime(o_orderdate, '%Y-%m') || '.parquet' AS _source_file FROM orders")
def read_batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "landed")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    write_batches(orders, path, "month", "orders")
    return read_batches(spark, path)


@BOOK.query("SELECT n_nationkey::VARCHAR AS station, c_name AS time, c_acctbal AS balance, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment, NULL::DOUBLE AS rain FROM customer JOIN nation ON c_nationkey = n_nationkey")
def read_payload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document of parallel arrays for each nation, with nulls inside an array and an array that is missing."""
    path = scratch_path(spark, "payloads")
    customers = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey")
    segment = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).otherwise("")
    rows = customers.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_name", "c_acctbal", segment.alias("segment")))).alias("x"))
    station = F.transform("x", lambda _: F.col("c_nationkey").cast("string"))
    segments = F.transform("x.segment", lambda s: F.nullif(s, F.lit("")))
    daily = F.struct(station.alias("station"), F.col("x.c_name").alias("time"), F.col("x.c_acctbal").alias("balance"), segments.alias("segment"))
    rows.select(F.to_json(F.struct(daily.alias("daily")), {"ignoreNullFields": "false"}).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    schema = "daily struct<station: array<string>, time: array<string>, balance: array<double>, segment: array<string>, rain: array<double>>"
    return read_payloads(spark, path, schema, "daily.time", {"daily.station": "string", "daily.balance": "double", "daily.segment": "string", "daily.rain": "double"})


@BOOK.query("SELECT p_brand, p_type, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey DESC) = 1")
def read_lookup_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file with a header, in the order of its keys; of a key the last line wins."""
    path = scratch_path(spark, "lookup")
    part = read(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey", "p_name")
    part.orderBy("p_partkey").coalesce(1).write.csv(path, header=True)
    return read_lookup(spark, path, "p_brand string, p_type string, p_partkey long, p_name string", ["p_brand", "p_type"])


@BOOK.query(
    """SELECT event_type AS stage, count(DISTINCT ts::DATE)::BIGINT AS runs, count(*)::BIGINT AS rows_in, max(ts) AS last FROM events WHERE day(ts) % 2 = 1 GROUP BY 1"""
)
def read_run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run record for each kind of event and day, one JSON document a file; those of even days are cut short, and skipped."""
    path = scratch_path(spark, "runs")
    days = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage"), F.to_date("ts").alias("day")).agg(F.count("*").alias("rows_in"), F.max("ts").alias("last"))
    record = F.to_json(F.struct("stage", "rows_in", F.date_format("last", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("finished_at")))
    cut = F.when(F.day("day") % 2 == 0, F.expr("left(record, 9)")).otherwise(F.col("record"))
    days.withColumn("record", record).select(cut.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    runs = read_runs(spark, path).where("stage is not null")
    return runs.groupBy("stage").agg(F.count("*").alias("runs"), F.sum("rows_in").alias("rows_in"), F.max(F.col("finished_at").cast("timestamp_ntz")).alias("last"))


#: Orders as months of three schemas: narrow keys and no price; the contract's own; a further column, and keys as they come.
MONTHS = Contract("orders", {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "o_orderdate": "timestamp_ntz"}, frozenset({"o_orderkey", "o_orderdate"}))
MONTHS_SQL = """SELECT o_orderkey, o_custkey, CASE WHEN year(o_orderdate) >= 1995 THEN o_totalprice END AS o_totalprice, o_orderdate, CASE WHEN year(o_orderdate) >= 1997 THEN o_orderpriority END AS priority, strftime(o_orderdate, '%Y-%m') AS _batch_id"""


def _land_months(spark: SparkSession, sf_dir: str, path: str) -> None:
    orders = read(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    key, customer, date = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    write_batches(orders.where("month < '1995'").select(key.cast("int").alias("O_OrderKey"), customer.cast("int").alias("o_custkey"), date, "month"), path, "month", "orders")
    write_batches(orders.where("month >= '1995' AND month < '1997'").select(key, customer, "o_totalprice", date, "month"), path, "month", "orders")
    write_batches(orders.where("month >= '1997'").select(date, key, customer, F.col("o_orderpriority").alias("priority"), "o_totalprice", "month"), path, "month", "orders")


@BOOK.query(MONTHS_SQL + ", 'orders_' || strftime(o_orderdate, '%Y-%m') || '.parquet' AS _source_file FROM orders")
def read_drifting_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months whose columns differ in type, number and order, in one reading by the contract."""
    path = scratch_path(spark, "drifting")
    _land_months(spark, sf_dir, path)
    return read_batches(spark, path, MONTHS)


@BOOK.query(f"SELECT * REPLACE (CASE WHEN _batch_id LIKE '1995-0%' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice), 'orders' AS _source FROM ({MONTHS_SQL} FROM orders)")
def bronze_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed months as a table by month; some months are landed again, changed, and loaded over their own partitions alone."""
    landed, table = scratch_path(spark, "drifting"), scratch_path(spark, "bronze")
    _land_months(spark, sf_dir, landed)
    load_bronze(spark, landed, table, MONTHS, "orders", LOADED)
    again = scratch_path(spark, "again")
    changed = read(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM")).where("month LIKE '1995-0%'")
    write_batches(changed.select("o_orderkey", "o_custkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), "o_orderdate", "month"), again, "month", "orders")
    load_bronze(spark, again, table, MONTHS, "orders", LOADED)
    return read_evolved(spark, table).drop("_ingested_at")
