"""Keys, merges, replacement, serving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.keys import first_per_key, fingerprint_diff, fingerprints, latest_per_key, text_fingerprint
from sluice.operators.serving import capped_sql, page, page_after, role_tables, scoped_session, token_of
from sluice.operators.tables import merge_upsert, publish, publish_partitions, replace_files, replace_where, scratch_path
from sluice.queries.book import Book, read

BOOK = Book()


@BOOK.query("SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1", name="latest_per_key")
def latest_per_key_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_key(read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@BOOK.query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice ASC, o_orderkey) = 1")
def first_per_key_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per_key(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").asc(), F.col("o_orderkey").asc()])


@BOOK.query(
    """SELECT o_custkey, o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS updated_at, strftime(o_orderdate, '%Y-%m') AS _batch_id, o_orderkey FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
)
def latest_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"), F.date_format("o_orderdate", "yyyy-MM").alias("_batch_id"), "o_orderkey")
    return latest_per_key(rows, ["o_custkey"], ["updated_at", "_batch_id", "o_orderkey"])


@BOOK.query(
    """SELECT DISTINCT l_orderkey, l_linenumber, _batch_id, l_quantity, l_extendedprice, l_discount, l_suppkey, l_partkey FROM (
      SELECT *, strftime(l_shipdate, '%Y-%m') AS _batch_id, rank() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY strftime(l_shipdate, '%Y-%m') DESC, nullif(l_quantity, 7) DESC NULLS LAST,
        l_extendedprice DESC, l_discount DESC, l_suppkey DESC, l_partkey DESC) AS r FROM lineitem) WHERE r = 1"""
)
def dedupe_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM").alias("_batch_id"), F.nullif(F.col("l_quantity"), F.lit(7.0)).alias("q"), "l_quantity", "l_extendedprice", "l_discount", "l_suppkey", "l_partkey")
    return latest_per_key(rows, ["l_orderkey", "l_linenumber"], ["_batch_id", "q", "l_extendedprice", "l_discount", "l_suppkey", "l_partkey"]).drop("q")


#: Two overlapping loads of orders: the second has changed prices and new keys.
LOADS_SQL = """t AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, 1 AS batch FROM orders WHERE o_orderkey % 10 < 7),
    s AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice + 1 AS price, CASE WHEN o_orderkey % 10 = 5 THEN 0 ELSE 2 END AS batch FROM orders WHERE o_orderkey % 10 >= 4)"""


def _loads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders")
    key, status = F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status")
    t = orders.where("o_orderkey % 10 < 7").select(key, status, F.col("o_totalprice").alias("price"), F.lit(1).alias("batch"))
    s = orders.where("o_orderkey % 10 >= 4").select(key, status, (F.col("o_totalprice") + 1).alias("price"), F.when(F.col("o_orderkey") % 10 == 5, 0).otherwise(2).alias("batch"))
    return t, s


@BOOK.query(
    f"""WITH {LOADS_SQL} SELECT coalesce(t.k, s.k) AS k, CASE WHEN u THEN s.status ELSE t.status END AS status, CASE WHEN u THEN s.price ELSE t.price END AS price, CASE WHEN u THEN s.batch ELSE t.batch END AS batch
    FROM (SELECT t, s, s.k IS NOT NULL AND (t.k IS NULL OR s.batch >= t.batch) AS u FROM t FULL JOIN s ON t.k = s.k)""",
    name="merge_upsert",
)
def merge_upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = _loads(spark, sf_dir)
    return merge_upsert(t, s, ["k"], update_when="s.batch >= t.batch")


@BOOK.query(
    f"""WITH {LOADS_SQL} SELECT k, status, price, batch FROM t WHERE NOT coalesce(price > 300000, false)
    UNION ALL SELECT k, status, price, batch FROM s WHERE price > 300000""",
    name="replace_where",
)
def replace_where_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = _loads(spark, sf_dir)
    return replace_where(t, s.where("price > 300000"), "price > 300000")


# The same on disk: written, changed in place and read back.


@BOOK.query(
    f"""WITH {LOADS_SQL} SELECT k, status, price, batch FROM t WHERE NOT coalesce(price > 300000, false)
    UNION ALL SELECT k, status, price, batch FROM s WHERE price > 300000"""
)
def replace_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced in part, by a plan that reads it, twice."""
    path = scratch_path(spark, "replaced")
    t, s = _loads(spark, sf_dir)
    publish(t, path)
    for _ in range(2):
        publish(replace_where(spark.read.parquet(path), s.where("price > 300000"), "price > 300000"), path)
    return spark.read.parquet(path)


@BOOK.query("SELECT p_partkey::VARCHAR AS part_key, p_brand AS brand, p_retailprice AS price, p_size > 25 AS large FROM part")
def overwrite_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written over by one of other columns and types, made from it."""
    path = scratch_path(spark, "overwritten")
    publish(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), "p_name", "p_brand", "p_size", "p_retailprice"), path)
    old = spark.read.parquet(path)
    publish(old.select(F.col("part_key").cast("string").alias("part_key"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"), (F.col("p_size") > 25).alias("large")), path)
    return spark.read.parquet(path)


@BOOK.query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN year(l_shipdate) = 1998 THEN l_extendedprice + 1 ELSE l_extendedprice END AS price, coalesce(strftime(l_shipdate, '%Y-%m'), 'none') AS _batch_id
    FROM lineitem WHERE coalesce(year(l_shipdate) <> 1998 OR (month(l_shipdate) <= 6 AND l_quantity >= 10), true)"""
)
def partitions_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by month; the months of one year are replaced, those of its second half by nothing, others left as they are."""
    path = scratch_path(spark, "months")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").alias("price"), F.coalesce(F.date_format("l_shipdate", "yyyy-MM"), F.lit("none")).alias("_batch_id"))
    publish(lines, path, ["_batch_id"])
    year = lines.where("_batch_id LIKE '1998-%'").withColumn("price", F.col("price") + 1)
    publish_partitions(year.where("_batch_id <= '1998-06' AND l_quantity >= 10"), path, "_batch_id", year)
    return spark.read.schema(lines.schema).parquet(path).drop("l_quantity")


@BOOK.query(
    """SELECT l_orderkey, l_linenumber, l_shipdate, CASE WHEN l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1996-06-01' THEN l_extendedprice + 1 ELSE l_extendedprice END AS price
    FROM lineitem WHERE NOT (l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1996-06-01' AND l_quantity < 10)"""
)
def replace_files_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in files by ship date; three months are made anew from the table itself, twice, in the files that have any of them."""
    path = scratch_path(spark, "pruned")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", F.col("l_extendedprice").alias("price"))
    lines.repartitionByRange(16, "l_shipdate").sortWithinPartitions("l_shipdate").write.parquet(path)
    window = "l_shipdate >= TIMESTAMP_NTZ'1996-03-01' AND l_shipdate < TIMESTAMP_NTZ'1996-06-01'"
    for more in (1, 0):
        new = spark.read.parquet(path).where(window).where("l_quantity >= 10")
        replace_files(new.withColumn("price", F.col("price") + more), path, window, order=["l_shipdate"])
    return spark.read.parquet(path).drop("l_quantity")


@BOOK.query(name="fingerprint")
def fingerprint_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints({t: read(spark, sf_dir, t) for t in ("orders", "customer", "supplier", "part", "nation", "region", "lineitem")})


@BOOK.query(
    """SELECT count(*)::BIGINT AS rows, sum(('0x' || substr(md5(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, coalesce(nullif(o_orderstatus, 'P'), '~'), o_orderpriority)), 1, 15))::BIGINT)::DECIMAL(38,0) AS digest FROM orders"""
)
def fingerprint_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_fingerprint(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.nullif(F.col("o_orderstatus"), F.lit("P")), "o_orderpriority"))


@BOOK.query(
    """SELECT * FROM (SELECT 'orders' AS "table", (SELECT count(*) FROM orders) AS rows_before, (SELECT count(*) FROM orders) AS rows_after, true AS equal
    UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer), (SELECT count(*) FROM customer WHERE c_acctbal < 0) = 0
    UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), NULL, false)""",
    name="fingerprint_diff",
)
def fingerprint_diff_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: read(spark, sf_dir, n) for n in ("orders", "customer", "nation")}
    changed = t["customer"].withColumn("c_acctbal", F.greatest(F.col("c_acctbal"), F.lit(0.0)))
    return fingerprint_diff(fingerprints(t), fingerprints({"orders": t["orders"].repartition(3), "customer": changed}))


POLICY = [("analyst", "orders"), ("analyst", "nation"), ("analyst", "absent"), ("operator", "orders"), ("operator", "customer"), ("operator", "nation")]


@BOOK.query(
    """SELECT role, t AS "table", n AS rows FROM (VALUES ('analyst', 'orders'), ('analyst', 'nation'), ('operator', 'orders'), ('operator', 'customer'), ('operator', 'nation')) p(role, t)
    JOIN (SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'nation', count(*) FROM nation) USING (t)""",
    name="role_tables",
)
def role_tables_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: read(spark, sf_dir, t) for t in ("orders", "customer", "nation")}
    registry = fingerprints(tables).select("table", "rows")
    return role_tables(spark.createDataFrame(POLICY, "role string, table string"), registry)


@BOOK.query("SELECT c_mktsegment, count(*)::BIGINT AS n, round(sum(c_acctbal::DECIMAL(18,2)), 2)::DECIMAL(28,2) AS balance FROM customer GROUP BY 1 ORDER BY 1 LIMIT 4")
def scoped_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = scoped_session(spark, {t: (lambda s, t=t: read(s, sf_dir, t)) for t in ("customer", "orders")}, ["customer"])
    return capped_sql(session, "SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS balance FROM customer GROUP BY 1 ORDER BY 1 -- segments", rows=4)


@BOOK.query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100")
def browse_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 100, 25)


@BOOK.query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders WHERE (o_orderpriority, o_orderkey) > ('3-MEDIUM', 1000) ORDER BY o_orderpriority, o_orderkey LIMIT 75")
def continued_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages, each by the token of the last row before it."""
    orders, order = read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority", "o_orderkey"]
    token, out = token_of({"o_orderpriority": "3-MEDIUM", "o_orderkey": 1000}, order, orders), None
    for _ in range(3):
        found = page_after(orders, order, token, 25)
        out = found if out is None else out.unionByName(found)
        last = found.orderBy(*(F.desc(c) for c in order)).first()
        if last is None:
            break
        token = token_of(last, order, orders)
    return out
