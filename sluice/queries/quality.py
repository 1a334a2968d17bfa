"""Rules on the test tables: each type alone, then all of a table, split, counted and conserved."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.calendar import calendar_of
from sluice.operators.rules import Rule, Validated, load_rules, validate
from sluice.queries.book import Book, read

BOOK = Book()

#: Lines with some nulls; half of the suppliers are known.
LINES_SQL = """lines AS (SELECT l_orderkey, l_linenumber, l_suppkey, nullif(l_quantity, 7) AS l_quantity, l_extendedprice, l_discount,
    nullif(l_returnflag, 'R') AS l_returnflag, l_shipdate, strftime(l_shipdate, '%Y-%m') AS _batch_id FROM lineitem)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    nulls = {"l_quantity": F.nullif(F.col("l_quantity"), F.lit(7.0)), "l_returnflag": F.nullif(F.col("l_returnflag"), F.lit("R"))}
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", nulls["l_quantity"].alias("l_quantity"), "l_extendedprice", "l_discount", nulls["l_returnflag"].alias("l_returnflag"), "l_shipdate", F.date_format("l_shipdate", "yyyy-MM").alias("_batch_id")
    )


def _failed(spark: SparkSession, sf_dir: str, rule: Rule, **more) -> DataFrame:
    bad = validate(_lines(spark, sf_dir), [rule], **more).flagged.where(F.size("_failed_rules") > 0)
    return bad.groupBy("l_suppkey", "_reasons").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


def _sql(condition: str, reason: str) -> str:
    return f"WITH {LINES_SQL} SELECT l_suppkey, '{reason}' AS _reasons, count(*)::BIGINT AS n, sum(l_orderkey)::BIGINT AS keys FROM lines WHERE {condition} GROUP BY 1"


@BOOK.query(_sql("l_quantity IS NULL", "quantity_known: quantity required"))
def dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failed(spark, sf_dir, Rule("quantity_known", "not_null", "l_quantity", "quantity required"))


@BOOK.query(_sql("l_quantity < 5 OR l_quantity > 45", "quantity_range: outside 5..45"))
def dq_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failed(spark, sf_dir, Rule("quantity_range", "range", "l_quantity", "outside 5..45", {"min": 5, "max": 45}))


@BOOK.query(_sql("l_returnflag IS NOT NULL AND l_returnflag NOT IN ('A')", "flag_known"))
def dq_in_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failed(spark, sf_dir, Rule("flag_known", "in_set", "l_returnflag", "", {"values": ["A"]}))


@BOOK.query(_sql("NOT regexp_matches(l_extendedprice::VARCHAR, '[05]$')", "price_ends: odd cents"))
def dq_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("price", F.col("l_extendedprice").cast("decimal(18,2)").cast("double").cast("string"))
    bad = validate(rows, [Rule("price_ends", "regex", "price", "odd cents", {"pattern": "[05]$"})]).flagged.where(F.size("_failed_rules") > 0)
    return bad.groupBy("l_suppkey", "_reasons").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@BOOK.query(
    f"""WITH {LINES_SQL}, r AS (SELECT l.*, date_trunc('month', o_orderdate) AS b FROM lines l JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_suppkey, count(*)::BIGINT AS n, sum(l_orderkey)::BIGINT AS keys FROM r
    WHERE NOT (l_shipdate >= b - INTERVAL 7 DAY AND l_shipdate < b + INTERVAL 1 MONTH) GROUP BY 1"""
)
def dq_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    dated = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM").alias("batch"))
    rule = Rule("in_window", "expression", None, "outside the window", {"expr": "l_shipdate >= '{late_start}' AND l_shipdate < '{batch_end}'"})
    calendar = calendar_of(orders, "o_orderdate").withColumnRenamed("_batch_id", "batch")
    rows = _lines(spark, sf_dir).join(dated, "l_orderkey")
    bad = validate(rows, [rule], calendar=calendar, batch="batch").flagged.where(F.size("_failed_rules") > 0)
    return bad.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@BOOK.query(
    f"""WITH {LINES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, _batch_id ORDER BY l_orderkey NULLS FIRST, l_linenumber NULLS FIRST, l_suppkey NULLS FIRST,
      l_quantity NULLS FIRST, l_extendedprice NULLS FIRST, l_discount NULLS FIRST, l_returnflag NULLS FIRST, l_shipdate NULLS FIRST, _batch_id NULLS FIRST) AS i FROM lines)
    SELECT l_suppkey, 'order_once: order stands twice in its batch' AS _reasons, count(*)::BIGINT AS n, sum(l_orderkey)::BIGINT AS keys FROM r WHERE i > 1 GROUP BY 1"""
)
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failed(spark, sf_dir, Rule("order_once", "unique", "l_orderkey", "order stands twice in its batch"), batch="_batch_id")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").where("s_acctbal >= 5000")


@BOOK.query(_sql("l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 5000)", "supplier_exists: unknown supplier"))
def dq_referential(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("supplier_exists", "referential", "l_suppkey", "unknown supplier", {"ref_table": "suppliers", "ref_column": "s_suppkey"})
    return _failed(spark, sf_dir, rule, refs={"suppliers": _suppliers(spark, sf_dir)})


RULES = [
    Rule("quantity_known", "not_null", "l_quantity", "quantity required"),
    Rule("quantity_range", "range", "l_quantity", "quantity outside 2..48", {"min": 2, "max": 48}),
    Rule("flag_known", "in_set", "l_returnflag", "unknown flag", {"values": ["A", "N"]}),
    Rule("discount_low", "expression", None, "", {"expr": "l_discount < 0.09"}),
    Rule("supplier_exists", "referential", "l_suppkey", "unknown supplier", {"ref_table": "suppliers", "ref_column": "s_suppkey"}),
]
FLAGGED_SQL = f"""{LINES_SQL}, flagged AS (SELECT *, list_filter([
      CASE WHEN l_quantity IS NULL THEN 'quantity_known: quantity required' END,
      CASE WHEN l_quantity < 2 OR l_quantity > 48 THEN 'quantity_range: quantity outside 2..48' END,
      CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag_known: unknown flag' END,
      CASE WHEN NOT coalesce(l_discount < 0.09, false) THEN 'discount_low' END,
      CASE WHEN l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 5000) THEN 'supplier_exists: unknown supplier' END], lambda x: x IS NOT NULL) AS why FROM lines)"""


def _validated(spark: SparkSession, sf_dir: str) -> Validated:
    return validate(_lines(spark, sf_dir), RULES, refs={"suppliers": _suppliers(spark, sf_dir)}, keep=("_batch_id", "l_orderkey", "l_linenumber"))


@BOOK.query(f"""WITH {FLAGGED_SQL} SELECT array_to_string(list_transform(why, lambda x: split_part(x, ':', 1)), ',') AS rules, array_to_string(why, '; ') AS _reasons, count(*)::BIGINT AS n FROM flagged GROUP BY 1, 2""")
def dq_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = _validated(spark, sf_dir).flagged.withColumn("rules", F.array_join("_failed_rules", ","))
    return flagged.groupBy("rules", "_reasons").agg(F.count("*").alias("n"))


@BOOK.query(f"WITH {FLAGGED_SQL} SELECT * EXCLUDE why FROM flagged WHERE len(why) = 0")
def dq_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).valid


@BOOK.query(
    f"""WITH {FLAGGED_SQL} SELECT _batch_id, l_orderkey, l_linenumber, array_to_string(list_transform(why, lambda x: split_part(x, ':', 1)), ',') AS rules, array_to_string(why, '; ') AS _reasons,
    strftime(l_shipdate, '%Y-%m-%d') AS ship_day, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%f') AS at, l_suppkey AS supplier, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_returnflag AS flag,
    8::INT - (l_quantity IS NULL)::INT - (l_returnflag IS NULL)::INT + 1 AS fields, true AS whole FROM flagged WHERE len(why) > 0"""
)
def dq_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = _validated(spark, sf_dir).quarantine
    kinds = "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate string, _batch_id string"
    named = "struct<order:bigint, line:int, supplier:bigint, quantity:double, price:double, discount:double, flag:string, at:string, batch:string>"
    # inline makes columns of the parsed record: it is parsed once
    bad = bad.select("_batch_id", "l_orderkey", "l_linenumber", F.array_join("_failed_rules", ",").alias("rules"), "_reasons", F.size(F.json_object_keys("_record")).alias("fields"), F.inline(F.array(F.from_json("_record", kinds).cast(named))))
    whole = F.col("order").eqNullSafe(F.col("l_orderkey")) & F.col("line").eqNullSafe(F.col("l_linenumber")) & F.col("batch").eqNullSafe(F.col("_batch_id"))
    return bad.select("_batch_id", "l_orderkey", "l_linenumber", "rules", "_reasons", F.substring("at", 1, 10).alias("ship_day"), "at", "supplier", "quantity", "price", "discount", "flag", "fields", whole.alias("whole"))


@BOOK.query(f"WITH {FLAGGED_SQL} SELECT count(*)::BIGINT AS rows_in, (count(*) FILTER (len(why) = 0))::BIGINT AS rows_valid, (count(*) FILTER (len(why) > 0))::BIGINT AS rows_quarantined FROM flagged")
def dq_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).counts


#: A whole rule set: six values that must be there, five ranges, three expressions and three references.
ORDER_RULES = [
    *(Rule(f"{c}_known", "not_null", c, f"{c} required") for c in ("ordered", "shipped", "l_partkey", "l_suppkey", "quantity", "price")),
    Rule("quantity_range", "range", "quantity", "quantity outside 1..49", {"min": 1, "max": 49}),
    Rule("price_range", "range", "price", "price outside 2000..90000", {"min": 2000, "max": 90000}),
    Rule("discount_range", "range", "l_discount", "discount outside 0..0.09", {"min": 0, "max": 0.09}),
    Rule("tax_range", "range", "l_tax", "tax outside 0..0.07", {"min": 0, "max": 0.07}),
    Rule("total_range", "range", "o_totalprice", "total outside 2000..400000", {"min": 2000, "max": 400000}),
    Rule("shipped_after_ordered", "expression", None, "shipped before ordered", {"expr": "shipped >= ordered"}),
    Rule("shipped_soon", "expression", None, "shipped after 90 days", {"expr": "datediff(shipped, ordered) <= 90"}),
    Rule("in_window", "expression", None, "outside the batch and its late window", {"expr": "shipped >= '{late_start}' AND shipped < '{batch_end}'"}),
    Rule("part_exists", "referential", "l_partkey", "unknown part", {"ref_table": "parts", "ref_column": "p_partkey"}),
    Rule("supplier_exists", "referential", "l_suppkey", "unknown supplier", {"ref_table": "suppliers", "ref_column": "s_suppkey"}),
    Rule("customer_exists", "referential", "o_custkey", "unknown customer", {"ref_table": "customers", "ref_column": "c_custkey"}),
]


@BOOK.query(
    """WITH rows AS (SELECT l_orderkey, nullif(l_partkey, 7) AS l_partkey, l_suppkey, o_custkey, nullif(l_quantity, 7) AS quantity, l_extendedprice AS price, l_discount, l_tax, o_totalprice, o_orderdate AS ordered,
      CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN NULL ELSE l_shipdate END AS shipped, date_trunc('month', o_orderdate) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    flagged AS (SELECT l_orderkey, array_to_string(list_filter([
      CASE WHEN ordered IS NULL THEN 'ordered_known' END, CASE WHEN shipped IS NULL THEN 'shipped_known' END, CASE WHEN l_partkey IS NULL THEN 'l_partkey_known' END,
      CASE WHEN l_suppkey IS NULL THEN 'l_suppkey_known' END, CASE WHEN quantity IS NULL THEN 'quantity_known' END, CASE WHEN price IS NULL THEN 'price_known' END,
      CASE WHEN quantity NOT BETWEEN 1 AND 49 THEN 'quantity_range' END, CASE WHEN price NOT BETWEEN 2000 AND 90000 THEN 'price_range' END,
      CASE WHEN l_discount NOT BETWEEN 0 AND 0.09::DOUBLE THEN 'discount_range' END, CASE WHEN l_tax NOT BETWEEN 0 AND 0.07::DOUBLE THEN 'tax_range' END, CASE WHEN o_totalprice NOT BETWEEN 2000 AND 400000 THEN 'total_range' END,
      CASE WHEN NOT coalesce(shipped >= ordered, false) THEN 'shipped_after_ordered' END, CASE WHEN NOT coalesce(datediff('day', ordered, shipped) <= 90, false) THEN 'shipped_soon' END,
      CASE WHEN NOT coalesce(shipped >= b - INTERVAL 7 DAY AND shipped < b + INTERVAL 1 MONTH, false) THEN 'in_window' END,
      CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45) THEN 'part_exists' END, CASE WHEN l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) THEN 'supplier_exists' END,
      CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -500) THEN 'customer_exists' END], lambda x: x IS NOT NULL), ',') AS rules FROM rows)
    SELECT rules, count(*)::BIGINT AS n, sum(l_orderkey)::BIGINT AS keys FROM flagged GROUP BY 1"""
)
def dq_rule_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seventeen rules over all lines with their orders; valid rows are those of no rule."""
    orders = read(spark, sf_dir, "orders")
    dated = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice", F.col("o_orderdate").alias("ordered"), F.date_format("o_orderdate", "yyyy-MM").alias("_batch_id"))
    rows = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.nullif(F.col("l_partkey"), F.lit(7)).alias("l_partkey"), "l_suppkey", F.nullif(F.col("l_quantity"), F.lit(7.0)).alias("quantity"), F.col("l_extendedprice").alias("price"), "l_discount", "l_tax",
        F.when(~((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)), F.col("l_shipdate")).alias("shipped"),
    )
    known = {"parts": ("part", "p_size <= 45"), "suppliers": ("supplier", "s_acctbal >= 0"), "customers": ("customer", "c_acctbal > -500")}
    refs = {name: read(spark, sf_dir, table).where(condition) for name, (table, condition) in known.items()}
    flagged = validate(rows.join(dated, "l_orderkey"), ORDER_RULES, calendar=calendar_of(orders, "o_orderdate"), batch="_batch_id", refs=refs).flagged
    return flagged.groupBy(F.array_join("_failed_rules", ",").alias("rules")).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


#: Rules as a file has them: what has no place of its own is a parameter of the rule's type.
RULE_FILE = """{"lines": [
  {"name": "part_known", "type": "not_null", "column": "l_partkey"},
  {"name": "tax_range", "type": "range", "column": "l_tax", "description": "tax outside 0.01..0.07", "min": 0.01, "max": 0.07},
  {"name": "status_known", "type": "in_set", "column": "l_linestatus", "values": ["O"]},
  {"name": "flag_letter", "type": "regex", "column": "l_returnflag", "description": "no such flag", "pattern": "^[AN]$"},
  {"name": "dear_enough", "type": "expression", "expr": "l_extendedprice >= 1000 * l_quantity"},
  {"name": "supplier_exists", "type": "referential", "column": "l_suppkey", "ref_table": "suppliers", "ref_column": "s_suppkey"}],
 "orders": [{"name": "once", "type": "unique", "column": "o_orderkey"}]}"""


@BOOK.query(
    """SELECT array_to_string(list_filter([CASE WHEN l_partkey IS NULL THEN 'part_known' END, CASE WHEN l_tax NOT BETWEEN 0.01::DOUBLE AND 0.07::DOUBLE THEN 'tax_range: tax outside 0.01..0.07' END,
      CASE WHEN l_linestatus NOT IN ('O') THEN 'status_known' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag_letter: no such flag' END, CASE WHEN NOT coalesce(l_extendedprice >= 1000 * l_quantity, false) THEN 'dear_enough' END,
      CASE WHEN l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 5000) THEN 'supplier_exists' END], lambda x: x IS NOT NULL), '; ') AS _reasons, count(*)::BIGINT AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem GROUP BY 1"""
)
def dq_loaded_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of one table of a rule file, over all its rows."""
    flagged = validate(read(spark, sf_dir, "lineitem"), load_rules(json.loads(RULE_FILE), "lines"), refs={"suppliers": _suppliers(spark, sf_dir)}).flagged
    return flagged.groupBy("_reasons").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))
