"""Run records, lineage and catalogs as tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sluice.operators.keys import latest_per_key
from sluice.operators.tables import exists, merge_upsert, publish

#: The columns of run records.
RUNS = "stage string, table string, batch_id string, status string, rows_in long, rows_valid long, rows_quarantined long, rows_out long, duration_s double, finished_at timestamp, run_id string"
#: What a record on disk has besides.
RECORD = f"{RUNS}, started_at timestamp, error string"
GAUGES = ("last_success_seconds", "duration_seconds", "failed", "rows_in", "rows_quarantined", "pass_ratio")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows from one JSON document a file; what is not JSON is skipped."""
    return spark.read.schema(RECORD).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


class RunRecord:
    """What a stage has done so far; see recorded."""

    def __init__(self, stage: str, batch_id: str, table: str | None) -> None:
        self.fields = {"stage": stage, "table": table, "batch_id": batch_id, "run_id": uuid.uuid4().hex}
        self.seen: dict[str, Observation] = {}
        self.batches: list[dict] = []

    def by_batch(self, counts: Iterable[Mapping]) -> None:
        """What each batch of a stage that runs many at once has done (batch_id and counts): there is a record for each, instead of one."""
        self.batches = [dict(c) for c in counts]

    def count(self, df: DataFrame, name: str = "rows_out") -> DataFrame:
        """df, whose rows are counted as they are written: no further pass."""
        self.seen[name] = Observation(f"{name}-{self.fields['run_id']}")
        return df.observe(self.seen[name], F.count(F.lit(1)).alias(name))

    def split(self, validated: DataFrame) -> DataFrame:
        """Flagged rows (of a rule run), counted as rows_in, rows_valid and rows_quarantined as they are written."""
        good = F.size("_failed_rules") == 0
        self.seen["split"] = Observation(f"split-{self.fields['run_id']}")
        return validated.observe(self.seen["split"], F.count(F.lit(1)).alias("rows_in"), F.count_if(good).alias("rows_valid"), F.count_if(~good).alias("rows_quarantined"))


@contextmanager
def recorded(spark: SparkSession, path: str, stage: str, batch_id: str, table: str | None = None) -> Iterator[RunRecord]:
    """Time a stage and append one run record (RECORD) to the folder `path`, for a failed stage too.

    What the stage counts through the record is there if it was written before the end.
    A stage of many batches leaves a record for each (RunRecord.by_batch), or one if it fails.
    """
    record, began = RunRecord(stage, batch_id, table), datetime.now(UTC)
    end: dict = {"status": "failed"}
    try:
        yield record
        end = {"status": "success"} | {k: v for seen in record.seen.values() for k, v in seen.get.items()}
    except BaseException as e:
        end["error"] = f"{type(e).__name__}: {e}"[:2_000]
        raise
    finally:
        done = datetime.now(UTC)
        times = {"started_at": began.isoformat(), "finished_at": done.isoformat(), "duration_s": (done - began).total_seconds()}
        parts = record.batches if end["status"] == "success" and record.batches else [{}]
        lines = spark.createDataFrame([(json.dumps(record.fields | end | times | x),) for x in parts], "value string")
        lines.coalesce(1).write.option("maxRecordsPerFile", 1).mode("append").text(path)


def record_lineage(spark: SparkSession, path: str, records: DataFrame) -> None:
    """Keep records (stage, table, batch_id, inputs, outputs, run_at) in the table at path, one of each key: the last written wins."""
    lists = {c: F.sort_array(F.array_distinct(c)) for c in ("inputs", "outputs")}
    keys = ["stage", "table", "batch_id"]
    new = latest_per_key(records.withColumns(lists), keys, ["run_at"])
    publish(merge_upsert(spark.read.parquet(path), new, keys, checked=True) if exists(spark, path) else new, path)


def pass_ratio(valid: str = "rows_valid", total: str = "rows_in") -> Column:
    """valid / total to six digits; null without rows in."""
    return F.round(F.try_divide(F.col(valid).cast("double"), F.col(total).cast("double")), 6)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Of each (stage, table or 'all', batch_id) the run that finished last; ties to the greater run_id."""
    runs = runs.withColumn("table", F.coalesce("table", F.lit("all")))
    keys = ["stage", "table", "batch_id"]
    rest = [c for c in runs.columns if c not in keys]
    last = runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("finished_at", "run_id")).alias("x"))
    return last.select(*keys, "x.*")


def run_gauges(runs: DataFrame) -> DataFrame:
    """(metric, stage, table, batch_id, value) of the latest run of each key; what a run does not have gives no row."""
    done = F.col("status") == "success"
    seconds = F.unix_micros(F.col("finished_at").cast("timestamp")) / 1e6
    values = latest_runs(runs).select(
        "stage",
        "table",
        "batch_id",
        F.when(done, seconds).alias("last_success_seconds"),
        F.col("duration_s").cast("double").alias("duration_seconds"),
        F.when(F.col("status") == "failed", 1.0).otherwise(0.0).alias("failed"),
        F.col("rows_in").cast("double").alias("rows_in"),
        F.col("rows_quarantined").cast("double").alias("rows_quarantined"),
        pass_ratio().alias("pass_ratio"),
    )
    long = values.unpivot(["stage", "table", "batch_id"], list(GAUGES), "metric", "value")
    return long.where("value is not null").select("metric", "stage", "table", "batch_id", "value")


def _plain(value: Column) -> Column:
    """A number with its digits, six behind the point at most and one at least, never in powers of ten."""
    return F.regexp_replace(value.cast("decimal(38,6)").cast("string"), r"(\.[0-9]+?)0+$", "$1")


def exposition(gauges: DataFrame, prefix: str) -> DataFrame:
    """A line `name{labels} value` for each gauge, for df.write.text."""
    label = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    text = F.format_string(prefix + '_%s{stage="%s",table="%s",batch="%s"} %s', "metric", label("stage"), label("table"), label("batch_id"), _plain(F.col("value")))
    return gauges.select(text.alias("value"))


def freshness_lines(fresh: DataFrame, prefix: str, stage: str = "gold") -> DataFrame:
    """The lines of freshness(..): the age in seconds, none without a success, and 1 where the objective is breached."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'{prefix}_{name}{{stage="{stage}"}} '), _plain(value)))
    lines = F.array_compact(F.array(line("freshness_seconds", F.col("freshness_seconds")), line("slo_breached", F.col("slo_breached").cast("double"))))
    return fresh.select(F.explode(lines).alias("value"))


def freshness(runs: DataFrame, now: datetime, slo_hours: float, stage: str = "gold") -> DataFrame:
    """One row (freshness_seconds, slo_breached): the age of the last success of all the stage's runs; none is a breach."""
    last = F.max(F.when((F.col("stage") == stage) & (F.col("status") == "success"), F.col("finished_at").cast("timestamp")))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(last)) / 1e6
    return runs.agg(age.alias("freshness_seconds")).select("freshness_seconds", F.coalesce(F.col("freshness_seconds") > slo_hours * 3600, F.lit(True)).alias("slo_breached"))


def stage_seconds(runs: DataFrame) -> DataFrame:
    """(stage, seconds, rows, rows_per_second): summed durations to 2 digits, and throughput to 1; null without time."""
    sums = runs.groupBy("stage").agg(F.round(F.sum("duration_s"), 2).alias("seconds"), F.coalesce(F.sum("rows_out"), F.lit(0)).alias("rows"))
    return sums.withColumn("rows_per_second", F.round(F.try_divide(F.col("rows").cast("double"), F.col("seconds")), 1))


def lineage_latest(records: DataFrame, order: str) -> DataFrame:
    """Of each (stage, table, batch_id) the record that is last in `order`, its inputs and outputs sorted."""
    rows = records.groupBy("stage", "table", "batch_id").agg(F.max(F.struct(order, F.sort_array("inputs").alias("inputs"), F.sort_array("outputs").alias("outputs"))).alias("x"))
    return rows.select("stage", "table", "batch_id", "x.*")


def lineage_edges(records: DataFrame, upstream: str = "inputs", table: str = "table") -> DataFrame:
    """(upstream, table): each once."""
    return records.select(F.explode(upstream).alias("upstream"), F.col(table).alias("table")).distinct()


def table_columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, position, column, type, nulls, rows) of each table's columns, in one scan of each."""
    out = None
    for name, df in tables.items():
        types = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type")) for i, (c, t) in enumerate(df.dtypes)))
        counts = df.agg(F.count("*").alias("rows"), F.array(*(F.count_if(F.col(c).isNull()) for c in df.columns)).alias("nulls"))
        rows = counts.select("rows", F.explode(F.arrays_zip(types.alias("c"), F.col("nulls").alias("n"))).alias("x"))
        rows = rows.select(F.lit(name).alias("table"), "x.c.position", "x.c.column", "x.c.type", F.col("x.n").alias("nulls"), "rows")
        out = rows if out is None else out.unionByName(rows)
    return out
