"""Bronze, silver and gold: load with a contract, validate and merge, summarise a window; one batch or many at once."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.calendar import LATE_DAYS, batch_calendar, context
from sluice.operators.contracts import BreakingSchema, Contract, conform, conforms
from sluice.operators.keys import fingerprint_diff, fingerprints, latest_per_key
from sluice.operators.observe import RunRecord, recorded
from sluice.operators.rollups import window_of
from sluice.operators.rules import Rule, Validated, validate
from sluice.operators.tables import exists, merge_upsert, publish, publish_partitions, remove, replace_files, replace_where, upsert_partitions
from sluice.sources.files import list_files, month_of, read_batches, table_groups

META = ("_batch_id", "_source", "_ingested_at")


def bronze(df: DataFrame, contract: Contract, source: str, ingested_at: str, batch: str | Column | None = None) -> DataFrame:
    """df by its contract, stamped with batch, source and load time.

    batch: one id, a column, or None where the rows have _batch_id already.
    """
    out, _ = conform(df, contract)
    stamps = {"_source": F.lit(source), "_ingested_at": F.to_timestamp_ntz(F.lit(ingested_at))}
    if batch is not None:
        stamps["_batch_id"] = F.lit(batch) if isinstance(batch, str) else batch
    return out.withColumns(stamps)


def load_bronze(spark: SparkSession, files: str | Sequence[str], path: str, contract: Contract, source: str, ingested_at: str) -> list[str]:
    """Landed month files as partitions (_batch_id) of the bronze table at path; the months that were loaded.

    Months may differ in their columns (sources.files.read_batches). A month that is loaded
    again replaces its own partition alone; the files of others stay as they are. A column
    that is new to the table is added to the months that have it; one whose type has no
    common type with the table's is an error, as is a file without a month or a month that breaks
    the contract: both before anything is written. Read the table with sources.files.read_evolved.
    """
    names = {f: month_of(f) for f in list_files(spark, files)}
    if nameless := [f for f, month in names.items() if month is None]:
        raise ValueError(f"no month in the name of {nameless[0]}")
    rows = bronze(read_batches(spark, files, contract).drop("_source_file"), contract, source, ingested_at)
    months = sorted(set(names.values()))
    if exists(spark, path):
        others = [g for g in table_groups(spark, path) if not {n.partition("=")[2] for n in g.names} <= set(months)]
        for column, kind in rows.dtypes:
            for old, g in ((g.types[column], g) for g in others if column in g.types):
                if not (conforms(kind, old) or conforms(old, kind)):
                    raise BreakingSchema(f"{contract.name}: {column} is {kind}, but {old} in {g.names[0]}")
    publish_partitions(rows, path, "_batch_id", spark.createDataFrame([(m,) for m in months], "_batch_id string"))
    return months


@dataclass
class Silver:
    table: DataFrame
    validated: Validated


def silver(
    rows: DataFrame,
    rules: Sequence[Rule],
    project: Mapping[str, Column],
    keys: Sequence[str],
    latest: Sequence[str],
    *,
    calendar: DataFrame | None = None,
    context: Mapping[str, str] | None = None,
    refs: Mapping[str, DataFrame] | None = None,
    target: DataFrame | None = None,
    update_when: str | None = None,
) -> Silver:
    """Bronze rows as silver: valid rows projected, one for each key, and merged into the target.

    With a calendar the rows of all its batches go at once. latest begins with
    _batch_id, so that the later batch wins as it does batch by batch. Both sides are
    read once. A null in a key is a key like others: re-runs change nothing. For a table
    on disk leave out the target and give the result to tables.upsert_partitions, which
    reads and writes only what the new rows touch.
    """
    checked = validate(rows, rules, context=context, calendar=calendar, batch="_batch_id" if calendar is not None else None, refs=refs, keep=META)
    new = latest_per_key(checked.valid.select(*(c.alias(n) for n, c in project.items())), keys, latest)
    if target is None:
        return Silver(new, checked)
    return Silver(merge_upsert(target, new, keys, update_when, checked=True), checked)


def gold_refresh(target: DataFrame | None, silver_rows: DataFrame, day: str, start: str, end: str, summarise) -> DataFrame:
    """The target with the days start <= day < end made anew from silver rows by `summarise`; the same however often it runs."""
    new = summarise(window_of(silver_rows, day, start, end))
    return replace_where(target, new, f"{day} >= DATE'{start}' AND {day} < DATE'{end}'")


def refs_by_batch(ref: DataFrame, key: str, first_batch: str) -> DataFrame:
    """(key, first_batch): the first batch that has each key, from which on it is known."""
    return ref.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(first_batch).alias("__first_batch"))


def backfill(
    rows: DataFrame,
    rules: Sequence[Rule],
    calendar: DataFrame,
    project: Mapping[str, Column],
    keys: Sequence[str],
    latest: Sequence[str],
    refs: Mapping[str, tuple[str, DataFrame, str]] | None = None,
) -> Silver:
    """All batches of a calendar at once, with the rows that batch after batch would give.

    refs: row column -> (name, reference, its key), whose rows have the _batch_id that
    brought them. A value is unknown in batches before its first, as it would be if
    the batches ran in order; that becomes an expression rule on the joined batch.
    """
    checked = validate_batches(rows, rules, calendar, refs)
    return Silver(latest_per_key(_projected(checked, project), keys, latest), checked)


def validate_batches(rows: DataFrame, rules: Sequence[Rule], calendar: DataFrame, refs: Mapping[str, tuple[str, DataFrame, str]] | None = None) -> Validated:
    """The rows of all batches of a calendar, flagged; refs as in backfill."""
    rules, columns = list(rules), rows.columns
    for column, (name, ref, key) in (refs or {}).items():
        first = refs_by_batch(ref, key, "_batch_id").select(F.col(key).alias(f"__{name}"), F.col("__first_batch").alias(f"__{name}_batch"))
        rows = rows.join(first, rows[column] == F.col(f"__{name}"), "left").drop(f"__{name}")
        rules.append(Rule(f"{name}_exists", "expression", column, f"unknown {column}", {"expr": f"{column} IS NULL OR coalesce(__{name}_batch <= _batch_id, false)"}))
    checked = validate(rows, rules, calendar=calendar, batch="_batch_id", keep=META)
    return Validated(checked.flagged, columns, META)


def _projected(checked: Validated, project: Mapping[str, Column]) -> DataFrame:
    return checked.valid.select(*(c.alias(n) for n, c in project.items()))


# The same on disk, under a root: <table>, partitioned; <table>_quarantine, by batch; runs.


def staged(checked: Validated, path: str, run: RunRecord) -> Validated:
    """The flagged rows written once to path, by verdict, and read again from there: no rule runs twice, and who wants valid rows reads these alone.

    They are soon removed, so they have Spark's usual codec, which takes less time than that of tables.

    Counts of the write itself and of what was written must agree, in all and by batch; else
    it is an error, and nothing has been published.
    """
    spark = checked.flagged.sparkSession
    verdict = checked.good  # a boolean, which Spark sorts by without comparing texts
    run.split(checked.flagged).withColumn("__verdict", verdict).write.partitionBy("__verdict").parquet(path)
    back = spark.read.schema(checked.flagged.withColumn("__verdict", verdict).schema).parquet(path)
    good = F.col("__verdict")
    counts = back.groupBy("_batch_id").agg(F.count("*").alias("rows_in"), F.count_if(good).alias("rows_valid"), F.count_if(~good).alias("rows_quarantined"), F.count_if(good == (F.size("_failed_rules") > 0)).alias("mixed")).collect()
    names = ("rows_in", "rows_valid", "rows_quarantined", "mixed")
    seen = {c: run.seen["split"].get.get(c, 0) for c in names}
    total = {c: sum(r[c] for r in counts) for c in names}
    if total != seen or total["rows_in"] != total["rows_valid"] + total["rows_quarantined"]:
        raise AssertionError(f"rows are not conserved: {seen} were checked, {total} written")
    run.by_batch({"batch_id": r._batch_id, "rows_in": r.rows_in, "rows_valid": r.rows_valid, "rows_quarantined": r.rows_quarantined, "rows_out": r.rows_valid} for r in counts)
    return Validated(back, checked.columns, checked.keep, "__verdict")


def publish_quarantine(checked: Validated, path: str, touched: DataFrame) -> None:
    """The quarantine of the touched batches replaced; flagged rows are shuffled, and their records made behind that."""
    record = lambda rows: Validated(rows, checked.columns, checked.keep).quarantine
    bad = checked.flagged.where(~checked.good).select(*checked.columns, "_failed_rules", "_reasons")
    publish_partitions(bad, path, "_batch_id", touched, record)


def build_silver(root: str, checked: Validated, project: Mapping[str, Column], keys: Sequence[str], latest: Sequence[str], partition: str, update_when: str, batches: DataFrame | None = None, table: str = "silver") -> None:
    """Flagged rows of some batches as the table and its quarantine on disk, with a run record for each batch.

    Valid rows are merged into the partitions that they touch; the quarantine of each batch
    that has rows, and of each of `batches` (a frame with _batch_id), is replaced, by nothing
    if it has none now. So a re-run changes neither. A record says rows_in, rows_valid, rows_quarantined, and as
    rows_out what went on to be merged; a failed run leaves one too, and changes no table
    unless it failed between the two swaps, after which running it again mends it.
    """
    spark = checked.flagged.sparkSession
    work = f"{root}/{table}.flagged-{uuid.uuid4().hex}"
    try:
        with recorded(spark, f"{root}/runs", "silver", "all", table) as run:
            found = staged(checked, work, run)
            upsert_partitions(latest_per_key(_projected(found, project), keys, latest), f"{root}/{table}", keys, partition, update_when)
            touched = found.flagged.select("_batch_id")
            touched = touched.unionByName(batches.select("_batch_id")) if batches else touched
            publish_quarantine(found, f"{root}/{table}_quarantine", touched)
    finally:
        remove(spark, work)


@dataclass(frozen=True)
class Dimension:
    """A reference table that arrives in batches: bronze rows with _batch_id, its own rules, its silver columns and keys.

    key is the column of `rows` that the column `column` of the facts must be found in.
    """

    name: str
    rows: DataFrame
    key: str
    column: str
    project: Mapping[str, Column]
    keys: Sequence[str]
    latest: Sequence[str]
    rules: Sequence[Rule] = ()

    def known(self, root: str) -> str:
        """The path of (key, _batch_id): the batch from which on a key is known."""
        return f"{root}/{self.name}_known"


def build_dimension(root: str, dim: Dimension, calendar: DataFrame, update_when: str = "s._batch_id >= t._batch_id") -> None:
    """The dimension's rows of a calendar's batches merged into root/<name>, and its keys into the table of what is known from when; bad rows are quarantined."""
    spark = dim.rows.sparkSession
    wanted = dim.rows.join(F.broadcast(calendar.select("_batch_id")), "_batch_id", "left_semi")  # a row for each month
    checked = validate_batches(wanted, dim.rules, calendar)
    work = f"{root}/{dim.name}.flagged-{uuid.uuid4().hex}"
    try:
        with recorded(spark, f"{root}/runs", "silver", "all", dim.name) as run:
            found = staged(checked, work, run)
            new = latest_per_key(_projected(found, dim.project), dim.keys, dim.latest)
            path = f"{root}/{dim.name}"
            publish(merge_upsert(spark.read.parquet(path), new, dim.keys, update_when, checked=True) if exists(spark, path) else new, path)
            first = found.valid.select(dim.key, "_batch_id")
            first = first.unionByName(spark.read.schema(first.schema).parquet(dim.known(root))) if exists(spark, dim.known(root)) else first
            publish(first.where(F.col(dim.key).isNotNull()).groupBy(dim.key).agg(F.min("_batch_id").alias("_batch_id")), dim.known(root))
            publish_quarantine(found, f"{root}/{dim.name}_quarantine", calendar.select("_batch_id").unionByName(found.flagged.select("_batch_id")))
    finally:
        remove(spark, work)


def build_tables(
    root: str,
    rows: DataFrame,
    rules: Sequence[Rule],
    calendar: DataFrame,
    project: Mapping[str, Column],
    keys: Sequence[str],
    latest: Sequence[str],
    partition: str,
    update_when: str,
    window: tuple[str, str],
    summarise,
    stages: Sequence[str] = ("silver", "gold"),
    dimensions: Sequence[Dimension] = (),
    batches: DataFrame | None = None,
    day: str | None = None,
) -> None:
    """Dimensions, silver, its quarantine and gold on disk under root, from bronze rows of a range of batches.

    Silver is merged by its partitions, the batches' quarantine replaced; of gold the days
    of the window are made anew, in those of its files that have any. A fact is valid if the
    dimensions know its values in its batch: so they are built first, whatever is
    valid from which batch on is a table, and all batches go at once.
    stages: which of them to build; gold alone reads the silver that is there.
    batches: the batches of the run (_batch_id), where some may have no row any more.
    day: the column of gold's days, where silver is partitioned by another (a key's own: its month).
    """
    spark = rows.sparkSession
    if "silver" in stages:
        for dim in dimensions:
            build_dimension(root, dim, calendar)
        refs = {d.column: (d.name, spark.read.parquet(d.known(root)), d.key) for d in dimensions}
        build_silver(root, validate_batches(rows, rules, calendar, refs), project, keys, latest, partition, update_when, batches)
    if "gold" in stages:
        (start, end), day = window, day or partition
        new = summarise(window_of(spark.read.parquet(f"{root}/silver"), day, start, end))
        replace_files(new, f"{root}/gold", f"{day} >= DATE'{start}' AND {day} < DATE'{end}'", order=[day])


def backfill_range(
    root: str,
    rows: DataFrame,
    first: str,
    last: str,
    rules: Sequence[Rule],
    project: Mapping[str, Column],
    keys: Sequence[str],
    latest: Sequence[str],
    partition: str,
    update_when: str,
    summarise,
    stages: Sequence[str] = ("silver", "gold"),
    late_days: int = LATE_DAYS,
    dimensions: Sequence[Dimension] = (),
    day: str | None = None,
) -> None:
    """The batches from first to last through the chosen stages, all at once; rows of other batches stay out.

    Gold days are made anew from the late window of the first batch to the end of the
    last, as the batches one after the other would. A dimension's key counts from its first
    batch on, in this range or one that ran before. Running it again changes nothing.
    """
    calendar = batch_calendar(rows.sparkSession, first, last, late_days)
    window = context(first, late_days)["late_start"], context(last, late_days)["batch_end"]
    wanted = rows.where(F.col("_batch_id").between(first, last))
    build_tables(root, wanted, rules, calendar, project, keys, latest, partition, update_when, window, summarise, stages, dimensions, calendar, day)


def same_after_rerun(build, *inputs: DataFrame) -> DataFrame:
    """fingerprint_diff of the tables (by name) that build(*inputs) makes, and makes again with its own as before."""
    once = build(*inputs, None)
    again = build(*inputs, once)
    return fingerprint_diff(fingerprints(once), fingerprints(again))


def same_on_disk(build, tables: Mapping[str, str], spark: SparkSession) -> DataFrame:
    """fingerprint_diff of tables (name -> path) after build() has run once and twice."""
    found = []
    for _ in range(2):
        build()
        state = fingerprints({name: spark.read.parquet(path) for name, path in tables.items()})
        found.append(spark.createDataFrame(state.collect(), state.schema))  # a row for each table, as it is now
    return fingerprint_diff(*found)
