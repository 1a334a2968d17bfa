from __future__ import annotations

from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sluice.functions.calendar import batch_calendar, context
from sluice.jobs import layers as J
from sluice.operators.contracts import BreakingSchema, Contract
from sluice.operators.keys import row_id
from sluice.operators.observe import latest_runs, read_runs
from sluice.operators.rollups import rollup_fact
from sluice.operators.rules import Rule
from sluice.sources.files import read_evolved, write_batches

RIDES = Contract("rides", {"id": "bigint", "at": "timestamp_ntz", "zone": "bigint", "fare": "double"}, frozenset({"id", "at", "fare"}))
ROW_RULES = [
    Rule("fare_range", "range", "fare", "fare below 0", {"min": 0}),
    Rule("in_window", "expression", None, "outside", {"expr": "at >= '{late_start}' AND at < '{batch_end}'"}),
]
KEYS, LATEST = ["ride_id", "day"], ["_batch_id", "fare"]


def project():
    return {"ride_id": row_id("id", "at"), "day": F.to_date("at"), "id": F.col("id"), "fare": F.col("fare"), "_batch_id": F.col("_batch_id")}


def rides(spark, batch, data):
    df = spark.createDataFrame([(i, datetime.fromisoformat(a), z, f) for i, a, z, f in data], "ID int, at timestamp_ntz, zone long, fare double")
    return J.bronze(df, RIDES, "rides", "2024-03-01 00:00:00", batch)


# May has a ride twice over with another fare, one without an id, two without a zone, a tip-only fare, a ride of the first late day and one a day earlier, and one of June.
MAY = [(5, "2023-05-01T00:00:00", 4, 12.5), (5, "2023-05-01T00:00:00", 4, 13.5), (None, "2023-05-20T07:30:00", 4, 8.0), (6, "2023-05-31T23:59:59", None, 3.25), (7, "2023-05-12T12:00:00", None, 4.0),
       (8, "2023-05-12T12:00:00", 4, -0.01), (9, "2023-04-24T00:00:00", 4, 6.0), (10, "2023-04-23T23:59:59", 4, 6.0), (11, "2023-06-01T00:00:00", 4, 6.0), (12, "2023-05-05T05:00:00", 9, -2.0)]
# June brings zone 9, mends ride 5 and ride 9 too late, and has a late ride of zone 9; July has nothing that is valid.
JUNE = [(5, "2023-05-01T00:00:00", 4, 99.0), (12, "2023-05-28T05:00:00", 9, 2.0), (13, "2023-06-30T10:00:00", 9, 7.0), (14, "2023-06-15T10:00:00", 31, 8.0), (6, "2023-05-31T23:59:59", 4, 3.5)]
JULY = [(15, "2023-08-01T00:00:00", 4, 1.0), (16, "2023-07-02T00:00:00", 77, 1.0)]
# zones and the batch that brings them; 31 comes last, 77 never
ZONES = [(4, "2023-05"), (9, "2023-06"), (9, "2023-07"), (31, "2023-07")]
MONTHS = {"2023-05": MAY, "2023-06": JUNE, "2023-07": JULY}


def test_bronze(spark):
    df = rides(spark, "2023-05", MAY)
    assert df.columns == ["id", "at", "zone", "fare", "_source", "_ingested_at", "_batch_id"]
    with pytest.raises(BreakingSchema):
        J.bronze(spark.createDataFrame([(1, "x")], "id int, fare string"), RIDES, "rides", "2024-01-01 00:00:00", "2024-01")


def zone_rule():
    return Rule("zone_exists", "referential", "zone", "unknown zone", {"ref_table": "zones", "ref_column": "k"})


def test_one_batch(spark):
    zones = spark.createDataFrame([(4,)], "k long")
    out = J.silver(rides(spark, "2023-05", MAY), [*ROW_RULES, zone_rule()], project(), KEYS, LATEST, context=context("2023-05"), refs={"zones": zones})
    assert out.validated.check_conserved() == (10, 6, 4)
    got = {r.id: r.fare for r in out.table.collect()}
    assert got == {5: 13.5, None: 8.0, 6: 3.25, 7: 4.0, 9: 6.0}  # the dearer of two; a null id is an id
    assert sorted(r._reasons for r in out.validated.quarantine.collect()) == ["fare_range: fare below 0", "fare_range: fare below 0; zone_exists: unknown zone", "in_window: outside", "in_window: outside"]


def loop(spark, data):
    """Batch after batch, each merged into what is there."""
    table = None
    for batch, rows_ in data:
        known = spark.createDataFrame([(z,) for z, first in ZONES if first <= batch], "k long")
        table = J.silver(rides(spark, batch, rows_), [*ROW_RULES, zone_rule()], project(), KEYS, LATEST, context=context(batch), refs={"zones": known}, target=table, update_when="s._batch_id >= t._batch_id").table
    return table


def all_rides(spark):
    out = None
    for batch, data in MONTHS.items():
        part = rides(spark, batch, data)
        out = part if out is None else out.unionByName(part)
    return out


def test_backfill_equals_the_loop(spark):
    zones = spark.createDataFrame(ZONES, "k long, _batch_id string")
    out = J.backfill(all_rides(spark), ROW_RULES, batch_calendar(spark, "2023-05", "2023-07"), project(), KEYS, LATEST, refs={"zone": ("zones", zones, "k")})
    data = list(MONTHS.items())
    want = rows(loop(spark, data).select(*out.table.columns))
    assert rows(out.table) == want and sorted((r.id, r.fare) for r in out.table.where("id is not null").collect()) == [(5, 13.5), (6, 3.5), (7, 4.0), (9, 6.0), (12, 2.0), (13, 7.0)]
    assert out.validated.check_conserved() == (17, 9, 8)
    assert "__zones_batch" not in out.validated.quarantine.first()._record
    assert rows(loop(spark, [*data, data[1], data[2]]).select(*out.table.columns)) == want


def test_gold_refresh_is_idempotent(spark):
    silver = J.silver(rides(spark, "2023-05", MAY), ROW_RULES, project(), KEYS, LATEST, context=context("2023-05")).table
    fact = lambda df: rollup_fact(df, ["day"], {"fare": "fare"}, {})
    build = lambda s, old: {"gold": J.gold_refresh(old and old["gold"], s, "day", "2023-04-24", "2023-06-01", fact)}
    assert [r[-1] for r in rows(J.same_after_rerun(build, silver))] == [True]
    old = build(silver, None)["gold"].unionByName(spark.createDataFrame([(datetime(2023, 5, 6), 9), (datetime(2022, 5, 5), 9)], "day date, rows long"), allowMissingColumns=True)
    days = sorted(str(r.day) for r in J.gold_refresh(old, silver, "day", "2023-04-24", "2023-06-01", fact).collect())
    assert days == ["2022-05-05", "2023-04-24", "2023-05-01", "2023-05-12", "2023-05-20", "2023-05-31"]


# On disk: silver, quarantine, dimensions and run records.


def zone_rows(spark):
    data = [*((z, b, "rides", "2024-01-01") for z, b in ZONES), (None, "2023-05", "rides", "2024-01-01"), (-1, "2023-06", "rides", "2024-01-01")]
    return spark.createDataFrame(data, "k long, _batch_id string, _source string, _ingested_at string")


def build(spark, root, ranges, rides_=None):
    zone = Rule("zone_positive", "range", "k", "zone below 0", {"min": 0})
    zones = J.Dimension("zones", zone_rows(spark), "k", "zone", {"k": F.col("k"), "_batch_id": F.col("_batch_id")}, ["k"], ["_batch_id"], [zone])
    summarise = lambda r: rollup_fact(r, ["day"], {"fare": "fare"}, {}, rows="rides")
    for first, last in ranges:
        J.backfill_range(root, all_rides(spark) if rides_ is None else rides_, first, last, ROW_RULES, project(), KEYS, LATEST, "day", "s._batch_id >= t._batch_id", summarise, dimensions=[zones])
    found = {t: rows(spark.read.parquet(f"{root}/{t}").select(*c)) for t, c in {
        "silver": ["ride_id", "id", "day", "fare", "_batch_id"], "gold": ["day", "rides", "fare"], "zones": ["k", "_batch_id"], "zones_known": ["k", "_batch_id"],
        "silver_quarantine": ["_batch_id", "_failed_rules", "_reasons", "_record"], "zones_quarantine": ["_batch_id", "_reasons"],
    }.items()}
    runs = latest_runs(read_runs(spark, f"{root}/runs"))
    return found | {"runs": rows(runs.select("table", "batch_id", "status", "rows_in", "rows_valid", "rows_quarantined", "rows_out"))}


def test_tables_on_disk_equal_month_by_month(spark, tmp_path):
    root = f"file://{tmp_path}"
    once = build(spark, f"{root}/once", [("2023-05", "2023-07")])
    assert once == build(spark, f"{root}/months", [(m, m) for m in MONTHS]) == build(spark, f"{root}/once", [("2023-05", "2023-07")]) == build(spark, f"{root}/months", [("2023-06", "2023-07"), ("2023-05", "2023-05")])
    assert rows(loop(spark, MONTHS.items()).select("ride_id", "id", "day", "fare", "_batch_id")) == once["silver"]
    assert once["zones"] == [(31, "2023-07"), (4, "2023-05"), (9, "2023-07"), (None, "2023-05")] and once["zones_known"] == [(31, "2023-07"), (4, "2023-05"), (9, "2023-06")]
    assert once["zones_quarantine"] == [("2023-06", "zone_positive: zone below 0")]
    assert [r[0] for r in once["silver_quarantine"]].count("2023-05") == 4 and all('"id":' in r[3] or r[3].startswith('{"at"') for r in once["silver_quarantine"])
    facts = {r[1]: r[3:] for r in once["runs"] if r[0] == "silver"}
    assert facts == {"2023-05": (10, 6, 4, 6), "2023-06": (5, 3, 2, 3), "2023-07": (2, 0, 2, 0)}
    assert not [x for x in (tmp_path / "once").iterdir() if "flagged" in x.name or "staged" in x.name]


def test_a_batch_that_is_mended_or_emptied(spark, tmp_path):
    root = f"file://{tmp_path}/lake"
    build(spark, root, [("2023-05", "2023-07")])
    mended = rides(spark, "2023-05", [r for r in MAY if r[0] not in (8, 10)]).unionByName(rides(spark, "2023-06", JUNE))
    found = build(spark, root, [("2023-05", "2023-05"), ("2023-07", "2023-07")], mended)
    bad = [r[0] for r in found["silver_quarantine"]]
    assert (bad.count("2023-05"), bad.count("2023-06"), bad.count("2023-07")) == (2, 2, 0)  # July has no rows any more


def test_nothing_is_published_unless_rows_are_conserved(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/lake"
    real = J.RunRecord.split

    def losing(self, flagged):
        return real(self, flagged).where("fare > 5")

    monkeypatch.setattr(J.RunRecord, "split", losing)
    with pytest.raises(AssertionError, match="not conserved"):
        J.build_silver(root, J.validate_batches(rides(spark, "2023-05", MAY), ROW_RULES, batch_calendar(spark, "2023-05", "2023-05")), project(), KEYS, LATEST, "day", "true")
    assert [x.name for x in (tmp_path / "lake").iterdir()] == ["runs"]
    assert [(r.status, r.table) for r in read_runs(spark, f"{root}/runs").collect()] == [("failed", "silver")]


def names_and_times(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("part-*")}


def test_bronze_on_disk(spark, tmp_path):
    landed, table = tmp_path / "landed", tmp_path / "bronze"
    at = datetime(2023, 5, 2)
    write_batches(spark.createDataFrame([(1, at, 2.5, "2023-05")], "ID int, at timestamp_ntz, fare float, m string"), f"file://{landed}", "m", "rides")
    write_batches(spark.createDataFrame([(2, at, 4, 3.5, 7, "2023-06")], "id long, at timestamp_ntz, zone int, fare double, tip int, m string"), f"file://{landed}", "m", "rides")
    write_batches(spark.createDataFrame([(3, at, 4, 3.5, 7.25, "2023-07")], "id long, at timestamp_ntz, zone long, fare double, tip double, m string"), f"file://{landed}", "m", "rides")
    load = lambda path: J.load_bronze(spark, f"file://{path}", f"file://{table}", RIDES, "rides", "2024-01-01 00:00:00")
    assert load(landed) == ["2023-05", "2023-06", "2023-07"]
    read = lambda: read_evolved(spark, f"file://{table}")
    assert dict(read().dtypes) == {"id": "bigint", "at": "timestamp_ntz", "zone": "bigint", "fare": "double", "_source": "string", "_ingested_at": "timestamp_ntz", "tip": "double", "_batch_id": "string"}
    want = [(1, None, 2.5, None, "2023-05"), (2, 4, 3.5, 7.0, "2023-06"), (3, 4, 3.5, 7.25, "2023-07")]
    assert rows(read().select("id", "zone", "fare", "tip", "_batch_id")) == want
    before = names_and_times(table)
    again = tmp_path / "again"
    write_batches(spark.createDataFrame([(2, at, "5", "2023-06"), (8, at, "6", "2023-06")], "id int, at timestamp_ntz, fare string, m string"), f"file://{again}", "m", "rides")
    with pytest.raises(BreakingSchema, match="2023-06: fare: string"):
        load(again)
    assert names_and_times(table) == before
    again = tmp_path / "right"
    write_batches(spark.createDataFrame([(2, at, 5.0, "2023-06"), (8, at, 6.0, "2023-06")], "id int, at timestamp_ntz, fare double, m string"), f"file://{again}", "m", "rides")
    assert load(again) == ["2023-06"]
    assert rows(read().select("id", "zone", "fare", "tip", "_batch_id")) == [want[0], (2, None, 5.0, None, "2023-06"), want[2], (8, None, 6.0, None, "2023-06")]
    after = names_and_times(table)
    assert {p: t for p, t in after.items() if "2023-06" not in str(p)} == {p: t for p, t in before.items() if "2023-06" not in str(p)}
    worse = tmp_path / "worse"
    write_batches(spark.createDataFrame([(9, at, 1.0, "much", "2023-08")], "id int, at timestamp_ntz, fare double, tip string, m string"), f"file://{worse}", "m", "rides")
    with pytest.raises(BreakingSchema, match="tip is string"):
        load(worse)
    assert names_and_times(table) == after


def test_null_keys_and_partitions_are_merged_once(spark, tmp_path):
    """A null in a key is a key like others: a re-run adds no row, in memory and on disk."""
    from sluice.operators.tables import upsert_partitions

    schema = "id long, day date, v int, _batch_id string"
    new = spark.createDataFrame([(None, datetime(2024, 1, 1), 1, "2024-01"), (1, None, 2, "2024-01"), (None, None, 3, "2024-01"), (2, datetime(2024, 1, 2), 4, "2024-01")], schema)
    same = {c: F.col(c) for c in new.columns}
    merge = lambda old: J.silver(new, [], same, ["id", "day"], ["_batch_id", "v"], target=old, update_when="s._batch_id >= t._batch_id").table
    once = merge(new)
    assert rows(once) == rows(merge(once)) == rows(new)
    path = f"file://{tmp_path}/silver"
    for _ in range(3):
        upsert_partitions(new, path, ["id", "day"], "day", "s._batch_id >= t._batch_id")
        assert rows(spark.read.parquet(path).select(new.columns)) == rows(new)
    upsert_partitions(new.where("id = 2").withColumn("v", F.lit(9)), path, ["id", "day"], "day")
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 2, 3, 9]


def test_partitions_come_back_when_a_rename_fails(spark, tmp_path, monkeypatch):
    from sluice.operators import tables as T

    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a b/c=d"), (2, "e"), (3, "f")], "v int, p string")
    T.publish(df, path, ["p"])
    T.publish_partitions(df.where("v < 3").withColumn("v", F.col("v") * 10), path, "p", df.select("p").where("v < 3"))
    assert rows(spark.read.parquet(path)) == [(10, "a b/c=d"), (20, "e"), (3, "f")] and not [x for x in tmp_path.iterdir() if x.name != "t"]
    real = T._fs

    class Failing:
        def __init__(self, fs):
            self.fs, self.n = fs, 0

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, a, b):
            self.n += 1
            return self.n != 4 and self.fs.rename(a, b)

    def broken(session, place):
        fs, p = real(session, place)
        return Failing(fs), p

    monkeypatch.setattr(T, "_fs", broken)
    with pytest.raises(OSError):
        T.publish_partitions(df.withColumn("v", F.lit(0)), path, "p", df.select("p"))
    assert rows(spark.read.parquet(path)) == [(10, "a b/c=d"), (20, "e"), (3, "f")] and not [x for x in tmp_path.iterdir() if x.name != "t"]


def test_range_backfill_equals_batch_after_batch(spark, tmp_path):
    data = {
        "2024-01": [(1, "2024-01-02", 1, 5.0), (2, "2024-01-31", 1, 6.0), (3, "2023-12-28", 1, 7.0), (4, "2023-11-01", 1, 8.0)],
        "2024-02": [(2, "2024-01-31", 1, 9.0), (5, "2024-02-03", 2, 1.0), (6, "2024-01-26", 2, -1.0), (7, "2024-01-27", 2, 2.0)],
        "2024-03": [(8, "2024-03-01", 1, 3.0), (9, "2024-02-27", 1, 4.0)],
        "2024-04": [(10, "2024-04-01", 1, 5.0)],
    }
    landed = None
    for batch, found in data.items():
        part = rides(spark, batch, found)
        landed = part if landed is None else landed.unionByName(part)
    summarise = lambda r: rollup_fact(r, ["day"], {"fare": "fare"}, {}, rows="rides")

    def run(name, *ranges):
        for first, last, *stages in ranges:
            J.backfill_range(f"file://{tmp_path}/{name}", landed, first, last, ROW_RULES, project(), KEYS, LATEST, "day", "s._batch_id >= t._batch_id", summarise, *stages)
        return [rows(spark.read.parquet(f"file://{tmp_path}/{name}/{t}").select(*c)) for t, c in (("silver", ["id", "day", "fare", "_batch_id"]), ("gold", ["day", "rides", "fare"]))]

    once = run("once", ("2024-01", "2024-03"))
    assert once == run("months", *((m, m) for m in ("2024-01", "2024-02", "2024-03"))) == run("once", ("2024-01", "2024-03"))
    assert once == run("stages", ("2024-01", "2024-02", ["silver"]), ("2024-03", "2024-03", ["silver"]), ("2024-01", "2024-03", ["gold"]))
    assert [r[0] for r in once[0]] == [1, 2, 3, 5, 7, 8, 9] and [r[3] for r in once[0] if r[0] == 2] == ["2024-02"]
    with pytest.raises(ValueError):
        run("none", ("2024-03", "2024-01"))


def test_replaced_files(spark, tmp_path):
    """Files without a matching row keep name and time; a table that isn't there is made; partitions with odd names; a failed rename brings all back."""
    from sluice.operators import tables as T

    path = f"file://{tmp_path}/t"
    df = spark.range(0, 400, 1, 8).selectExpr("id", "id div 50 AS day", "1 AS v")
    T.replace_files(df.where("day < 3"), path, "day < 3", order=["day"])
    assert rows(spark.read.parquet(path)) == rows(df.where("day < 3"))
    df.where("day >= 3").repartitionByRange(5, "day").write.mode("append").parquet(path)
    before = names_and_times(tmp_path / "t")
    old = spark.read.parquet(path).where("day = 4")
    T.replace_files(old.where("id % 2 = 0").withColumn("v", F.lit(2)), path, "day = 4", order=["day"])
    want = rows(df.where("day <> 4 OR id % 2 = 0").withColumn("v", F.when(F.col("day") == 4, 2).otherwise(1)))
    assert rows(spark.read.parquet(path)) == want
    after = names_and_times(tmp_path / "t")
    assert len(before) - len(set(before.items()) & set(after.items())) == 1 and not [x for x in tmp_path.iterdir() if x.name != "t"]
    T.replace_files(df.where("false"), path, "day = 4")
    T.replace_files(df.where("false"), path, "day = 99")
    assert rows(spark.read.parquet(path)) == [r for r in want if r[1] != 4]
    with pytest.raises(Exception, match="does not match"):
        T.replace_files(df.where("day = 5"), path, "day = 6")
    assert rows(spark.read.parquet(path)) == [r for r in want if r[1] != 4]
    parts = f"file://{tmp_path}/p"
    named = spark.createDataFrame([(1, "a b/c=d%20", 1), (2, "a b/c=d%20", 5), (3, "é:x", 1), (4, None, 1)], "id int, p string, v int")
    T.publish(named, parts, ["p"])
    T.replace_files(named.where("v < 3").withColumn("id", F.col("id") * 10), parts, "v < 3", partition_by=["p"])
    assert rows(spark.read.parquet(parts).select("id", "p", "v")) == rows(spark.createDataFrame([(10, "a b/c=d%20", 1), (2, "a b/c=d%20", 5), (30, "é:x", 1), (40, None, 1)], "id int, p string, v int"))


def test_replaced_files_come_back(spark, tmp_path, monkeypatch):
    from sluice.operators import tables as T

    path = f"file://{tmp_path}/t"
    df = spark.range(0, 90, 1, 3).selectExpr("id", "id div 30 AS day")
    df.write.parquet(path)
    before, real = names_and_times(tmp_path / "t"), T._moves
    from contextlib import contextmanager

    @contextmanager
    def failing(fs):
        with real(fs) as move:
            n = 0

            def some(a, b):
                nonlocal n
                n += 1
                if n == 3:
                    raise OSError("no more")
                move(a, b)

            yield some

    monkeypatch.setattr(T, "_moves", failing)
    with pytest.raises(OSError):
        T.replace_files(df.where("day < 2"), path, "day < 2")
    assert names_and_times(tmp_path / "t") == before and rows(spark.read.parquet(path)) == rows(df)


def test_records_are_made_behind_the_shuffle(spark, tmp_path):
    """What goes through the shuffle of a quarantine is the row, not its JSON record beside it; the quarantine is the same."""
    from sluice.jobs.layers import META, publish_quarantine
    from sluice.operators.rules import validate
    from sluice.operators.tables import publish_partitions

    seen = []
    rows = spark.createDataFrame([(i, f"2024-0{i % 3 + 1}", "s", "t") for i in range(30)], "id long, _batch_id string, _source string, _ingested_at string")
    checked = validate(rows, [Rule("small", "range", "id", "too large", {"max": 9})], keep=META)
    publish_partitions(checked.quarantine, f"{tmp_path}/plain", "_batch_id", rows.select("_batch_id"))
    publish_quarantine(checked, f"{tmp_path}/dealt", rows.select("_batch_id"))
    found = [sorted(map(str, spark.read.parquet(f"{tmp_path}/{t}").collect())) for t in ("plain", "dealt")]
    assert found[0] == found[1] and len(found[0]) == 20
    publish_partitions(rows, f"{tmp_path}/made", "_batch_id", rows.select("_batch_id"), lambda dealt: seen.append(dealt) or dealt.withColumn("record", F.to_json(F.struct("id"))))
    plan = seen[0].withColumn("record", F.to_json(F.struct("id")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("record") < plan.index("RebalancePartitions")


def test_flags_cost_no_lambda_and_verdicts_choose_files(spark, tmp_path):
    """Flagging interprets nothing row by row, and of flagged rows on disk only those of the wanted verdict are read."""
    checked = J.validate_batches(rides(spark, "2023-05", MAY), ROW_RULES, batch_calendar(spark, "2023-05", "2023-05"))
    assert "lambda" not in checked.flagged._jdf.queryExecution().optimizedPlan().toString()
    with J.recorded(spark, f"{tmp_path}/runs", "silver", "all", "t") as run:
        found = J.staged(checked, f"{tmp_path}/flagged", run)
    assert found.check_conserved() == (10, 6, 4) and rows(found.valid) == rows(checked.valid) and rows(found.quarantine) == rows(checked.quarantine)
    files = lambda df: {f.split("/")[-2] for f in df.inputFiles()}
    assert files(found.flagged) == {"__verdict=false", "__verdict=true"}
    for part, wanted in ((found.valid, "__verdict#"), (found.quarantine, "NOT __verdict#")):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert f"PartitionFilters: [isnotnull(__verdict#" in plan and wanted in plan.partition("PartitionFilters: ")[2].partition("], PushedFilters")[0]
