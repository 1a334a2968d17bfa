from __future__ import annotations

import hashlib
import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import DATA, rows

from sluice.functions.calendar import batch_calendar
from sluice.operators.contracts import BreakingSchema, Contract
from sluice.operators import observe as O
from sluice.operators import rollups as R
from sluice.operators import serving as S
from sluice.queries import QUERIES
from sluice.sources import files as L
from sluice.sources import snapshots as P


def test_parallel_arrays(spark, tmp_path):
    payload = {"daily": {"time": ["2024-01-01", "2024-01-02"], "hi": [5, None, 7], "lo": [1.5]}}
    (tmp_path / "a.json").write_text(json.dumps(payload))
    schema = "daily struct<time: array<string>, hi: array<double>, lo: array<double>, rain: array<double>>"
    out = L.read_payloads(spark, str(tmp_path / "a.json"), schema, "daily.time", {"daily.hi": "double", "daily.lo": "double", "daily.rain": "double"})
    assert out.columns == ["time", "hi", "lo", "rain"]
    assert rows(out) == [("2024-01-01", 5.0, 1.5, None), ("2024-01-02", None, None, None)]
    (tmp_path / "b.json").write_text(json.dumps({"daily": {}}))
    with pytest.raises(Exception, match="no daily.time"):
        L.read_payloads(spark, str(tmp_path / "b.json"), schema, "daily.time", {"daily.hi": "double"}).collect()


def test_batches_by_name(spark, tmp_path):
    for name, v in (("rides_2024-01.parquet", 1), ("rides_2024-02.parquet", 2), ("other.parquet", 3)):
        spark.createDataFrame([(v,)], "v int").coalesce(1).toPandas().to_parquet(tmp_path / name)
    assert rows(L.read_batches(spark, str(tmp_path)).select("v", "_batch_id")) == [(1, "2024-01"), (2, "2024-02"), (3, None)]


def test_months_of_different_schemas(spark, tmp_path):
    land = lambda month, data, schema, k="": pq_file(spark, data, schema, tmp_path / "landed" / f"trips_{month}{k}.parquet")
    land("2021-01", [(1, 1.5)], "ID int, fare float")
    land("2021-02", [(2, 2.5, "x")], "id bigint, fare double, note string")
    land("2021-02", [(3, 3)], "id int, tip int", ".1")  # two files of a month that do not agree
    land("2021-03", [("y", 4, 4.5, 2.5)], "note string, id bigint, fare double, tip double")
    land("other", [(9, 9.0)], "id int, fare double")
    contract = Contract("trips", {"id": "bigint", "fare": "double"}, frozenset({"id"}))
    out = L.read_batches(spark, str(tmp_path / "landed"), contract)
    assert out.dtypes[:2] == [("id", "bigint"), ("fare", "double")] and dict(out.dtypes)["tip"] == "double" and out.columns[-2:] == ["_batch_id", "_source_file"]
    got = rows(out.select("id", "fare", "note", "tip", "_batch_id", "_source_file"))
    assert got == [
        (1, 1.5, None, None, "2021-01", "trips_2021-01.parquet"), (2, 2.5, "x", None, "2021-02", "trips_2021-02.parquet"), (3, None, None, 3.0, "2021-02", "trips_2021-02.1.parquet"),
        (4, 4.5, "y", 2.5, "2021-03", "trips_2021-03.parquet"), (9, 9.0, None, None, None, "trips_other.parquet"),
    ]
    assert rows(L.read_batches(spark, [str(tmp_path / "landed" / "trips_2021-01.parquet"), str(tmp_path / "landed" / "trips_2021-03.parquet")], contract).select("id", "tip")) == [(1, None), (4, 2.5)]
    land("2021-04", [("z", 1.0)], "id string, fare double")
    land("2021-05", [(1.0,)], "fare double")
    with pytest.raises(BreakingSchema, match="2021-04: id: string.*2021-05: id: required"):
        L.read_batches(spark, str(tmp_path / "landed"), contract)
    with pytest.raises(FileNotFoundError):
        L.read_batches(spark, str(make_dir(tmp_path / "empty")))


def make_dir(path):
    path.mkdir()
    return path


def pq_file(spark, data, schema, path):
    """One Parquet file, as a landing has it."""
    folder = path.parent.parent / f"{path.name}.work"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(folder))
    path.parent.mkdir(exist_ok=True)
    next(folder.glob("part-*")).rename(path)


def test_digests_of_large_files_and_odd_names(spark, tmp_path):
    folder = make_dir(tmp_path / "landed files")
    contents = {"a b%20c.bin": b"x" * 10, "é#?.bin": b"", "plain": b"\x00\xff" * 5_000_000}
    for name, content in contents.items():
        (folder / name).write_bytes(content)
    want = sorted((n, hashlib.sha256(c).hexdigest(), len(c)) for n, c in contents.items())
    assert rows(L.manifest(spark, str(folder))) == want == rows(L.manifest(spark, str(folder), streamed=False))
    recorded = L.land_manifest(spark, str(folder))
    assert rows(recorded) == want and (tmp_path / "landed files.manifest").is_dir()
    with open(folder / "sparse", "wb") as f:
        f.truncate((2 << 30) + 5)  # more than a row holds
    (size, digest), = [(r.bytes, r.sha256) for r in L.manifest(spark, str(folder)).where("name = 'sparse'").collect()]
    whole = hashlib.sha256()
    for n in [1 << 20] * 2048 + [5]:
        whole.update(bytes(n))
    assert (size, digest) == ((2 << 30) + 5, whole.hexdigest())
    assert rows(L.manifest_mismatches(recorded, L.manifest(spark, str(folder)))) == []


def test_lookup_of_several_files(spark, tmp_path):
    (tmp_path / "b.csv").write_text("id,name\n1,late\n")
    (tmp_path / "a.csv").write_text("id,name\n1,early\n2,x\n2,y\n")
    assert rows(P.read_lookup(spark, str(tmp_path), "id int, name string", ["id"])) == [(1, "late"), (2, "y")]


def test_exact_medians_of_large_groups(spark):
    rng = __import__("random").Random(4)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(999)], "heavy": [rng.random() ** -3 for _ in range(1000)], "few": [1.0, 2.0, 5.0], "one": [7.0] * 700, "two": [1.0] * 400 + [2.0] * 400,
        "ties": [float(rng.randrange(4)) for _ in range(901)], "skewed": [0.0] * 500 + [rng.random() for _ in range(501)], "null": [None, None], "some": [None] * 600 + [3.0, 4.0], None: [float(i) for i in range(602)],
    }
    data = [(k, v) for k, x in groups.items() for v in x]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    want = rows(df.groupBy("k").agg(R.F.round(R.F.median("v"), 6).alias("v")))
    for held in (10_000, 100, 1):
        assert rows(R.median_of(df, ["k"], "v", 6, held=held)) == want
    assert rows(R.median_of(df.where("k = 'two'"), [], "v", held=100)) == [(1.5,)] and rows(R.median_of(df.where("false"), ["k"], "v")) == []


def test_manifest(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"one")
    (tmp_path / "y.bin").write_bytes(b"two")
    before = spark.createDataFrame(L.manifest(spark, str(tmp_path)).collect())
    assert rows(before)[0] == ("x.bin", hashlib.sha256(b"one").hexdigest(), 3)
    L.verify_manifest(before, L.manifest(spark, str(tmp_path)))
    (tmp_path / "x.bin").write_bytes(b"1")
    (tmp_path / "y.bin").unlink()
    (tmp_path / "z.bin").write_bytes(b"new")
    assert rows(L.manifest_mismatches(before, L.manifest(spark, str(tmp_path)))) == [("x.bin", "changed"), ("y.bin", "missing")]
    with pytest.raises(L.IntegrityError, match="x.bin: changed; y.bin: missing"):
        L.verify_manifest(before, L.manifest(spark, str(tmp_path)))


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, date(2023, 5, 1)), (2, date(2024, 1, 31)), (3, date(2024, 2, 1)), (4, None)], "k int, d date")
    assert [r[0] for r in rows(P.asof_snapshot(df, "d", "2024-02-01", ["k"]))] == [1, 2]
    got = rows(P.asof_snapshots(df, "d", batch_calendar(spark, "2024-01", "2024-02")).select("_batch_id", "k"))
    assert got == [("2024-01", 1), ("2024-01", 2), ("2024-02", 1), ("2024-02", 2), ("2024-02", 3)]
    (tmp_path / "l.csv").write_text("id,name\n1,a\n2,b\n1,c\n")
    assert rows(P.read_lookup(spark, str(tmp_path / "l.csv"), "id int, name string", ["id"])) == [(1, "c"), (2, "b")]


def test_rollups(spark):
    df = spark.createDataFrame([("a", 1.005, 1), ("a", 2.0, None), (None, 1e30, 2)], "k string, x double, n int")
    fact = R.rollup_fact(df, ["k"], {"x": "x"}, {"n": "n"})
    assert rows(fact) == [("a", 2, Decimal("3.01"), 1), (None, 1, None, 2)]
    zero = spark.createDataFrame([(1, 0)], "a int, b int").select(R.ratio("a", "b")).first()[0]
    assert zero is None
    days = R.date_dimension(spark.createDataFrame([(date(2024, 2, 28),), (date(2024, 3, 2),), (None,)], "d date"), "d")
    assert [r.date_key for r in days.orderBy("date").collect()] == [20240228, 20240229, 20240301, 20240302]
    assert days.where("is_weekend").first().day_of_week == 7
    assert rows(R.date_dimension(spark.createDataFrame([], "d date"), "d")) == []
    top = R.top_k(spark.createDataFrame([("b", 1), ("a", 1), ("c", 5), ("d", None)], "k string, m int"), "k", "m", 2)
    assert [r[0] for r in top.collect()] == ["c", "a"]


def test_scoped_session(spark):
    tables = {"one": lambda s: s.range(3), "two": lambda s: s.range(5)}
    session = S.scoped_session(spark, tables, ["one", "absent"])
    assert S.capped_sql(session, "SELECT * FROM one -- all").count() == 3
    assert S.capped_sql(session, "WITH x AS (SELECT * FROM one) SELECT * FROM x", rows=2).count() == 2
    for bad in ("SELECT * FROM two", "SET a=b", "DROP VIEW one", "SELECT * FROM parquet.`/tmp`", "SELECT 1) AS q; SELECT (2"):
        with pytest.raises(Exception):
            S.capped_sql(session, bad).collect()
    assert (S.clamp(None), S.clamp(0), S.clamp(10**6)) == (1000, 1, 10_000)
    frames = {"one": spark.range(10)}
    assert [r[0] for r in S.browse(frames, ["one"], "one", ["id"], 4, 3).collect()] == [4, 5, 6]
    with pytest.raises(S.NotAllowed):
        S.browse(frames, [], "one", ["id"])


def test_scope_of_the_analysed_plan(spark):
    spark.range(7).createOrReplaceGlobalTempView("secret")
    spark.sql("CREATE TABLE IF NOT EXISTS other USING parquet AS SELECT 1 AS x")
    session = S.scoped_session(spark, {"a": lambda s: s.range(3).selectExpr("id", "id % 2 AS odd"), "b": lambda s: s.range(9)}, ["a"])
    try:
        for bad in (
            "SELECT * FROM global_temp.secret",
            "SELECT * FROM other",
            "SELECT * FROM spark_catalog.default.other",
            "SELECT java_method('java.lang.System', 'getProperty', 'user.name')",
            "SELECT reflect('java.util.UUID', 'randomUUID') FROM a",
            "SELECT id FROM a WHERE id IN (SELECT x FROM other)",
            "SELECT id, (SELECT max(id) FROM global_temp.secret) FROM a",
            "WITH a AS (SELECT * FROM global_temp.secret) SELECT * FROM a",
            "SELECT id FROM a WHERE EXISTS (SELECT 1 FROM global_temp.secret s WHERE s.id = a.id)",
            "SELECT a.id FROM a JOIN LATERAL (SELECT x FROM other WHERE x = a.id) ON true",
            "SELECT count(*) FROM a GROUP BY try_reflect('java.lang.System', 'getProperty', 'user.name')",
        ):
            with pytest.raises(S.NotAllowed):
                S.capped_sql(session, bad)
        for good, n in (
            ("SELECT * FROM a", 3), ("SELECT odd, count(*) AS n, sum(id) OVER () AS s FROM a GROUP BY odd, id", 3), ("WITH x AS (SELECT * FROM a) SELECT x.id, (SELECT max(id) FROM a) AS m FROM x WHERE id IN (SELECT id FROM a)", 3),
            ("SELECT explode(sequence(1, 4)) AS i", 4), ("VALUES (1), (2)", 2), ("SELECT upper('x'), decode(encode('x', 'UTF-8'), 'UTF-8'), current_date(), date_format(now(), 'yyyy')", 1), ("SELECT * FROM a AS t JOIN range(2) r ON t.id = r.id", 2),
            ("SELECT id FROM A UNION ALL SELECT id FROM a", 6),
        ):
            assert S.capped_sql(session, good).count() == n
    finally:
        spark.sql("DROP TABLE other")
        spark.catalog.dropGlobalTempView("secret")


def test_pages_by_continuation(spark):
    data = [(None, None, 1), (None, "x", 2), ("a", None, 3), ("a", "y'z", 4), ("b", "", 5), ("b", "q", 6)]
    df = spark.createDataFrame(data, "k string, l string, v int").repartition(3)
    for size in (1, 2, 4, 6, 9):
        found, token = [], None
        while True:
            rows_, token = S.next_page(df, ["k", "l"], token, size)
            found += [r.v for r in rows_]
            if token is None:
                break
        assert found == [1, 2, 3, 4, 5, 6]
    kinds = spark.createDataFrame([(datetime(2020, 1, 1, 0, 0, 0, i), date(2020, 1, 1), Decimal("12345678901234567.89"), 0.1 * i, i % 2 == 0, i) for i in range(5)], "at timestamp_ntz, d date, x decimal(20,2), f double, o boolean, i long")
    order = ["d", "x", "o", "f", "at", "i"]
    whole = [r.i for r in S.page(kinds, order, 0, 9).collect()]
    for k, r in enumerate(S.page(kinds, order, 0, 9).collect()):
        assert [x.i for x in S.page_after(kinds, order, S.token_of(r, order, kinds), 9).collect()] == whole[k + 1 :]
    for bad in ("x", "e30=", S.token_of({"l": "x"}, ["l"], df)):
        with pytest.raises(ValueError):
            S.page_after(df, ["k", "l"], bad, 3)
    plan = S.page_after(spark.read.parquet(f"{DATA}/sf0.001/orders.parquet"), ["o_orderkey"], S.token_of({"o_orderkey": 900}, ["o_orderkey"], spark.read.parquet(f"{DATA}/sf0.001/orders.parquet")), 5)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderkey,900)" in plan


def run(stage, table, status, n, valid, bad, at, run_id):
    return (stage, table, "b", status, n, valid, bad, valid, 2.0, at, run_id)


def test_gauges_and_freshness(spark):
    t = [datetime(2024, 1, 1, h) for h in range(4)]
    data = [run("silver", "x", "success", 10, 8, 2, t[0], "a"), run("silver", "x", "failed", 5, None, None, t[1], "b"), run("gold", None, "success", 0, 0, 0, t[2], "c"), run("gold", None, "failed", None, None, None, t[3], "d"), run("ref", "y", "success", 10, 8, 2, t[0], "e")]
    runs = spark.createDataFrame(data, O.RUNS)
    got = {(r.metric, r.stage, r.table): r.value for r in O.run_gauges(runs).collect()}
    assert got["failed", "silver", "x"] == 1 and ("last_success_seconds", "silver", "x") not in got
    assert got["pass_ratio", "ref", "y"] == 0.8 and got["failed", "gold", "all"] == 1
    assert ("pass_ratio", "silver", "x") not in got and got["rows_in", "silver", "x"] == 5
    line = O.exposition(O.run_gauges(runs), "lake").where("value LIKE 'lake_pass%'").first()[0]
    assert line == 'lake_pass_ratio{stage="ref",table="y",batch="b"} 0.8'
    now = datetime(2024, 1, 1, 8)
    assert tuple(O.freshness(runs, now, 26).first()) == (6 * 3600, False)
    assert tuple(O.freshness(runs, now, 5).first()) == (6 * 3600, True)
    assert tuple(O.freshness(runs.where("false"), now, 26).first()) == (None, True)
    assert rows(O.freshness_lines(O.freshness(runs, now, 26), "lake")) == [('lake_freshness_seconds{stage="gold"} 21600.0',), ('lake_slo_breached{stage="gold"} 0.0',)]
    assert rows(O.freshness_lines(O.freshness(runs.where("false"), now, 26), "lake")) == [('lake_slo_breached{stage="gold"} 1.0',)]


def test_lineage_and_columns(spark):
    rec = spark.createDataFrame([("s", "t", "b", 1, ["x"], ["o"]), ("s", "t", "b", 2, ["z", "y"], ["o"])], "stage string, table string, batch_id string, n int, inputs array<string>, outputs array<string>")
    last = O.lineage_latest(rec, "n")
    assert last.first().inputs == ["y", "z"]
    assert rows(O.lineage_edges(last)) == [("y", "t"), ("z", "t")]
    cols = O.table_columns({"t": spark.createDataFrame([(1, None), (2, "x")], "a int, b string")})
    assert rows(cols) == [("t", 0, "a", "int", 0, 2), ("t", 1, "b", "string", 1, 2)]


def test_malformed_run_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"stage": "gold", "status": "success", "duration_s": 1.5}')
    (tmp_path / "b.json").write_text("{not json")
    assert [r.stage for r in O.read_runs(spark, str(tmp_path)).collect()] == ["gold"]




def test_month_snapshots_do_not_need_orders_in_their_months(spark, tmp_path):
    rows_ = [(1, datetime(1999, 5, 1)), (2, datetime(2000, 3, 31, 23)), (3, datetime(2001, 8, 1))]
    spark.createDataFrame(rows_, "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    got = rows(QUERIES["asof_snapshots_by_month"](spark, str(tmp_path)).select("_batch_id", "orders", "last_key"))
    months = [f"{y}-{m:02d}" for y in (1999, 2000, 2001) for m in range(1, 13)][4:32]  # of the first to the last order
    assert got == [(m, 1, 1) if m < "2000-03" else (m, 2, 2) if m < "2001-08" else (m, 3, 3) for m in months]
