from __future__ import annotations

from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sluice.functions import calendar as C
from sluice.operators import contracts as K


def test_months():
    assert C.add_months("2019-10", 27) == "2022-01" and C.add_months("2019-10", 0) == "2019-10" and C.add_months("2000-02", -50) == "1995-12"
    assert C.context("2020-02", 31) == {"batch_start": "2020-02-01", "batch_end": "2020-03-01", "late_start": "2020-01-01"}
    assert C.context("2021-03") == {"batch_start": "2021-03-01", "batch_end": "2021-04-01", "late_start": "2021-02-22"}
    for bad in ("2021", "202103", "2021-3 ", "21-03", "2021-03-01", "٢٠٢١-1x", ""):
        with pytest.raises(ValueError):
            C.parse_month(bad)


def test_batch_calendar(spark):
    got = rows(C.batch_calendar(spark, "2023-12", "2024-02"))
    assert [r[0] for r in got] == ["2023-12", "2024-01", "2024-02"]
    assert got[2][1:] == (date(2024, 2, 1), date(2024, 3, 1), date(2024, 1, 25))
    with pytest.raises(ValueError):
        C.batch_calendar(spark, "2024-02", "2024-01")


def test_calendar_of_nothing(spark):
    assert rows(C.calendar_of(spark.createDataFrame([], "d date"), "d")) == []
    assert rows(C.calendar_of(spark.createDataFrame([(None,)], "d date"), "d")) == []


def test_arrival(spark):
    days = [date(2023, 12, 24), date(2023, 12, 25), date(2023, 12, 31), date(2024, 1, 1), date(2024, 1, 31), date(2024, 2, 1), None]
    df = spark.createDataFrame([(d, "2024-01") for d in days], "d date, b string").select("d", *C.bounds(F.col("b")))
    assert [r[0] for r in df.select(C.arrival("d")).collect()] == ["rejected", "late", "late", "on_time", "on_time", "rejected", "rejected"]


RIDES = K.Contract("rides", {"id": "bigint", "fare": "double", "at": "timestamp", "note": "string", "paid": "decimal(18,2)"}, frozenset({"id", "fare"}))


def test_widening():
    assert K.conforms("tinyint", "bigint") and K.conforms("bigint", "double") and K.conforms("decimal(10,2)", "double")
    assert not K.conforms("double", "bigint") and not K.conforms("string", "double")
    assert K.conforms("date", "timestamp") and K.conforms("timestamp_ntz", "timestamp") and not K.conforms("timestamp", "date")
    assert K.conforms("void", "string")


def test_drift():
    d = K.drift(RIDES, {"id": "int", "fare": "double", "at": "timestamp_ntz", "paid": "decimal(10,2)", "tip": "double"})
    assert d.added == {"tip": "double"} and d.missing == ["note"] and not d.breaking
    assert d.widened == {"id": ("int", "bigint"), "at": ("timestamp_ntz", "timestamp"), "paid": ("decimal(10,2)", "decimal(18,2)")}
    with pytest.raises(K.BreakingSchema, match="id: required.*fare: string"):
        K.enforce(RIDES, {"fare": "string"})
    with pytest.raises(ValueError):
        K.Contract("x", {"a": "int"}, frozenset({"b"}))


def test_conform(spark):
    df = spark.createDataFrame([(1, 2.5, "x")], "ID int, Fare double, Extra string")
    out, drift = K.conform(df, RIDES)
    assert out.dtypes == [("id", "bigint"), ("fare", "double"), ("at", "timestamp"), ("note", "string"), ("paid", "decimal(18,2)"), ("extra", "string")]
    assert out.collect()[0][:2] == (1, 2.5) and drift.added == {"extra": "string"}
    with pytest.raises(K.BreakingSchema, match="same lower-case name"):
        K.conform(spark.createDataFrame([(1, 2)], "a int, A int"), RIDES)


def test_evolve_union(spark):
    a = spark.createDataFrame([(1, 2)], "k int, n int")
    b = spark.createDataFrame([(3, 4.5, "x")], "k bigint, n double, c string")
    out = K.evolve_union(a, b)
    assert dict(out.dtypes) == {"k": "bigint", "n": "double", "c": "string"}
    assert rows(out) == [(1, 2.0, None), (3, 4.5, "x")]
    with pytest.raises(K.BreakingSchema):
        K.evolve_union(a, spark.createDataFrame([("x",)], "k string"))
