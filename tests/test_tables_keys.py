from __future__ import annotations

import hashlib
from decimal import Decimal as D

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sluice.operators import keys as K
from sluice.operators import tables as T


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_row_id(spark):
    got = frame(spark, [(1, None, "x")], "a long, b string, c string").select(K.row_id("a", "b", "c")).first()[0]
    assert got == hashlib.sha256(b"1|~|x").hexdigest()


def test_latest_per_key(spark):
    df = frame(spark, [(1, "b", 1, None), (1, "b", 2, 5), (1, "a", 9, 9), (None, "a", 1, 1), (None, None, 7, 7), (2, None, 1, 1), (2, None, 1, 1)], "k long, t string, v int, w int")
    assert rows(K.latest_per_key(df, ["k"], ["t"])) == [(1, "b", 2, 5), (2, None, 1, 1), (None, "a", 1, 1)]
    assert K.latest_per_key(df, ["k"], ["t"]).columns == df.columns
    assert rows(K.first_per_key(df.dropDuplicates(), ["k"], [F.col("v")])) == [(1, "b", 1, None), (2, None, 1, 1), (None, "a", 1, 1)]


def test_fingerprint(spark):
    df = frame(spark, [(1, "a"), (2, None)], "k long, s string")
    same = df.repartition(3).orderBy(F.desc("k"))
    assert rows(K.fingerprint(df)) == rows(K.fingerprint(same))
    swapped = frame(spark, [("x", None)], "a string, b string"), frame(spark, [(None, "x")], "a string, b string")
    assert rows(K.fingerprint(swapped[0])) != rows(K.fingerprint(swapped[1]))
    assert rows(K.fingerprint(swapped[0], strict=False)) == rows(K.fingerprint(swapped[1], strict=False))
    assert K.fingerprint(df.where("k > 9")).first()[0] == 0
    diff = K.fingerprint_diff(K.fingerprints({"t": df, "u": df}), K.fingerprints({"t": same, "v": df}))
    assert rows(diff) == [("t", 2, 2, True), ("u", 2, None, False), ("v", None, 2, False)]


def test_replace_where(spark):
    old = frame(spark, [(1, 1), (5, 1), (None, 1)], "k int, v int")
    new = frame(spark, [(5, 2, "x"), (6, 2, "y")], "k int, v int, c string")
    out = T.replace_where(old, new, "k >= 5")
    assert rows(out) == [(1, 1, None), (5, 2, "x"), (6, 2, "y"), (None, 1, None)]
    assert rows(T.replace_where(out, new, "k >= 5")) == rows(out)
    for target in (old, None):
        with pytest.raises(Exception, match="does not match"):
            T.replace_where(target, frame(spark, [(1, 2)], "k int, v int"), "k >= 5").collect()


def test_merge(spark):
    t = frame(spark, [(1, "a", 3), (2, "b", 3), (3, "c", 3)], "k int, s string, b int")
    s = frame(spark, [(2, "B", 4, 9), (3, "C", 2, 9), (4, "D", None, 9)], "k int, s string, b int, x int")
    assert rows(T.merge_upsert(t, s, ["k"], "s.b >= t.b")) == [(1, "a", 3, None), (2, "B", 4, 9), (3, "c", 3, None), (4, "D", None, 9)]
    gone = T.merge_upsert(t, s, ["k"], delete_unmatched_where="t.b = 3")
    assert [r[0] for r in rows(gone)] == [2, 3, 4]
    once = T.merge_upsert(t, s, ["k"], "s.b >= t.b")
    assert rows(T.merge_upsert(once, s, ["k"], "s.b >= t.b")) == rows(once)
    with pytest.raises(T.MergeError, match="2 times"):
        T.merge_upsert(t, s.union(s), ["k"])
    with pytest.raises(T.MergeError, match="null"):
        T.merge_upsert(t, frame(spark, [(None, "x", 1)], "k int, s string, b int"), ["k"])


def test_publish(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = frame(spark, [(1, "2024-01-01"), (2, "2024-01-02"), (3, None)], "v int, d string").withColumn("d", F.to_date("d"))
    T.publish(df, path, ["d"])
    T.publish(spark.read.parquet(path).where("v < 3"), path, ["d"])  # reads what it replaces
    assert [r[0] for r in rows(spark.read.parquet(path).select("v"))] == [1, 2]
    touched = df.select("d").where("v <= 2")
    T.publish_partitions(df.where("v = 1").withColumn("v", F.lit(7)), path, "d", touched)
    assert [r[0] for r in rows(spark.read.parquet(path).select("v"))] == [7]  # the other touched day went
    with pytest.raises(ValueError, match="outside"):
        T.publish_partitions(df, path, "d", touched)
    assert [r[0] for r in rows(spark.read.parquet(path).select("v"))] == [7]


def test_totals_median_and_dimension_of_odd_rows(spark):
    from sluice.operators.rollups import dimension, median_of, totals

    df = spark.createDataFrame([("a", 3.0, 1.0, 1), ("a", 5.0, 3.0, 2), (None, 1.0, 0.0, None), ("b", None, None, 7)], "g string, x double, y double, k int")
    df = df.withColumn("x", F.col("x").cast("decimal(18,2)"))
    found = totals(df, ["x"], ["g"], shares={"share": ("x", "y", 10)})
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("a", 2, D("8.00"), 20.0), (None, 1, D("1.00"), None), ("b", 1, None, None)]))
    assert [tuple(r) for r in totals(df, ["x"], rows="n").collect()] == [(4, D("9.00"))]
    assert [tuple(r) for r in totals(df.limit(0), ["x"]).collect()] == [(0, None)] and not totals(df.limit(0), ["x"], ["g"]).count()
    assert {r.g: r.y for r in median_of(df, ["g"], "y").collect()} == {"a": 2.0, None: 0.0, "b": None}
    names = spark.createDataFrame([(1, "one"), (2, "two")], "id int, name string")
    assert sorted(map(str, map(tuple, dimension(df, {"key": "k", "of": "name"}, (names, "k", "id")).collect()))) == sorted(map(str, [(1, "one"), (2, "two"), (None, None), (7, None)]))
