"""Every query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from conftest import DATA

from sluice.queries import ORACLES, QUERIES

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    assert got
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())


def test_entry_works_alone():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
