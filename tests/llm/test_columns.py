"""Operators that pass other columns through keep those named as their own helpers."""

from __future__ import annotations

import duckdb
import pytest
from conftest import DATA, rows

from sluice.llm import decontaminate, substrings
from sluice.llm.queries import RULES_SQL, url_rules

NAMES = ["a.b", "`q`", "__word", "__at", "__maybe", "__spans", "__bit", "__bits", "__row_key", "__doc_id", "__own_score", "__own_n_words", "__c0", "__c3", "node", "key", "hit_items", "n_hit", "code", "block"]
PASSAGE = " ".join(f"p{i}" for i in range(14))


def documents(spark):
    data = [(i, f"{PASSAGE} own{i}", *[f"{n}{i}" for n in NAMES]) for i in range(4)] + [(None, None, *NAMES)]
    return spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)).repartition(2)


@pytest.mark.parametrize("op", ["repeats", "hits", "cut"])
def test_columns_stay(spark, op):
    docs = documents(spark)
    items = spark.createDataFrame([(1, " ".join(PASSAGE.split()[:11]))], "item_id long, text string")
    if op == "repeats":
        out = substrings.without_repeats(docs, 13)
        assert sorted(r.n_removed for r in out.collect()) == [0, 0, 14, 14, 14] and out.columns == [*docs.columns, "n_words", "n_removed", "kept_text"]
    elif op == "hits":
        out = decontaminate.with_hits(docs.drop("hit_items"), items, 10)
        docs = docs.drop("hit_items")
        assert [len(r.hit_spans) for r in out.where("doc_id is not null").collect()] == [1] * 4
    else:
        out = decontaminate.without_hits(docs, items, 10, most_share=1.0)
        assert out.columns == docs.columns and {r.text for r in out.where("doc_id = 2").collect()} == {" p11 p12 p13 own2"}
    kept = [c for c in docs.columns if c not in ("text",)]
    q = lambda c: "`" + c.replace("`", "``") + "`"
    assert rows(out.select(*map(q, kept))) == rows(docs.select(*map(q, kept)))


def test_url_rules(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/sf0.001/pages.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    got = sorted((tuple(r) for r in url_rules(spark, f"{DATA}/sf0.001").select(columns).collect()), key=str)
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({RULES_SQL})").fetchall(), key=str) and len({r[3] for r in got}) > 3
