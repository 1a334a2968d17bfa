from __future__ import annotations

import corpus_pipeline as P
from conftest import DATA
from pyspark.sql import functions as F
from test_duplicates import jaccard_brute

from sluice.llm import decontaminate, minhash, quality
from sluice.llm.common import written

SF = f"{DATA}/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    after = {}
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), "test")
        after[name] = docs
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns and docs.where("n_chars != length(text)").count() == 0
    good, near, cut, clean, ids = after.values()
    full = spark.read.parquet(f"{SF}/documents.parquet")
    scores = quality.quality_scores(full, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scores.where("predicted = 1").collect()}
    assert {r.doc_id for r in near.collect()} == set(jaccard_brute([(r.doc_id, r.text) for r in good.collect()]).values())
    words = lambda df: {r.doc_id: r.text.split() for r in df.collect()}
    before, left, first = words(near), words(cut), set()
    for d in sorted(before):
        w = before[d]
        windows = [tuple(w[i : i + P.PASSAGE_WORDS]) for i in range(len(w) - P.PASSAGE_WORDS + 1)]
        gone = {j for i, k in enumerate(windows) if k in first for j in range(i, i + P.PASSAGE_WORDS)}
        assert left[d] == [x for j, x in enumerate(w) if j not in gone]
        assert gone or dict(cut.where(F.col("doc_id") == d).select("doc_id", "text").collect())[d] == texts[d]
        first |= set(windows)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hits = decontaminate.with_hits(cut, bench, 10).withColumn("n", decontaminate.n_hit())
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in hits.where("n <= 0.5 * n_words").collect()}
    untouched = hits.where("n = 0").select("doc_id", "text")
    assert untouched.exceptAll(clean.select("doc_id", "text")).count() == 0
    assert ids.count() == clean.count() and ids.where("NOT (parity AND round_trip)").count() == 0


def test_run_equals_the_stages(spark):
    once = P.run(spark, SF)
    assert once.columns == ["doc_id", "ids", "n_tokens", "parity", "round_trip"] and once.count() > 100


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns named as those of the operators."""
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(6).collect()]
    data = [(1, good[0]), (1, good[0]), (1, good[0]), (2, good[1]), (2, good[2]), (None, good[3]), (None, good[3]), (3, None), (4, ""), (5, None), (None, None), (6, good[4] + "\n" + " ".join(f"{w}{i}" for i in range(3_000) for w in good[5].split()[:30])), (7, "z" * 300_000)]
    names = ["score", "stats", "n_words", "n_removed", "kept_text", "hit_items", "hit_spans", "ids", "parity", "component_id", "__row_key", "key", "a.b", "__word", "__at", "__maybe", "__spans", "__bit", "__own_score", "__own_n_words", "__c0", "node", "`q`"]
    rows = [(i, t, "en", "s", len(t or ""), *[f"own{i}"] * len(names)) for i, t in data]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names)).repartition(3), names


def test_odd_rows_pass_every_stage(spark):
    docs, names = odd_rows(spark)
    before = [r.doc_id for r in docs.collect()]
    for name, stage in P.STAGES[:-1]:
        after = written(stage(spark, docs, SF), "test")
        assert after.columns == docs.columns
        assert all(r[n] == f"own{r.doc_id}" for r in after.collect() for n in names)
        docs = after
        left = [r.doc_id for r in docs.collect()]
        if name == "SimHash near-dedup":
            assert len({d for d in left if d is not None}) == sum(d is not None for d in left)
            assert left.count(None) == before.count(None)
        before = left
    ids = P.STAGES[-1][1](spark, docs, SF)
    assert sorted((r.doc_id for r in ids.collect()), key=str) == sorted(before, key=str) and ids.where("NOT (parity AND round_trip)").count() == 0


def test_each_stage_takes_odd_rows(spark):
    docs, _ = odd_rows(spark)
    n = docs.count()
    kept = {name: stage(spark, docs, SF).count() for name, stage in P.STAGES}
    # ids 1, 2, one of 3 to 5, 6, 7 and the three without an id
    assert kept["SimHash near-dedup"] == 8 and kept["substring dedup"] == n and kept["SentencePiece encoding and decoding"] == n
    assert 1 <= kept["quality classifier"] <= n and kept["benchmark decontamination"] <= n


def test_near_dedup_goes_by_fingerprints(spark, monkeypatch):
    """Near copies go without any bucket of minima, which only serve pairs that fingerprints leave apart; a pair of fingerprints below the bound stays."""
    rest = [" ".join(f"{w}{k}x{i}" for w in ("one", "two", "three") for i in range(100)) for k in range(3)]
    common = " ".join(["it is all the same to me"] * 200)
    data = [(3, rest[0]), (5, rest[1]), (4, rest[0]), (6, rest[0] + " end"), (8, None), (9, ""), (10, common + " here"), (11, common + " " + rest[2])]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in data], "doc_id long, text string, n_chars long")
    whole = {r.doc_id for r in P.near_dedup_stage(spark, docs, SF).collect()}
    groups = {r.doc_id: r.component_id for r in P.simhash.near_groups(docs, P.SHINGLE).collect()}
    assert groups[6] == 3 and groups[11] == 10
    keys = minhash.table_keys
    monkeypatch.setattr(minhash, "table_keys", lambda *a: keys(*a).where("false"))
    assert {r.doc_id for r in P.near_dedup_stage(spark, docs, SF).collect()} == whole == {3, 5, 8, 10, 11}


def test_run_leaves_one_table(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    P.run(spark, SF)
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["stage"]
