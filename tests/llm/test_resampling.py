from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA

from sluice.llm import resampling
from sluice.llm.queries import OP11_SQL, op11_importance_resampling

SF = f"{DATA}/sf0.001"


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def runs_of(text, n=2):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=25, n=2, buckets=10_000, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in runs_of(x, n)) for texts in ([x for _, x in docs], target))
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (ss + buckets) / ((s[k] + 1) * (tt + buckets)))) for k in range(buckets)]
    rows = []
    for d, x in docs:
        g = [gain[bucket(f)] for f in runs_of(x, n)]
        weight = math.floor(sum(g) / len(g)) if g else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((d, len(g), weight, score, len(words_of(x)) >= least and d is not None))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((*r[:4], rank.get(r[0]) if r[4] else None) for r in rows), key=str)


def drawn(spark, docs, target, **more):
    df, to = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string")
    out = resampling.resampled(df, to, **more).select("doc_id", "n_features", "weight", "score", "rank")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_registers_match_zlib(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["", "a", "A b", "x" * 1000 + " y", "é" * 300 + "  É Z9", "-", "one--two three", None, "word " * 500, " ".join("".join(rng.choice(list("abé9Z"), int(rng.integers(1, 90)))) for _ in range(300))]
    for together in (resampling.TOGETHER, 7):
        monkeypatch.setattr(resampling, "TOGETHER", together)
        for n in (1, 2, 4):
            got = Counter((int(r), int(b)) for bucket, row in resampling.hashed_runs(pa.array(texts), n, 1 << 20) for b, r in zip(bucket, row))
            assert got == Counter((i, zlib.crc32(f.encode()) % (1 << 20)) for i, x in enumerate(texts) for f in runs_of(x, n))


def test_odd_rows(spark):
    rng = np.random.default_rng(8)
    words = ["alpha", "Beta", "gamma", "é", "42", "x"]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60))))) for i in range(150)] + [(200, None), (201, ""), (202, " -- "), (203, "word " * 30), (None, "word " * 30), (None, None)]
    target = ["alpha alpha beta", None, "", "é 42 x"]
    assert drawn(spark, docs, target) == brute(docs, target)
    assert drawn(spark, docs, []) == brute(docs, [])
    assert drawn(spark, docs, target, percent=100, words=3, buckets=64, least_words=1) == brute(docs, target, 100, 3, 64, 1)
    assert drawn(spark, docs, target, percent=0) == brute(docs, target, 0)
    assert drawn(spark, [], target) == []


def test_repeated_rows_are_drawn_each(spark):
    text = "some words " * 20
    got = drawn(spark, [(1, text)] * 8 + [(2, text)] * 8, ["some"], percent=50)
    assert sum(r[4] is not None for r in got) == 8 and sorted(r[4] for r in got if r[4]) == list(range(1, 9)) and len({r[0] for r in got if r[4]}) == 1


def test_drawn_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(i, f"text {i} " * 15, "x") for i in range(40)], "doc_id long, text string, `__drawn` string")
    out = resampling.drawn_rows(df, resampling.resampled(df, df))
    assert out.columns == df.columns and out.count() == 10


def test_op11(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    got = sorted((tuple(r) for r in op11_importance_resampling(spark, SF).select(columns).collect()), key=str)
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute([tuple(r) for r in texts], [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert got == want == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({OP11_SQL})").fetchall(), key=str)


@pytest.mark.parametrize("n", [300])
def test_ranks_over_many_scores(spark, n):
    docs = [(i, f"w{i % 7} " * 20) for i in range(n)]
    assert drawn(spark, docs, ["w1 w2"], percent=60) == brute(docs, ["w1 w2"], 60)
