from __future__ import annotations

import re

import duckdb
import numpy as np
import pytest
from conftest import DATA

from sluice.llm import minhash
from sluice.llm.queries import OP12_SQL, op12_minhash_near_dedup

SF = f"{DATA}/sf0.001"


def shingles(text, n=3):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def brute(docs, n=3, percent=85):
    sets = [(d, shingles(t, n)) for d, t in docs]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted(((d, len(s), find(d) if d is not None else None) for d, s in sets), key=str)


def groups(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((tuple(r) for r in minhash.near_groups(df, **more).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited(rng, words, n):
    words = list(words)
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"e{rng.integers(1 << 40)}"
    return words


def test_tables():
    for percent in (50, 80, 85, 99):
        m, s = minhash.n_tables(percent), (percent / 100) ** minhash.ROWS
        assert 2 * (1 - s) ** m <= minhash.MISSED < 2 * (1 - s) ** (m - 1)
    assert minhash.n_tables(100) == 1


def test_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    docs = [
        (9, base), (4, base.upper()), (7, base + " tail"), (1, None), (2, ""), (3, " \n\t"), (11, "two words"), (12, "Two\tWords"), (13, "one"), (14, "one"), (None, base), (None, None),
        (20, "another text " * 30), (20, base), (21, "another text " * 30), (22, "é " * 5000 + "end"), (23, "é " * 5000 + "end"), (9, base), (15, None), (16, "words two"),
    ]
    got = groups(spark, docs)
    assert got == brute(docs)
    assert [r[2] for r in got if r[0] in (1, 2, 3, 15)] == [1, 15, 2, 3] and {r[2] for r in got if r[0] in (4, 7, 9, 20, 21)} == {4}
    assert groups(spark, []) == []


def test_bounds_are_exact(spark):
    """Pairs just at 85 per cent link, those just below don't."""
    docs = []
    for k, (common, only) in enumerate([(85, 15), (84, 15), (170, 30), (169, 30), (17, 3), (16, 3)]):
        words = [f"t{k}x{i}" for i in range(common + 2)]
        docs += [(10 * k, " ".join(words)), (10 * k + 1, " ".join([*words, *(f"m{k}x{i}" for i in range(only))]))]
    got = groups(spark, docs)
    assert got == brute(docs)
    assert [len({r[2] for r in got if r[0] // 10 == k}) for k in range(6)] == [1, 2, 1, 2, 1, 2]


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80), (2, 60)])
def test_random_groups(spark, n, percent):
    rng = np.random.default_rng(n)
    docs = []
    for g in range(25):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(20, 120)))]
        docs += [(len(docs) + i, " ".join(edited(rng, base, int(rng.integers(0, max(2, len(base) // 12)))))) for i in range(8)]
    ids = rng.permutation(len(docs)).tolist()
    docs = [(ids[d], t) for d, t in docs]
    assert groups(spark, docs, shingle=n, percent=percent) == brute(docs, n, percent)


def test_a_chain_and_a_large_group(spark):
    rng = np.random.default_rng(2)
    words = [f"c{i}" for i in range(100)]
    chain = [(1000 + k, " ".join([*(f"n{i}" for i in range(k)), *words[k:]])) for k in range(0, 60, 3)]
    base = [f"b{i}" for i in range(150)]
    around = [(i, " ".join(edited(rng, base, 6))) for i in range(120)]  # near the middle, hardly near each other
    docs = [*chain, *around, (500, " ".join(base))]
    assert groups(spark, docs) == brute(docs)


def test_texts_of_a_template_make_no_pairs(spark):
    """Many texts that share most of their shingles, but not enough: no pair of them is formed by the prefixes."""
    core = [f"core{i}" for i in range(90)]
    docs = [(i, " ".join([*core, *(f"own{i}x{k}" for k in range(28))])) for i in range(500)]
    assert groups(spark, docs) == sorted([(i, 116, i) for i in range(500)], key=str)
    sets = spark.createDataFrame([(i, i, [*range(90), *range(1000 + 28 * i, 1028 + 28 * i)]) for i in range(500)], "node long, root long, shingles array<long>")
    assert [x.count() for x in minhash.prefix_links(sets, 85)] == [0, 0]


@pytest.mark.parametrize("crowd,outsiders", [(0, 7), (0, 1000), (5, 3), (1000, 10)])
def test_prefixes_find_every_link(spark, monkeypatch, crowd, outsiders):
    """Whatever is compared in tasks or as rows: all links between roots are there, and links that leave the tasks are right."""
    monkeypatch.setattr(minhash, "CROWD", crowd)
    monkeypatch.setattr(minhash, "OUTSIDERS", outsiders)
    rng = np.random.default_rng(9)
    near = [(i, i if i % 3 else 0, sorted({*range(100), *rng.integers(1000, 1 << 40, int(rng.integers(2, 9))).tolist()} - {*rng.integers(0, 100, 2).tolist()})) for i in range(60)]
    near += [(100 + i, 100 + i, sorted(rng.integers(1 << 41, 1 << 42, 30).tolist())) for i in range(5)]
    pairs, links = ({tuple(r) for r in x.collect()} for x in minhash.prefix_links(spark.createDataFrame(near, "node long, root long, shingles array<long>"), 85))
    want = {(a, b) for a, r, x in near for b, q, y in near if a < b and r != q and 100 * len({*x} & {*y}) >= 85 * len({*x} | {*y})}
    assert len(want) > 20 and links <= want <= pairs | links and (crowd or not pairs)


def test_op12(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted(tuple(r) for r in op12_minhash_near_dedup(spark, SF).select(columns).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({OP12_SQL})").fetchall())
    assert sum(not r[3] for r in got) > 5


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 1, "x", 2), (2, "a b c", 1, "y", 3)], "doc_id long, text string, node long, `a.b` string, n int")
    assert sorted(tuple(r) for r in minhash.near_groups(df).collect()) == [(1, 1, 1), (2, 1, 1)]
