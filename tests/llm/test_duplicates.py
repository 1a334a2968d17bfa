from __future__ import annotations

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import DATA, rows
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import components, decontaminate, minhash, simhash, substrings
from sluice.llm.queries import OP5_SQL, OP6_SQL, op5_substring_dedup, op6_decontamination, op10_simhash_near_dedup

SF = f"{DATA}/sf0.001"


def roots(edges, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2200)] + [(5, 5), (7, 5), (5, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    want = roots(edges, {n for e in edges for n in e})
    assert got == {n: r for n, r in want.items() if n in got} and all(n == r for n, r in want.items() if n not in got)
    assert rows(components.components(df.where("false"))) == []


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []


def fingerprint(text):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_brute(texts):
    """doc_id -> (fingerprint, component) of (doc_id, text)."""
    fps = [(d, fingerprint(t)) for d, t in texts]
    edges = [(a, b) for i, (a, x) in enumerate(fps) for b, y in fps[i + 1 :] if bin(x ^ y).count("1") <= 2 and a is not None and b is not None]
    root = roots(edges, {d for d, _ in fps if d is not None})
    return sorted(((d, f"{f:016x}", root.get(d)) for d, f in fps), key=str)


def near(spark, data, schema="doc_id long, text string"):
    found = simhash.near_groups(spark.createDataFrame(data, schema))
    return sorted((tuple(r) for r in found.select("doc_id", simhash.fingerprint_hex().alias("f"), "component_id").collect()), key=str)


BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def test_near_groups(spark):
    data = [(5, BASE), (3, BASE.upper()), (9, BASE + " sixteen"), (1, None), (2, ""), (4, " \n"), (6, "two words"), (7, "Two\tWords"), (8, "x"), (None, BASE), (10, "é " * 3000 + "end"), (5, "another text here")]
    assert near(spark, data) == near_brute(data)
    assert near(spark, []) == []


@pytest.mark.parametrize("pairwise,spread", [(4096, 200_000), (3, 200_000), (4096, 20)])
def test_chains_and_large_buckets(spark, monkeypatch, pairwise, spread):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    monkeypatch.setattr(simhash, "SPREAD", spread)
    rng = np.random.default_rng(1)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.choice(10, rng.integers(0, 4), False)) for b in rng.integers(0, 2**62, 8) for _ in range(25)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, node long").repartition(3)
    found = components.components(simhash.near_links(nodes))
    got = {r.node: r.root for r in found.collect()}
    want = roots([(i, j) for i, x in enumerate(fps) for j, y in enumerate(fps[i + 1 :], i + 1) if bin(x ^ y).count("1") <= 2], range(len(fps)))
    assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_buckets_over_batches(monkeypatch):
    """A bucket that spans batches, stays or leaves as a whole."""
    monkeypatch.setattr(simhash, "SPREAD", 6)
    key = np.array([1] * 3 + [2] * 12 + [3] * 2, np.int64)
    fp, node = np.arange(17, dtype=np.int64) * 0, np.arange(17, dtype=np.int64)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 5]) for x in (key, fp, node)], ["key", "fp", "node"]) for i in range(0, 17, 5)]
    out = pa.Table.from_batches(list(simhash._links_in_buckets(iter(batches)))).to_pylist()
    assert sorted(r["a"] for r in out if r["b"] is None) == list(range(3, 15))
    assert sorted((r["a"], r["b"]) for r in out if r["b"] is not None) == [(0, 1), (0, 2), (15, 16)]


def test_near_query(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(op10_simhash_near_dedup(spark, SF)) == near_brute(texts)


def jaccard_brute(texts):
    """doc_id -> component over pairs of five-word shingle sets with Jaccard similarity 0.8."""
    words = [(d, re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for d, t in texts if d is not None]
    sets = [(d, {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}) for d, w in words]
    edges = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if 5 * len(x & y) >= 4 * len(x | y)]
    return roots(edges, {d for d, _ in sets})


def edited_copies():
    """Texts with edited copies at any distance, chains of edits, a large group of copies of one text, and odd rows."""
    rng = np.random.default_rng(11)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    data = []
    for _ in range(60):
        words = rng.choice(vocabulary, rng.integers(8, 300))
        for k in range(4):
            data.append(" ".join(words))
            words = words.copy()
            words[rng.choice(len(words), rng.integers(1, 2 + len(words) // 40), False)] = "edit"
    base = rng.choice(vocabulary, 200)
    for k in range(120):
        words = base.copy()
        words[rng.choice(200, rng.integers(0, 5), False)] = rng.choice(vocabulary)
        data.append(" ".join(words))
    data = [(int(i), t) for i, t in zip(rng.permutation(len(data)) + 100, data)]
    return data + [(1, None), (2, ""), (4, " \n"), (6, "two words"), (7, "Two\tWords"), (8, "x"), (None, data[0][1]), (5, data[0][1]), (5, data[9][1]), (9, data[0][1].upper())]


def test_similar_groups(spark):
    data = edited_copies()
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in minhash.similar_groups(df).collect()} == jaccard_brute(data)
    assert rows(minhash.similar_groups(df.where("false"))) == []


def test_near_dedup_stage_finds_edited_copies(spark):
    data = edited_copies()
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, df, SF).collect()]
    assert {d for d in kept if d is not None} == set(jaccard_brute(data).values()) and None in kept


def repeats_brute(data, width):
    words = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in data]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - width + 1):
                k = tuple(w[i : i + width])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1 if d is not None else 0):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def repeats(spark, data, width):
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("packed", F.lit(1)).repartition(4)
    return rows(substrings.without_repeats(df, width).select("doc_id", "n_words", "n_removed", "kept_text"))


@pytest.mark.parametrize("width", [1, 2, 5, 13])
def test_repeats(spark, width):
    rng = np.random.default_rng(width)
    data = [(int(i), " ".join(rng.choice(list("abc"), rng.integers(0, 40)))) for i in range(60)]
    passage = " ".join(f"w{i}" for i in range(30))
    data += [(100, passage), (101, "x " + passage.replace(" ", "\n") + "  y"), (102, passage), (50, passage[3:]), (103, "same " * 700), (104, "same " * 650 + "end")]
    data += [(110, None), (111, ""), (112, " "), (None, passage), (100, passage), (101, "other " + passage), (120, "é漢🎉 " * 20), (121, "é漢🎉\t" * 20), (130, "z" * 100_000)]
    assert repeats(spark, data, width) == repeats_brute(data, width)


def test_repeats_in_small_slices(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE", 300)
    rng = np.random.default_rng(8)
    data = [(int(i), " ".join(rng.choice(list("ab"), 30))) for i in range(80)]
    assert repeats(spark, data, 5) == repeats_brute(data, 5)
    assert repeats(spark, data[:0], 5) == []


@pytest.mark.parametrize("share,group", [(1 / 64, 40), (1e-9, 2 << 20), (1.0, 1), (2.0, 2 << 20)])
def test_repeats_however_windows_are_dealt(spark, monkeypatch, share, group):
    monkeypatch.setattr(substrings, "HOT_SHARE", share)
    monkeypatch.setattr(substrings, "GROUP_WINDOWS", group)
    monkeypatch.setattr(substrings, "SLICE", 2_000)
    rng = np.random.default_rng(12)
    word = np.array([f"w{i}" for i in range(40)] + ["https://www.example.org/licence"] * 8)
    passages = [" ".join(rng.choice(word, 20)) for _ in range(6)]
    data = [(int(i), " ".join(x for _ in range(3) for x in (" ".join(rng.choice(word, 9)), passages[int(rng.integers(6))]))) for i in rng.permutation(90)]
    for width in (1, 4, 13):
        assert repeats(spark, data, width) == repeats_brute(data, width)


def test_windows_are_compared_and_not_their_hashes(spark, monkeypatch):
    """Words that collide in a polynomial modulo 2 ** 64, and windows that all have one hash."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(4_096))
    more = " ".join(f"w{i}" for i in range(12))
    data = [(1, f"{word} {more}"), (2, f"{word.translate({97: 98, 98: 97})} {more}"), (3, f"{word} {more}")]
    assert [r[2] for r in repeats(spark, data, 13)] == [0, 0, 13]
    rng = np.random.default_rng(4)
    words = rng.integers(0, 3, 4_000)
    windows = np.arange(3_990)
    want = {}
    want = [want.setdefault(tuple(words[i : i + 5]), i) for i in windows]
    assert substrings._first_equal(words, windows, 5).tolist() == want
    monkeypatch.setattr(substrings, "range_sums", lambda values, base, first, end: np.zeros(len(first), np.uint64))
    assert substrings._first_equal(words, windows, 5).tolist() == want


def test_a_word_in_every_second_document_gathers_nothing():
    """Windows around one long word in half of all texts are dealt by their other words."""
    rng = np.random.default_rng(6)
    texts = pa.array([" ".join([*rng.choice(5_000, 30).astype(str), *(["https://licence.example.org/long/path/version-2.0"] * (i % 2)), *rng.choice(5_000, 30).astype(str)]) for i in range(2_000)])
    from sluice.llm.common import utf8, word_hashes, words_of

    raw, offsets = utf8(texts)
    starts, ends, _ = words_of(raw, offsets)
    n = np.bincount((word_hashes(raw, starts, ends) >> np.uint64(64 - substrings.BITS)).view(np.int64), minlength=1 << substrings.BITS)
    known = substrings.WordCounts(np.minimum(np.log2(n + 1) * substrings.FINE, 254).astype(np.uint8), np.ones(len(n), np.int64), 255)
    dealt, a, b, *_ = substrings._super_kmers(raw, offsets, 13, known)
    _, windows = np.unique(dealt, return_inverse=True)
    assert np.bincount(windows, b - a - 11).max() < 0.002 * (b - a - 11).sum()


def test_strings_are_looked_at_by_as_much_as_is_cut(monkeypatch):
    """What a worker holds of strings follows the bytes that the caller sets, and the spans do not."""
    sizes, real = [], substrings._of_rows
    monkeypatch.setattr(substrings, "_of_rows", lambda part, held, width: sizes.append(part.nbytes) or real(part, held, width))
    n = 400
    columns = [pa.array(np.arange(n, dtype=np.int32) // 2), pa.array(np.arange(n)), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int32)), pa.array([b"v%d w%d x%d y%d z%d" % ((i // 2,) * 5) for i in range(n)]), pa.nulls(n, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, ["minimiser", "first_doc", "key", "word", "packed", "more"])
    spans = lambda *most: sorted(tuple(r.values()) for b in substrings._found(3, *most)(iter([batch])) for r in b.to_pylist())
    few = spans(2_000)
    assert len(sizes) > 3 and max(sizes) < 4_000
    assert few == spans() == [(i, 0, 0, 5) for i in range(1, n, 2)]


def same_as_sql(spark, query, sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = query(spark, SF)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.select(*names)) == sorted(found.fetchall(), key=str)


def test_queries_against_sql(spark):
    same_as_sql(spark, op5_substring_dedup, OP5_SQL)
    same_as_sql(spark, op6_decontamination, OP6_SQL)


def hits_brute(docs, items, width):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for name, t in items:
        w = split(t)
        if w:
            for k in [tuple(w[i : i + width]) for i in range(len(w) - width + 1)] or [tuple(w)]:
                windows.setdefault(k, set()).add(name if name is None else str(name))
    out = []
    for d, t in docs:
        w = split(t)
        hit, names = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit[i : i + n] = [True] * n
                    names |= windows[k]
        out.append((d, len(w), sum(hit), sorted(names - {None}) + [None] * (None in names)))
    return sorted(out, key=str)


@pytest.mark.parametrize("width,item_bytes", [(1, 4 << 20), (3, 4 << 20), (3, 40), (10, 4 << 20)])
def test_hits(spark, monkeypatch, width, item_bytes):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", item_bytes)
    rng = np.random.default_rng(width)
    items = [(int(i), " ".join(rng.choice(list("ab"), rng.integers(0, 14)))) for i in range(12)] + [(50, "A-b, ç!"), (51, None), (None, "a"), (52, ""), (50, "b b a"), (53, "a")][: 6 if width > 1 else 5]
    docs = [(int(i), " ".join(rng.choice(list("abABz"), rng.integers(0, 40)))) for i in range(60)] + [(70, None), (71, ""), (72, "a.b.Ç!"), (73, "a_B ç"), (None, "a b"), (70, "a b a"), (74, "q" * 50_000)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hit_items", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.with_hits(d, i, width).select("doc_id", "n_words", decontaminate.n_hit().alias("n"), "hit_items")
    assert rows(got) == hits_brute(docs, items, width)
    none = decontaminate.with_hits(d, i.where("false"), width)
    assert none.where(F.size("hit_spans") > 0).count() == 0 and none.count() == len(docs)


def test_cuts_do_not_depend_on_the_bytes_at_a_time(spark):
    items = spark.createDataFrame([(1, "a b c d"), (2, "q r s")], "item_id long, text string")
    docs = [(i, f"x{i} A, b c d y q r s z" + " w" * (i % 7)) for i in range(60)] + [(60, None), (61, "a b c d")]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    few = rows(decontaminate.without_hits(d, items, 3, most=100))
    assert few == rows(decontaminate.without_hits(d, items, 3)) and len(few) == 60 + 1 - sum(7 > 0.5 * (10 + i % 7) for i in range(60))
    spans = lambda **how: rows(substrings.without_repeats(d, 3, **how))
    assert spans(cut=100) == spans()


def test_long_and_repetitive_items(spark):
    """Linear in equal words, small in memory, and matched as short ones are."""
    import time

    from sluice.llm import automaton

    began = time.perf_counter()
    arrays = automaton.built([("same", b"w " * 20_000)], 10)
    assert time.perf_counter() - began < 1
    assert len(automaton.packed(arrays)) < 3_000_000
    began = time.perf_counter()
    found = automaton.Automaton(automaton.packed(arrays)).found(pa.array([b"w"], pa.large_binary()), np.zeros(20_000, np.int64), np.zeros(20_000, np.int64))
    assert time.perf_counter() - began < 1 and len(set(found[0].tolist())) == 20_000 - 9
    rng = np.random.default_rng(2)
    words = np.array([f"v{i}" for i in range(5_000)])
    items = [(i, " ".join(rng.choice(words, 2_000))) for i in range(40)]
    docs = [(i, " ".join(rng.choice(words, 50)) + " " + " ".join(items[i][1].split()[i : i + 300]) + " end") for i in range(40)]
    assert max(len(automaton.packed(automaton.built([(str(n), t.encode())], 10))) / len(t) for n, t in items) < 25
    i, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.with_hits(d, i, 10).select("doc_id", "n_words", decontaminate.n_hit().alias("n"), "hit_items")
    assert rows(got) == hits_brute(docs, items, 10)


def test_hits_are_cut(spark):
    item = "alpha beta gamma delta epsilon"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Keep this, {item.upper()}! And all of that too."), (2, item), (3, None), (4, "clean"), (5, "é (alpha-beta gamma delta) fine words here yes")], "doc_id long, text string").withColumn("n_words", F.lit("own"))
    out = {r.doc_id: (r.text, r.n_words) for r in decontaminate.without_hits(docs, items, 4).collect()}
    assert out == {1: ("Keep this, ! And all of that too.", "own"), 3: (None, "own"), 4: ("clean", "own"), 5: ("é () fine words here yes", "own")}
