"""The quality classifier against a direct computation: statistics text by text, one least-squares problem, isotonic means by their formula."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import quality as Q

SPACES = "\x20\x09-\x0d"


def plain_statistics(text: str) -> dict[str, float]:
    raw = text.encode()
    words = re.findall(f"[^{SPACES}]+".encode(), raw)
    n, size = len(words), len(raw)
    share = lambda x, of, more=5: x / (of + more)
    kinds = {
        "upper": b"A-Z", "lower": b"a-z", "digit": b"0-9", "point": rb".,;:?'\"\-()", "symbol": rb"!#$%&*@^~_=+<>|/\\\[\]{}`", "space": b" \t-\r", "beyond_ascii": b"\x80-\xff",
    }
    counts = {k: len(re.findall(b"[" + v + b"]", raw)) for k, v in kinds.items()}
    lines = raw.split(b"\n") if raw else []
    if lines and not lines[-1]:
        lines.pop()  # nothing behind the last break
    out = {k: share(v, size, 20) for k, v in counts.items()}
    top = max(Counter(words).values(), default=0)
    return out | {
        "log_words": np.log1p(n), "log_bytes": np.log1p(size), "word_bytes": (size - counts["space"]) / max(n, 1), "distinct_words": len(set(words)) / np.sqrt(max(n, 1)),
        "same_as_previous": share(sum(a == b for a, b in zip(words, words[1:])), n), "top_word": share(max(top - 1, 0), n), "short_words": share(sum(len(w) <= 2 for w in words), n),
        "long_words": share(sum(len(w) >= 14 for w in words), n), "log_lines": np.log1p(raw.count(b"\n") + bool(raw)), "repeated_lines": share(len(lines) - len(set(lines)), raw.count(b"\n") + bool(raw)),
        "ends_in_symbol": share(sum(bool(re.search(b"[" + kinds["symbol"] + b"]$", w)) for w in words), n),
    }


TEXTS = ["", "one", "A b C\nA b C\nA b C", "x! y# z1 99 99 99", "é漢 word, word; WORD.\n\nend\n", "tab\there  two  spaces\n" * 3, "a-very-long-word-of-many-letters " * 20, "\n\n\n", "same same same other", "(brackets) [and] {more} `q` \\ /"]


def test_statistics_text_by_text():
    got = Q.text_statistics(pa.array([*TEXTS, None]))
    for row, text in zip(got, [*TEXTS, ""]):
        want = plain_statistics(text)
        assert set(want) == set(Q.NAMES)
        for name, x in zip(Q.NAMES, row):
            assert x == pytest.approx(want[name], abs=1e-12), (text, name)


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The greatest of the means that end at a place, of the least that begin there."""
    mean = lambda a, b: y[a : b + 1].sum() / n[a : b + 1].sum()
    return np.array([max(min(mean(a, b) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))])


def test_scores_against_a_direct_solution(spark):
    rng = np.random.default_rng(14)
    good = ["the", "of", "reading", "quiet", "Rivers", "and", "stone."]
    bad = ["BUY", "!!!", "$$$", "click", "99", "now!", "click"]
    data = []
    for i in range(240):
        kind = i % 2 if rng.random() > 0.15 else 1 - i % 2  # some labels are wrong
        data.append((i, " ".join(rng.choice(good if i % 2 else bad, int(rng.integers(1, 60)))), int(kind) if i % 5 else None))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, None), (901, "")], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, q) for i, _, q in data] + [(7_000, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.quality_scores(docs, labels).collect()}
    assert len(got) == 242
    flags = {r.doc_id: r for r in docs.select("doc_id", (F.coalesce(Q.fold() == 1, F.lit(False))).alias("held"), (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("calibrate")).collect()}
    train = [(i, t, q) for i, t, q in data if q is not None and not flags[i].held]
    x = Q.text_statistics(pa.array([t for _, t, _ in train]))
    y, of = np.array([q for *_, q in train], float), np.array([flags[i].calibrate for i, *_ in train])
    mean, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-12))
    scale[scale < 1e-5] = 1
    z = Q.features(x, mean, scale)
    # ridge as least squares with a row for each penalised weight
    k = z.shape[1]
    penalty = np.full(k, Q.RIDGE * (~of).sum() / Q.FEATURES)
    penalty[-1] = 1e-9
    weights = np.linalg.lstsq(np.vstack([z[~of], np.diag(np.sqrt(penalty))]), np.concatenate([y[~of], np.zeros(k)]), rcond=None)[0]
    raw = z @ weights
    at = np.searchsorted(np.linspace(-0.5, 1.5, Q.BINS + 1)[1:-1], raw[of])
    bins = np.unique(at)
    n, hits, where = (np.array([f(at == b) for b in bins]) for f in (np.sum, lambda m: y[of][m].sum(), lambda m: raw[of][m].mean()))
    value = isotonic(hits, n)
    every = Q.text_statistics(pa.array([t for _, t, _ in data] + [None, ""]))
    want = np.interp(Q.features(every, mean, scale) @ weights, where, value)
    for i, w in zip([*range(240), 900, 901], want):
        assert got[i].score == pytest.approx(w, abs=1e-4) and got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == flags[i].held
    assert got[900].score == got[901].score


def test_labelled_texts_alone_give_the_same_model(spark, monkeypatch):
    """Statistics of labelled texts, found by their ids, or of all texts, joined: one model."""
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 9)) for i in range(90)] + [(None, "x"), (3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3) for i in range(0, 90, 2)] + [(None, 1), (3, 1), (3, 0)], "doc_id long, quality int")
    models = []
    for most in (Q.MOST_IDS, 0):
        monkeypatch.setattr(Q, "MOST_IDS", most)
        models.append(Q.trained(docs, labels))
    models.append(Q.trained(Q.with_statistics(docs), labels))
    for m in models[1:]:
        assert np.allclose(m.weights, models[0].weights, atol=1e-6) and np.allclose(m.mean, models[0].mean) and np.allclose(m.value, models[0].value, atol=1e-6)


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "good text here", "a", "b", "c", "d")], "doc_id long, text string, score string, `__own_score` string, `a.b` string, predicted string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert [tuple(r) for r in Q.keep_good(df, labels).collect()] == [tuple(r) for r in df.collect()] and Q.keep_good(df, labels).columns == df.columns
