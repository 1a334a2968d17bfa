"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Every text becomes a short vector of statistics. Cosines of random projections of
it approximate a Gaussian kernel. Each task adds up its rows' share of the normal
equations, whose size is fixed; their sum is solved once. Scores of labelled rows
that the solution has not seen are calibrated by pooling adjacent violators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import add_columns, plain_names, scratch, summed, utf8, words_of, word_hashes, written

#: Random features, their seed, ridge penalty per row, and bins of the calibration.
FEATURES, SEED, RIDGE, BINS = 256, 20, 1e-3, 512
#: Bytes of text that are looked at at a time.
SLICE = 1 << 20

_KIND = np.zeros(256, np.int64)  # 0 other
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = 2
_KIND[list(b"0123456789")] = 3
_KIND[list(b".,;:?'\"-()")] = 4
_KIND[list(b"!#$%&*@^~_=+<>|/\\[]{}`")] = 5
_KIND[[0x20, *range(0x09, 0x0E)]] = 6
_KIND[128:] = 7
NAMES = (
    "log_words", "log_bytes", "word_bytes", "upper", "lower", "digit", "point", "symbol", "space", "beyond_ascii",
    "distinct_words", "same_as_previous", "top_word", "short_words", "long_words", "log_lines", "repeated_lines", "ends_in_symbol",
)


def _share(n: np.ndarray, of: np.ndarray, more: int = 5) -> np.ndarray:
    """n of `of` and a few more, so that one capital or symbol in a few words says little."""
    return n / (of + more)


def text_statistics(column: pa.Array) -> np.ndarray:
    """A row of NAMES for each text; an empty or null text has zeros."""
    raw, offsets = utf8(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 8 + _KIND[raw], minlength=8 * n).reshape(n, 8)
    starts, ends, of = words_of(raw, offsets)
    words = np.bincount(of, minlength=n)
    length = ends - starts
    h = word_hashes(raw, starts, ends)
    order = np.lexsort((h, of))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of[order][new], np.diff(np.flatnonzero(new), append=len(h)))
    same = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=n)
    short = np.bincount(of[length <= 2], minlength=n)
    long = np.bincount(of[length >= 14], minlength=n)
    ends_in_symbol = np.bincount(of[_KIND[raw[ends - 1]] == 5], minlength=n)
    breaks = raw == 10
    lines = np.bincount(row[breaks], minlength=n) + (size > 0)
    text = np.zeros(len(raw) + 1, np.int64)  # lines are words apart: number them over all texts
    np.cumsum(breaks, out=text[1:])
    line = text[:-1] + row if len(raw) else text[:0]
    _, at = np.unique(line, return_index=True)
    last = np.append(at[1:], len(raw))[: len(at)] - 1
    closed = word_hashes(raw, at, np.where(breaks[last], last, last + 1))
    line_row = row[at]
    order = np.lexsort((closed, line_row))
    twice = np.zeros(len(order), bool)
    twice[1:] = (closed[order][1:] == closed[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    repeated = np.bincount(line_row[order][twice], minlength=n)
    out = [
        np.log1p(words), np.log1p(size), (size - kinds[:, 6]) / np.maximum(words, 1), *(_share(kinds[:, k], size, 20) for k in (1, 2, 3, 4, 5, 6, 7)),
        distinct / np.sqrt(np.maximum(words, 1)), _share(same, words), _share(np.maximum(top - 1, 0), words), _share(short, words), _share(long, words),
        np.log1p(lines), _share(repeated, lines), _share(ends_in_symbol, words),
    ]
    return np.stack(out, axis=1).astype(np.float64)


STATS = T.StructField("stats", T.ArrayType(T.DoubleType()))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column `stats` in place of the text."""

    def make():
        def stats(batch: pa.RecordBatch) -> list[pa.Array]:
            x = text_statistics(batch.column(text))
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))]

        return stats

    return add_columns(docs, [STATS], make, drop=(text,), most=SLICE)


@dataclass
class Model:
    """All that scoring needs; its size is fixed."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features and the constant
    at: np.ndarray  # calibration: raw scores, ascending
    value: np.ndarray  # and their probabilities

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return features(stats, self.mean, self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.at, self.value), 0, 1)


def features(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of the standardised statistics, and a constant."""
    d = len(mean)
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, 1 / np.sqrt(d), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    x = np.clip((stats - mean) / scale, -6, 6)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ w + b), np.ones((len(x), 1))])


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("stats")
    return np.asarray(values.flatten()).reshape(len(values), -1)


def _pooled(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing means nearest to y / n with weights n (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for s, w in zip(y, n):
        blocks.append([s, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, w2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + w2, blocks[-1][2] + k2]
    return np.concatenate([np.full(k, s / w) for s, w, k in blocks]) if blocks else np.zeros(0)


def fit(train: DataFrame) -> Model:
    """A model from rows (stats, label 0 or 1, calibrate boolean); other labels and null rows take no part.

    Rows with `calibrate` set the calibration, the others the weights. Without rows
    of either kind every score is the labels' mean, or 0.5 without labels.
    """
    rows = train.where("stats is not null and label in (0, 1)").select("stats", F.col("label").cast("double").alias("label"), "calibrate")
    d, k = len(NAMES), FEATURES + 1

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _stats_of(batch)
        y = np.asarray(batch.column("label"))
        return np.concatenate([[len(x), y.sum()], x.sum(0), (x**2).sum(0)])

    m = summed(rows, moments, 2 + 2 * d)
    if not m[0]:
        return Model(np.zeros(d), np.ones(d), np.zeros(k), np.array([0.0]), np.array([0.5]))
    mean = m[2 : 2 + d] / m[0]
    scale = np.sqrt(np.maximum(m[2 + d :] / m[0] - mean**2, 1e-12))
    scale[scale < 1e-5] = 1

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        of = ~np.asarray(batch.column("calibrate").cast(pa.int8())).astype(bool)
        z, y = features(_stats_of(batch)[of], mean, scale), np.asarray(batch.column("label"))[of]
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(y)]])

    e = summed(rows, equations, k * k + k + 1)
    penalty = RIDGE * max(e[-1], 1) * np.eye(k) / FEATURES
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(e[: k * k].reshape(k, k) + penalty, e[k * k : -1])
    edges = np.linspace(-0.5, 1.5, BINS + 1)[1:-1]
    model = Model(mean, scale, weights, np.array([0.0]), np.array([m[1] / m[0]]))

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        of = np.asarray(batch.column("calibrate").cast(pa.int8())).astype(bool)
        raw, y = model.raw(_stats_of(batch)[of]), np.asarray(batch.column("label"))[of]
        at = np.searchsorted(edges, raw)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, raw, BINS)])

    n, y, raw = summed(rows, binned, 3 * BINS).reshape(3, BINS)
    full = n > 0
    if e[-1] and full.any():
        model.at, model.value = raw[full] / n[full], _pooled(y[full], n[full])
    return model


def scored(docs: DataFrame, model: Model, text: str | None = None) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5, else 0), from `stats`, which goes, or from a text column, which stays."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value

        def score(batch: pa.RecordBatch) -> list[pa.Array]:
            s = m.score(text_statistics(batch.column(text)) if text else _stats_of(batch))
            return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

        return score

    return add_columns(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, drop=() if text else ("stats",), most=SLICE)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3


#: Labelled ids that are broadcast, so that statistics are computed of labelled texts alone.
MOST_IDS = 1_000_000


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model from (doc_id, text) or (doc_id, stats) and (doc_id, label); rows of fold 1, of no fold, or without label are not learned from."""
    rows = docs.where(fold() != 1)
    if "stats" not in docs.columns:
        ids = labels.where(F.col(label).isin(0, 1)).select("doc_id").where(fold() != 1).distinct()
        # beyond the bound statistics, which are short, are joined in place of texts
        rows = with_statistics(rows.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= MOST_IDS else rows)
    rows = rows.select("doc_id", "stats").join(labels.select("doc_id", F.col(label).alias("label")), "doc_id")
    rows = rows.select("stats", "label", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("calibrate"))
    return fit(written(rows, "labelled"))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text).

    Only texts are scored; null and empty texts get a score too. held_out rows, whose
    fold is 1, are never learned from; a null doc_id is not held out, nor learned
    from. Repeated rows and repeated labels count each time.
    """
    stats = written(with_statistics(docs.select("doc_id", "text")), "stats")
    out = scored(stats, trained(stats, labels, label))
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The rows of docs that are predicted to be good, with their columns."""
    with scratch(docs.sparkSession):
        model = trained(docs.select("doc_id", "text"), labels, label)
    plain, names = plain_names(docs, "doc_id", "text")
    return scored(plain, model, text="text").where("predicted = 1").select(*plain.columns).toDF(*names)
