"""Target-distribution importance resampling over hashed word n-grams.

A byte automaton reads the Arrow buffer of a batch as it is: a table of classes tells
which bytes belong to words, differences of neighbouring classes are the words'
bounds, and the CRC-32 registers of all words advance together, a byte of each in
one step, by the usual table. The register of a longer run goes on from that of its
first words, so that no run is cut out or joined.

Counts of the buckets have a fixed size: tasks add them up, the sum gives a gain for
each bucket, and a second reading weighs each text by its mean gain. Gumbel noise from
the id turns the weights into a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import add_columns, free_name, slices, summed, utf8, words_of, written

#: Buckets of the counts, words of the longest run, words of a text that can be drawn, and the draw's seed.
BUCKETS, WORDS, LEAST_WORDS, SEED = 10_000, 2, 20, 7
#: Bytes of text that are looked at at a time, and words whose registers advance together.
SLICE, TOGETHER = 1 << 20, 1 << 18
#: Steps that the registers take together; what is left of longer words goes one by one, in as few calls.
STEPS = 64
#: Scores whose numbers are summed in one task.
BLOCK = 256

_FULL = np.uint32(0xFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_APART = np.ones(256, bool)  # bytes between words
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _table()


def _stepped(state: np.ndarray, byte) -> np.ndarray:
    return _CRC[(state ^ byte) & 255] ^ (state >> 8)


def advanced(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 registers after raw[start:end] of each, all at once."""
    size = ends - starts
    order = np.argsort((255 - np.minimum(size, 255)).astype(np.uint8), kind="stable")  # longest first; the same beyond 255
    state, at, left = state[order], starts[order], -np.minimum(size[order], 255)
    for t in range(min(STEPS, -int(left[0])) if len(left) else 0):
        n = int(np.searchsorted(left, -t))
        state[:n] = _stepped(state[:n], raw[at[:n] + t])
    for i in range(int(np.searchsorted(left, -STEPS))):
        rest = raw[at[i] + STEPS : ends[order[i]]]
        state[i] = zlib.crc32(rest, int(state[i] ^ _FULL)) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def hashed_runs(column: pa.Array, words: int = WORDS, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of all runs of 1 to `words` consecutive words of a text, in parts; the bucket is the CRC-32 of the run, words joined by a space."""
    raw, offsets = utf8(column)
    starts, ends, row = words_of(raw, offsets, _APART)
    raw = _LOWER[raw]
    for i in range(0, len(starts), TOGETHER):
        j = min(i + TOGETHER, len(starts))
        state = np.full(j - i, _FULL, np.uint32)
        for k in range(words):
            # the runs that begin at i .. j and have k + 1 words
            n = min(j, len(starts) - k) - i
            if n <= 0:
                break
            whole = row[i : i + n] == row[i + k : i + k + n]
            state = state[:n]
            if k:
                state = _stepped(state, np.uint8(0x20))
            state = advanced(state, raw, starts[i + k : i + k + n], ends[i + k : i + k + n])
            yield (state[whole] ^ _FULL) % np.uint32(buckets), row[i : i + n][whole]


def bucket_counts(docs: DataFrame, text: str = "text", words: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of all texts fall into each bucket, repeats counted."""

    def count(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(buckets)
        for part in slices(batch, SLICE):
            for bucket, _ in hashed_runs(part.column(0), words, buckets):
                total += np.bincount(bucket, minlength=buckets)
        return total

    return summed(docs.select(F.col(text).alias("text")), count, buckets)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of each bucket's share in the target over that in the source, both smoothed by one, rounded down."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text", words: int = WORDS) -> DataFrame:
    """docs with n_words, n_features and weight (the mean gain of all runs, rounded down; 0 without runs) in place of the text."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def make():
        of, size = held.value, len(held.value)

        def weigh(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(text)
            total, n = np.zeros((2, len(column)), np.int64)
            raw, offsets = utf8(column)
            n_words = np.bincount(words_of(raw, offsets, _APART)[2], minlength=len(column))
            for bucket, row in hashed_runs(column, words, size):
                n += np.bincount(row, minlength=len(column))
                total += np.bincount(row, of[bucket], len(column)).astype(np.int64)  # whole numbers far below 2 ** 53
            return [pa.array(n_words, pa.int64()), pa.array(n), pa.array(total // np.maximum(n, 1))]

        return weigh

    return add_columns(docs, [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")], make, drop=(text,), most=SLICE)


def gumbel(doc_id: str, seed: int = SEED) -> F.Column:
    """1000 times Gumbel noise, rounded down, from the first 32 bits of the SHA-256 of `seed:id`; null for a null id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 25, words: int = WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of docs; rank is null where it is not drawn.

    Words are runs of letters and digits of ASCII, lower-cased, and of all characters
    beyond it. Of the rows with at least least_words words the given per cent are
    drawn, those of the highest scores, ties to the smaller id. Null and empty texts have
    no runs and weight 0. A null id has no score and is not drawn; rows that repeat an
    id are weighed and drawn each. target may be empty, and no rows give no rows.

    A score's rank is the number of rows with higher scores, from sums over blocks of
    scores, and the row's place among those of its own score.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    gain = gains(bucket_counts(rows, "text", words, buckets), bucket_counts(target, text, words, buckets))
    rows = weighed(rows, gain, "text", words).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    rows = written(rows, "weighed")
    fit = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    scores = rows.where(fit).groupBy("score").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("score") / BLOCK))
    scores = written(scores, "scores")
    n_drawn = (scores.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * percent) // 100
    above = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = scores.groupBy("block").agg(F.sum("n").alias("n")).select("block", above(Window.orderBy(F.desc("block"))).alias("beyond"))
    higher = scores.withColumn("higher", above(Window.partitionBy("block").orderBy(F.desc("score")))).join(blocks, "block")
    higher = higher.select("score", (F.col("higher") + F.col("beyond")).alias("higher")).where(F.col("higher") < n_drawn)
    # there are no more distinct scores than thousandths between the least and the greatest logarithm: some 100,000 for any input
    near = rows.join(F.broadcast(higher), "score", "left").withColumn("drawable", fit & F.col("higher").isNotNull())
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    rank = F.col("higher") + place
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    drawn = near.where("drawable").select(*names, rank.alias("rank"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    return drawn.unionByName(near.where("not drawable").select(*names, F.lit(None).cast("long").alias("rank")))


def drawn_rows(docs: DataFrame, ranks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs whose id was drawn, with all their columns."""
    name = free_name("drawn", docs)
    ids = ranks.where("rank is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, docs[f"`{doc_id}`"] == ids[name], "left_semi")
