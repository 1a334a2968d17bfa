"""Token counts (exact length histogram) and token-id files (ORC).

Both encode with a tokenizers-library file whose pre-tokenizer drops white
space and never joins across it, so that a text's ids are those of its
white-space-separated words, one after the other. Each Python worker keeps a
bounded table from word to ids; words not in it go to the library in batches.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import Remembered, add_columns, gathered, joined, kept, mapped, packed_sizes, slices, written

#: Words that one Python worker remembers, twice over.
CACHE_WORDS = 250_000
#: Bytes of text that are encoded at a time: what a word of them costs is paid once.
SLICE = 12 << 20
#: A character that hardly any text has; it stands between words that are encoded together.
MARK = "\x01"
#: Ids are written in this form.
ID = np.dtype("<u4")

class WordEncoder:
    """text -> packed ids, through a bounded word table.

    A word of Latin letters, with or without points behind it, is known by its lower-case
    letters; new ones go to the library's BPE model in the form that the file's normaliser
    and byte-level pre-tokenizer give them, where these are the usual ones. Any other word
    goes through the whole tokenizer, many of them as one text.
    """

    #: Letters whose lower-case forms do not depend on what is around them, with or without points behind.
    LATIN = "^(?P<stem>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)(?P<points>[.,;:!?]*)$"

    def __init__(self, path: str) -> None:
        # as many threads as Spark gives a Python worker (spark.task.cpus)
        os.environ.setdefault("RAYON_NUM_THREADS", os.environ.get("OMP_NUM_THREADS", "1"))
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.stems = Remembered(CACHE_WORDS), Remembered(CACHE_WORDS)
        self.mark = None
        alone = self._whole([MARK])[0]
        if len(alone) == 1 and self._whole(["a", f"a {MARK} b", "b"])[1] == [*self._whole(["a"])[0], *alone, *self._whole(["b"])[0]]:
            self.mark = alone[0]
        # Byte-level form: printable bytes stand for themselves, the others for characters from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.form = {b: 256 + i for i, b in enumerate(rest)}
        probe = "Éa"
        shown = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(probe))
        self.direct = [x for x, _ in shown] == [self._form(probe.lower())] and self.tokenizer.encode("Éa,b.", add_special_tokens=False).ids == [*self._model("éa"), *self._whole([","])[0], *self._model("b"), *self._whole(["."])[0]]

    def _form(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.form)

    def _model(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(self._form(word))]

    def _stems(self, words: list[str]) -> list[bytes]:
        """_model of each word, packed."""
        tokenize, form = self.tokenizer.model.tokenize, self._form
        return [array("I", [t.id for t in tokenize(w if w.isascii() else form(w))]).tobytes() if w else b"" for w in words]

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [ids for i in range(0, len(words), 1_000) for ids in self._joined(words[i : i + 1_000])]

    def _joined(self, words: list[str]) -> list[list[int]]:
        """The ids of each word: all are encoded as one text, with MARK between them, where its id shows each place once."""
        if self.mark is not None and not any(MARK in w for w in words):
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(words)], add_special_tokens=False)[0].ids, ID)
            at = np.flatnonzero(ids == self.mark)
            if len(at) == len(words) - 1:
                ids = ids.tolist()
                return [ids[a:b] for a, b in zip([0, *(at + 1).tolist()], [*at.tolist(), len(ids)])]
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _other(self, words: list[str]) -> list[bytes]:
        """The whole tokenizer's ids of each word, packed."""
        return [array("I", x).tobytes() for x in self._whole(words)]

    def _values(self, words: pa.Array) -> list[bytes]:
        """The packed ids of distinct words, in their order.

        Words of Latin letters share those of their lower-case form, and of the points behind it.
        """
        parts = pc.extract_regex(words, self.LATIN) if self.direct else pa.nulls(len(words), pa.struct({"stem": pa.string(), "points": pa.string()}))
        latin = np.flatnonzero(np.asarray(parts.is_valid()))
        other = _strings(words.filter(parts.is_null()))
        parts = parts.drop_null()
        stems, points = pc.utf8_lower(parts.field("stem")).dictionary_encode(), parts.field("points").dictionary_encode()
        distinct, tails = _strings(stems.dictionary), _strings(points.dictionary)
        known = self.stems.of([distinct], self._stems)
        stem = list(map(known.__getitem__, distinct))
        known = self.words.of([other, tails], self._other)
        tail = [known[t] for t in tails]
        out = np.empty(len(words), object)
        out[latin] = [stem[i] + tail[j] for i, j in zip(np.asarray(stems.indices).tolist(), np.asarray(points.indices).tolist())]
        rest = np.ones(len(words), bool)
        rest[latin] = False
        out[rest] = [known[w] for w in other]
        return out.tolist()

    def _words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Where each text's words begin (and the last end), each word's number, and the packed ids of the words by number."""
        split = pc.ascii_split_whitespace(column.cast(pa.string()).fill_null(""))
        coded = split.flatten().dictionary_encode()
        return np.asarray(split.offsets).astype(np.int64), np.asarray(coded.indices), self._values(coded.dictionary)

    def counts(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        at, word, ids = self._words(column)
        total = np.zeros(len(word) + 1, np.int64)
        np.cumsum(packed_sizes(ids)[word], out=total[1:])
        return np.diff(total[at])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (and the last end)."""
        at, word, ids = self._words(column)
        return gathered(ids, word, at)


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of this file."""
    return kept((WordEncoder.__name__, path), lambda: WordEncoder(path))


def length_histogram(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many texts have each encoded length.

    Null and empty texts have length 0. Whole texts are encoded; repeated rows
    count each time. Each task sums its batches before the shuffle, so that what
    is shuffled follows the number of distinct lengths.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for part in joined(batches, SLICE):
            n_tokens, n_docs = np.unique(enc.counts(part.column(0)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n_tokens, pa.int64()), pa.array(n_docs, pa.int64())], ["n_tokens", "n_docs"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame, block: int = 64) -> DataFrame:
    """The histogram with what every context limit asks for, one row per distinct length.

    docs_at_least, tokens_at_least: texts of at least n_tokens, and their tokens.
    truncated_tokens: tokens left when every text is cut to n_tokens.
    total_docs, total_tokens; quantile: share of texts of at most n_tokens.

    Sums run within blocks of lengths, and over the blocks' totals: one task sees
    one block, or one row for each block. An empty histogram gives no rows.
    """
    h = written(histogram, "histogram")
    h = h.select("n_tokens", "n_docs", F.expr(f"n_tokens div {block}").alias("b"), (F.col("n_tokens") * F.col("n_docs")).alias("t"))
    after = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = h.groupBy("b").agg(F.sum("n_docs").alias("bd"), F.sum("t").alias("bt"))
    blocks = blocks.select(
        "b",
        F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("later_tokens"),
        F.sum("bd").over(every).alias("total_docs"),
        F.sum("bt").over(every).alias("total_tokens"),
    )
    down = Window.partitionBy("b").orderBy(F.col("n_tokens").desc())
    h = h.withColumns({"d": F.sum("n_docs").over(down), "s": F.sum("t").over(down)}).join(blocks, "b")
    h = h.withColumns({"docs_at_least": F.col("d") + F.col("later_docs"), "tokens_at_least": F.col("s") + F.col("later_tokens")})
    return h.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
        "total_docs",
        "total_tokens",
    )


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit: total_docs, docs_over, truncated_tokens.

    The suffix sums at the smallest length of at least `limit` answer it: longer
    texts give `limit` tokens each, and shorter ones all they have.
    """
    over = F.col("n_tokens") > limit
    return sums.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("total_docs"),
        F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens"),
    )


def length_quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row n_tokens: the least length that a share q of the texts does not exceed; null without texts."""
    return sums.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write (doc_id, task_offset, n_tokens, ids) as ORC files in ascending doc_id order.

    Null ids come first; rows of one id follow in the order of their texts' hashes; a null
    text is empty and has the end id alone. Texts are dealt by range before they are
    encoded, as they are smaller than ids. Integer columns are run-length encoded by
    ORC; each stripe has row indexes and a Bloom filter on doc_id. task_offset counts
    the ids before the document in the files of its task.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("task_offset", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = encoder(tokenizer), 0
        for part in joined(batches, SLICE):
            ids, at = enc.encode(part.column("text"))
            n = len(at) - 1
            ids = np.insert(ids, at[1:], end_id).view(np.int32)
            at = at + np.arange(n + 1)
            column = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
            made = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(before + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), column], ["doc_id", "task_offset", "n_tokens", "ids"])
            before += int(at[-1])
            yield from slices(made)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    mapped(rows.drop("h"), encode, schema).write.options(
        **{"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20), "compression": "zstd"}
    ).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files of write_ids.

    start: ids of all documents before it, which is the task's first id (running
    sum over the tasks' totals, a row for each task) plus the offset in the task.
    A filter on doc_id prunes stripes by their statistics and Bloom filters.
    """
    schema = "doc_id long, task_offset long, n_tokens long, ids array<int>"
    task = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("task")
    rows = spark.read.schema(schema).orc(path).select("*", task)
    totals = rows.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # a row for each task that wrote: small enough to send, and the ids stay where they are read
    return rows.join(F.broadcast(bases), "task").select("doc_id", (F.col("base") + F.col("task_offset")).alias("start"), "n_tokens", "ids")


def with_crc32(rows: DataFrame, ids: str = "ids", name: str = "ids_crc32") -> DataFrame:
    """CRC-32 of each id list as little-endian unsigned 32-bit integers; the list itself goes."""

    def make():
        def crc(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(ids)
            raw = memoryview(np.asarray(column.values.fill_null(0)).astype(ID)).cast("B")
            at = np.asarray(column.offsets).tolist()
            return [pa.array([zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(at, at[1:])], pa.int64())]

        return crc

    return add_columns(rows, [T.StructField(name, T.LongType())], make, drop=(ids,))
