"""A corpus pipeline of the operators in sluice.llm.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns what it keeps, with the columns of documents; the last returns token ids.
A stage that changes a text sets n_chars to its new length. Every stage takes null
texts (as empty), texts of any length, null ids, repeated rows, no rows, and further
columns of any name, which pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, minhash, pieces, quality, simhash, substrings
from sluice.llm.common import new_path, plain_names, remove, scratch
from sluice.llm.queries import LEAK_WORDS, PIECES, table

#: Words of a shingle, and the per cent of shingles in common from which two documents are near-duplicates.
SHINGLE, SIMILARITY = 5, 80
#: Words of a passage that stays only where it stands first.
PASSAGE_WORDS = 50
#: Bytes of text and of strings that substring dedup, decontamination and encoding work on at a time.
CUT = 1 << 19
#: A document with more than this share of benchmark words goes.
MOST_LEAKED = 0.5
#: Ids that are broadcast, so that texts stay where they are; more are joined.
MOST_IDS = 1_000_000


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _any_names(stage: Stage) -> Stage:
    """The stage, over columns renamed by their place but for those that it knows: further columns may have any name."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain, names = plain_names(docs, "doc_id", "text", "n_chars")
        return stage(spark, plain, sf_dir).select(*plain.columns).toDF(*names)

    return run


@_any_names
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Rows are judged by their text alone: equal texts share their fate, null ones are empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_any_names
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (Jaccard similarity of shingles) one row of the smallest id stays.

    Groups come from SimHash fingerprints (simhash.near_groups, the operator of op10) of the same
    shingles; whole sets decide on each of its pairs. At the bound fingerprints differ in some
    ten of 64 bits, which no deletion of bits selects: what they leave apart is searched by minima
    (minhash.near_groups), so that no pair of that similarity is lost.

    Texts without words are copies of each other. Rows that share an id are one document,
    of which the row of the least text hash stays. Rows without an id are compared with
    none and all stay.
    """
    alike = simhash.near_groups(docs, SHINGLE).where("doc_id != component_id")
    found = minhash.similar_groups(docs, SHINGLE, SIMILARITY, likely=alike.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    return _one_row_each(docs.join(_bounded(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns))


def _bounded(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if n <= MOST_IDS else ids


def _one_row_each(docs: DataFrame) -> DataFrame:
    """docs with one row for each id that stands more than once: only such rows are shuffled."""
    several = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    n = several.count()
    if not n:
        return docs
    several = _bounded(several, n)
    row = F.struct(*docs.columns)
    again = docs.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(F.xxhash64("text"), F.to_json(row))).alias("row"))
    return docs.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(again.select("row.*"))


@_any_names
def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in a document of smaller id go; texts without such keep their form, null ones stay null.

    Rows without an id lose nothing and take nothing; rows that share an id take nothing from each other.
    """
    kept = substrings.without_repeats(docs, PASSAGE_WORDS, cut=CUT)
    return _with_text(kept.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))), docs)


@_any_names
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go, and documents that are mostly such. Rows are judged one by one; null and empty texts stay."""
    return _with_text(decontaminate.without_hits(docs, table(spark, sf_dir, "benchmark"), LEAK_WORDS, MOST_LEAKED, most=CUT), docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, parity, round_trip) of each row: texts as token ids, decoded again and compared; null and empty texts have none."""
    ids = pieces.encoded(docs.select("doc_id", "text"), PIECES, verify=True, most=CUT)
    return ids.select("doc_id", "ids", "n_tokens", "parity", "round_trip")


def _with_text(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with the length of the text as it is now."""
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]
#: Classifier, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again as the next one's docs.

    What a stage wrote on its way goes when its result is written, and that when the next
    one's is; the last stage is not run before its result is read.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = new_path(spark, "stage")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
