"""Benchmark decontamination with generalised suffix automata of the test items.

Items and documents are read as words: A-Z lower-cased, then maximal runs of
ASCII letters and digits and of non-ASCII characters. An automaton has every word
sequence that occurs in its items. Documents' words are streamed through it: after
each word it holds the longest sequence that ends there and occurs in an item.

Tasks build the automata, each from about ITEM_BYTES of items, and write them to the
shared folder. Spark brings the files to the executors, where tasks match a batch with
one after the other: one pass over the documents, whatever the number of automata.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.automaton import FOLD, Automaton, built, packed
from sluice.llm.common import add_columns, kept, new_path, plain_names, utf8, words_of

#: An automaton is built from items of about so many bytes; its arrays have some ten times as many.
ITEM_BYTES = 1 << 20
#: Bytes of text that are matched at a time; a worker holds some forty times as many.
SLICE = 2 << 20
#: Automata that a worker holds at most.
HELD = 3


def automata(items: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> list[str]:
    """Build automata over all items and bring them to the executors; the names of their files.

    Items without text have no windows; an item without an id has windows, but no id to
    be listed. What passes the driver is their number and names.
    """
    spark = items.sparkSession
    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("item_id"), F.encode(text, "UTF-8").alias("text"))
    total = rows.agg(F.sum(F.length("text") + 8)).first()[0]
    if not total:
        return []
    parts = -(-total // ITEM_BYTES)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        done = lambda: pa.RecordBatch.from_arrays([pa.array([packed(built(own, window))], pa.binary())], ["automaton"])
        for batch in batches:
            for part, name, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "item_id", "text"))):
                if part != now and own:
                    yield done()
                    own = []
                now = part
                own.append((name, raw))
        if own:
            yield done()

    path = new_path(spark, "automata")
    made = rows.repartition("part").sortWithinPartitions("part").mapInArrow(build, "automaton binary")
    made.write.options(compression="none", maxRecordsPerFile="1").parquet(path)
    files = sorted(r[0] for r in spark.read.schema("automaton binary").parquet(path).select("_metadata.file_path").collect())  # those with a row
    for f in files:
        spark.sparkContext.addFile(f)
    return [f.rsplit("/", 1)[1] for f in files]


def _automaton(name: str) -> Automaton:
    """The automaton of a file that the executor has; the worker holds those it used last."""
    held: OrderedDict[str, Automaton] = kept(Automaton.__name__, OrderedDict)
    if name not in held:
        while len(held) >= HELD:
            held.popitem(last=False)
        held[name] = Automaton(pq.read_table(SparkFiles.get(name)).column(0)[0].as_py())
    held.move_to_end(name)
    return held[name]


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
)


def with_hits(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """docs with n_words, hit_spans (a to b: word numbers, disjoint) and hit_items (sorted ids of items with a window in the text).

    A word is hit if it is inside an occurrence of a window. Null and empty texts have
    no words; without items nothing is hit; rows are judged one by one, so repeated
    rows stay. Other columns pass through; those named as the new ones are replaced.
    """
    return _searched(docs, items, window, text, cut=False)


def _searched(docs: DataFrame, items: DataFrame, window: int, text: str, cut: bool, most: int = SLICE) -> DataFrame:
    """with_hits; `cut` takes the hit words out of the text. most: bytes of text at a time."""
    files = automata(items, window)
    fields = [*FOUND.fields, *([T.StructField(text, T.StringType())] if cut else [])]
    return add_columns(docs, fields, lambda: lambda batch: _matched(batch.column(text), files, cut), most=most)


def _matched(column: pa.Array, files: list[str], cut: bool) -> list[pa.Array]:
    raw, offsets = utf8(column)
    folded = FOLD[raw]
    starts, ends, row = words_of(folded, offsets)
    n = len(offsets) - 1
    covers = np.zeros(len(starts) + 1, np.int64)
    names: dict[int, set[str | None]] = {}
    if files and len(starts):
        at = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=at[1:])
        solid = pa.py_buffer(folded[folded != 32])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), solid]).dictionary_encode()
        number = np.asarray(words.indices)
        for name in files:
            automaton = _automaton(name)
            end, size, mark = automaton.found(words.dictionary, number, row)
            np.add.at(covers, end - size + 1, 1)
            np.add.at(covers, end + 1, -1)
            pairs = np.unique(row[end] * len(automaton.a["marked"]) + mark)
            who, item = automaton.items_of(pairs % max(len(automaton.a["marked"]), 1))
            pairs = np.unique((pairs // max(len(automaton.a["marked"]), 1))[who] * len(automaton.names) + item)
            item = pairs % max(len(automaton.names), 1)
            given = zip((pairs // max(len(automaton.names), 1)).tolist(), automaton.names.take(pa.array(item)).to_pylist(), automaton.a["nameless"][item].tolist())
            for r, own, nameless in given:
                names.setdefault(r, set()).add(None if nameless else own)
    hit = np.zeros(len(starts) + 2, bool)
    hit[1:-1] = np.cumsum(covers[:-1]) > 0
    same = np.ones(len(starts) + 1, bool)  # the word is of the row of the one before
    same[1:-1] = row[1:] == row[:-1]
    a = np.flatnonzero(hit[1:-1] & (~hit[:-2] | ~same[:-1]))
    b = np.flatnonzero(hit[1:-1] & (~hit[2:] | ~same[1:])) + 1
    words_before = np.searchsorted(row, np.arange(n + 1))
    of = row[a]
    spans = pa.StructArray.from_arrays([pa.array((x - words_before[of]).astype(np.int32)) for x in (a, b)], ["a", "b"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), spans)
    listed = [sorted(x for x in names[r] if x is not None) + [None] * (None in names[r]) if r in names else [] for r in range(n)]
    out = [pa.array(np.diff(words_before), pa.int64()), spans, pa.array(listed, pa.list_(pa.string()))]
    return [*out, _cut(column, raw, offsets, of, starts[a], ends[b - 1])] if cut else out


def _cut(column: pa.Array, raw: np.ndarray, offsets: np.ndarray, of: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts without their bytes from begin to end; of: their rows. A null stays."""
    gone = np.zeros(len(raw) + 1, np.int8)
    gone[begin] += 1
    gone[end] -= 1
    kept = np.cumsum(gone[:-1], dtype=np.int8) == 0
    left = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(kept, out=left[1:])
    null = np.packbits(np.asarray(column.is_valid()), bitorder="little")
    buffers = [pa.py_buffer(null), pa.py_buffer(left[offsets]), pa.py_buffer(raw[kept])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), buffers).cast(pa.large_string())


def n_hit(spans: str = "hit_spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])


def items_digest(names: str = "hit_items") -> Column:
    """Lower-case hex SHA-256 of the sorted ids, comma-joined."""
    return F.sha2(F.concat_ws(",", names), 256)


def without_hits(docs: DataFrame, items: DataFrame, window: int = 10, most_share: float = 0.5, text: str = "text", most: int = SLICE) -> DataFrame:
    """docs without benchmark passages: hit words are cut from the text; a document goes when over most_share of its words are hit.

    Each span goes from its first word's first character to its last word's last.
    Documents without hits keep their text as it is, null texts too. The columns are
    those of docs. most: bytes of text that are matched at a time.
    """
    plain, names = plain_names(docs, text)
    found = _searched(plain, items, window, text, True, most)
    found = found.where(~((F.col("n_words") > 0) & (n_hit() > most_share * F.col("n_words"))))
    return found.select(*plain.columns).toDF(*names)
