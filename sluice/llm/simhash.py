"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. If two fingerprints
differ in at most two bits, then one of their segments differs in at most one.
Each segment is indexed under its 32 variants with one bit deleted, so that an
equality join of variants finds every such pair; the other bits are then compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import mapped, new_path, scratch, slices, written

SEED = 42
MAX_BITS = 2
#: Up to here a bucket's members are compared inside their task; beyond it they are sorted by what two deleted bits leave.
PAIRWISE = 4096
#: Still larger buckets leave their task for a grouped minimum; see _spread.
SPREAD = 200_000


def _majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of `counts` hashes: the bits set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    at = np.cumsum(counts[full]) - counts[full]
    ones = np.empty((len(full), 64), np.int64)
    for byte in range(8):
        bits = np.unpackbits((hashes >> np.uint64(8 * byte)).astype(np.uint8)[:, None], axis=1, bitorder="little")
        ones[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > counts[full][:, None], axis=1, bitorder="little")
    out[full] = bits.view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of each row as a signed long.

    Words are lower-cased for A-Z only; a text with fewer words than a shingle has
    its whole word sequence as the one shingle; one without words, or a null, has 0.
    Repeated shingles count each time. A bit is set if it is set in over half of the
    shingles' XXH64 (seed 42, unsigned) values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for part in slices(batch):
                hashes, counts = [], []
                for t in part.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist():
                    words = t.lower().split()
                    if len(words) >= shingle:
                        made = [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(len(words) - shingle + 1)] if shingle != 3 else [digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])]
                    else:
                        made = [digest(b" ".join(words), SEED)] if words else []
                    hashes += made
                    counts.append(len(made))
                fp = _majorities(np.array(hashes, np.uint64), np.array(counts, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return mapped(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, fp long")


def _stars(fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (least node, node) for each set of bucket members that chains of near members join."""
    n = len(fp)
    label = np.arange(n)
    if n <= PAIRWISE:
        left = label.copy()
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                i = todo.pop()
                near = np.bitwise_count(fp[left] ^ fp[i]) <= MAX_BITS
                if near.any():
                    label[left[near]] = label[i]
                    todo += left[near].tolist()
                    left = left[~near]
    else:
        # Two are near if they agree after two of the bits that differ in the bucket are
        # deleted: each such class is joined to its head, in linear space.
        differ = [b for b in range(64) if int(np.bitwise_or.reduce(fp ^ fp[0])) >> b & 1]
        for i, j in [(i, j) for k, i in enumerate(differ) for j in differ[k + 1 :]] or [(b, b) for b in differ]:
            kept = fp & ~(np.uint64(1 << i) | np.uint64(1 << j))
            order = np.argsort(kept, kind="stable")
            same = np.concatenate([[False], kept[order][1:] == kept[order][:-1]])
            head = order[np.maximum.accumulate(np.where(same, 0, np.arange(n)))][same]
            for x, y in zip(head.tolist(), order[same].tolist()):
                while label[x] != x:
                    x = label[x]
                while label[y] != y:
                    y = label[y]
                label[max(x, y)] = min(x, y)
            while (flat := label[label]).tolist() != label.tolist():
                label = flat
    order = np.lexsort((node, label))
    new = np.concatenate([[True], label[order][1:] != label[order][:-1]])
    head = node[order][np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    return head[~new], node[order][~new]


def _links_in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, node) sorted by key -> (a, b, fp): links of nodes; of a bucket beyond SPREAD its rows, with a null b."""
    held = [np.zeros(0, np.int64)] * 3  # a bucket that may go on
    leaving = None  # the key of a bucket that is beyond SPREAD
    for batch in batches:
        now = [np.asarray(batch.column(i)) for i in range(3)]
        if leaving is not None:
            n = int(np.searchsorted(now[0], leaving, "right"))
            yield _rows(now[2][:n], None, now[1][:n])
            now = [x[n:] for x in now]
        if not len(now[0]):
            continue
        leaving = None
        now = [np.concatenate(x) for x in zip(held, now)]
        n = int(np.searchsorted(now[0], now[0][-1]))
        yield from _links_of(*(x[:n] for x in now))
        held = [x[n:] for x in now]
        if len(held[0]) > SPREAD:
            leaving = held[0][0]
            yield _rows(held[2], None, held[1])
            held = [x[:0] for x in held]
    yield from _links_of(*held)


def _rows(a, b, fp) -> pa.RecordBatch:
    none = lambda: pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none() if b is None else pa.array(b, pa.int64()), none() if fp is None else pa.array(fp, pa.int64())], ["a", "b", "fp"])


def _links_of(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(key) < 2:
        return
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.append(first[1:], len(key))
    two = first[end - first == 2]  # most of the buckets that have more than one
    two = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= MAX_BITS]
    a, b = [node[two]], [node[two + 1]]
    for i in np.flatnonzero(end - first > 2).tolist():
        x, y = _stars(fp[first[i] : end[i]].view(np.uint64), node[first[i] : end[i]])
        a.append(x)
        b.append(y)
    links = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    if links.shape[1]:
        yield _rows(links[0], links[1], None)


def _spread(big: DataFrame) -> DataFrame:
    """Links among the rows of large buckets: fingerprints that agree after two bits are deleted point at their least node.

    That is every pair within two bits, in a number of rows that is linear in the
    bucket and summed before the shuffle.
    """
    rows = big.select("fp", "node").distinct().select("fp", "node", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i"))
    rows = rows.select("fp", "node", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(63))).alias("j"))
    rows = rows.select("node", "i", "j", F.expr("fp & ~(shiftleft(1L, i) | shiftleft(1L, j))").alias("kept"))
    least = rows.groupBy("i", "j", "kept").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    return rows.join(least, ["i", "j", "kept"]).where("node != a").select("a", F.col("node").alias("b")).distinct()


def near_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links of nodes (fp, node) with distinct fp; their components are those of all pairs within two bits."""
    variants = nodes.select("fp", "node", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    segment = F.expr("shiftrightunsigned(fp, if(i < 32, 0, 32)) & 4294967295L & ~shiftleft(1L, i % 32)")
    keys = variants.select((F.expr("shiftleft(cast(i as long), 32)").bitwiseOR(segment)).alias("key"), "fp", "node")
    found = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_links_in_buckets, "a long, b long, fp long")
    found = written(found, "near")
    big = found.where("b is null").select(F.col("a").alias("node"), "fp")
    return found.where("b is not null").select("a", "b").unionByName(_spread(big))


def near_groups(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): each row's fingerprint, and the smallest doc_id it can reach over links.

    Fingerprints link at two or fewer differing bits. Rows of one fingerprint meet
    in a grouped minimum first, so that a large group of copies is one node. Rows
    that repeat a doc_id with another text are that document too, and link through
    it. A null doc_id takes no part: its component is null. No rows give no rows.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "near_groups")
    with scratch(spark):
        _groups(written(fingerprints(docs, shingle, doc_id, text), "fingerprints")).write.parquet(path)
    return spark.read.schema("doc_id long, fp long, component_id long").parquet(path)


def _groups(rows: DataFrame) -> DataFrame:
    from sluice.llm.components import components

    nodes = rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    nodes = written(nodes, "nodes")
    several = rows.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("z")).where("x != z").select("doc_id")
    own = rows.join(several, "doc_id").join(nodes, "fp").select("doc_id", "node").distinct()
    own = own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b"))
    found = components(near_links(nodes).unionByName(own))
    roots = nodes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return rows.join(roots, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def fingerprint_hex(fp: str = "fp") -> F.Column:
    """Sixteen lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
