"""MinHash near-duplicates by tensored banding.

A set of shingles has two small collections of TABLES(similarity) half keys, each made of
ROWS minima. Every pair of a half key of the first collection and one of the second is
the key of a table: so there are as many tables as the square of a collection, for the
minima of two. Two sets of similarity s agree in none of a collection's half keys with
probability (1 - s ** ROWS) ** tables; there are so many that a pair at the bound is
missed with MISSED at most. Whole sets decide on each pair.

Half keys that one set alone has are dropped before pairs of them are formed. The members
of a bucket are compared with two of its own, the one whose half keys most sets share and
the least; links are followed; and of what is not joined by then in some bucket, pairs
are found through prefixes (prefix_links), in space that is linear in the sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import ODD, ODD2, mapped, mixed, new_path, range_sums, scratch, slices, utf8, word_hashes, words_of, written
from sluice.llm.components import components

ROWS, MISSED, SEED = 4, 1e-5, 12
#: Nodes of a shingle whose pairs become rows; of a larger crowd so many nodes are held against all others at a time.
CROWD, OUTSIDERS = 32, 1_024
#: The minima of a batch are computed over texts of so many bytes at a time.
SLICE = 1 << 20
SIGNED_DDL = "doc_id long, s1 long, s2 long, n int, halves array<long>"
SETS_DDL = "doc_id long, s1 long, s2 long, shingles array<long>"
#: Ids of candidates that are broadcast; more are joined.
BROADCAST = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def n_tables(percent: int) -> int:
    """Half keys of each of the two collections."""
    if percent >= 100:
        return 1
    return math.ceil(math.log(MISSED / 2) / math.log1p(-((percent / 100) ** ROWS)))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows' texts: the distinct shingles, as sorted 64-bit hashes, one row's after the other; where each row's begin (and the last end)."""
    starts, ends, row = words_of(raw, offsets)
    h = word_hashes(_LOWER[raw], starts, ends)
    begin = np.searchsorted(row, np.arange(len(offsets)))
    n = np.diff(begin)
    count = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(np.int64))
    of = np.repeat(np.arange(len(n)), count)
    first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[of]
    found = mixed(range_sums(mixed(h ^ ODD2), ODD, first, first + np.minimum(shingle, n[of])))
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return found[new], np.searchsorted(of[new], np.arange(len(offsets)))


def _names(found: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Two sums over each row's shingles, which name its set; zeros for an empty one."""
    names, full = np.zeros((2, len(begin) - 1), np.uint64), np.flatnonzero(np.diff(begin))
    if len(full):
        for name, salt in zip(names, (ODD, ODD2)):
            name[full] = np.add.reduceat(mixed(found ^ salt), begin[:-1][full])
    return names


def _longs(begin: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values.view(np.int64)))


def _signed(shingle: int, tables: int):
    """Batches (doc_id, text) -> SIGNED_DDL: what names the set, its size, and the half keys of both collections."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, (2 * tables * ROWS, 2)).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE):
                found, begin = shingle_sets(*utf8(part.column("text")), shingle)
                n = np.diff(begin)
                full = np.flatnonzero(n)
                halves = np.zeros((len(full), 2 * tables), np.uint64)
                if len(full):
                    for k, (a, b) in enumerate(factors):
                        least = np.minimum.reduceat(found * a + b, begin[:-1][full])
                        halves[:, k // ROWS] = mixed(halves[:, k // ROWS] * ODD + least)
                    halves = mixed(halves + np.arange(2 * tables, dtype=np.uint64) * ODD2)
                at = np.concatenate([[0], np.cumsum(np.where(n > 0, 2 * tables, 0))])
                columns = [part.column("doc_id"), *(pa.array(x.view(np.int64)) for x in _names(found, begin)), pa.array(n.astype(np.int32)), _longs(at, halves.ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "s1", "s2", "n", "halves"])

    return run


def _sets(shingle: int):
    """Batches (doc_id, text) -> SETS_DDL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found, begin = shingle_sets(*utf8(part.column("text")), shingle)
                columns = [part.column("doc_id"), *(pa.array(x.view(np.int64)) for x in _names(found, begin)), _longs(begin, found)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "s1", "s2", "shingles"])

    return run


def _sets_of(docs: DataFrame, wanted: DataFrame, names: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the wanted nodes, from the texts of the documents that they are named by."""
    wanted = written(wanted, "wanted")
    ids = wanted.withColumnRenamed("node", "doc_id")
    some = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, "doc_id", "left_semi")
    found = mapped(some.select("doc_id", "text"), _sets(shingle), SETS_DDL).withColumnRenamed("doc_id", "node")
    own = names.join(wanted, "node", "left_semi")
    # an id with several texts can name several sets: the node is all of them
    return found.join(own, ["node", "s1", "s2"], "left_semi").groupBy("node", "s1", "s2").agg(F.first("shingles").alias("shingles")).select("node", "shingles")



def table_keys(nodes: DataFrame, tables: int) -> DataFrame:
    """(key, node, weight) of nodes (node, halves): the keys of all tables, but for those of half keys that no other node has.

    weight: how many nodes have the node's half keys, in all; the middle of a group of near copies has the most.
    """
    values = nodes.select("node", F.posexplode("halves").alias("at", "v"))
    several = values.groupBy("v").agg(F.count("*").alias("size")).where("size > 1")
    first = F.col("at") < tables
    shared = values.join(several, "v").groupBy("node")
    shared = shared.agg(F.collect_list(F.when(first, F.col("v"))).alias("x"), F.collect_list(F.when(~first, F.col("v"))).alias("y"), F.sum("size").alias("weight"))
    return shared.select("node", "weight", F.explode("x").alias("x"), "y").select("node", "weight", "x", F.explode("y").alias("y")).select(F.xxhash64("x", "y").alias("key"), "node", "weight")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole shingle sets have that per cent of their union in common."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    return both.where(100 * common >= percent * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")


def prefix_links(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of nodes (node, root, shingles): pairs (a, b) of different roots still to be compared, and links (a, b) that are; together they have all links.

    Shingles have one order, the rarest first. Two sets that have that per cent in common
    share a shingle within the first n - ceil(n * percent / 100) + 1 of each, n its
    size: so texts that share a template alone, however many, have none of it there.
    Of a shingle's nodes those outside its most frequent root are held against all:
    pairs of up to CROWD nodes become rows; larger crowds, mostly near copies of one text
    that are not near enough to each other, are compared inside tasks, and links alone leave these.
    """
    each = sets.select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    lists = each.join(often, "s").groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("x"))
    lists = written(lists.select("node", "root", "n", F.col("x.s").alias("known")), "lists")
    # shingles that one node has alone come first, and are in common with none
    length = F.expr(f"n - (n * {percent}L + 99) div 100 + 1 - (n - size(known))").cast("int")
    rows = written(lists.select("node", "root", "n", F.explode(F.slice("known", 1, F.greatest(length, F.lit(0)))).alias("s")), "prefixes")
    roots = rows.groupBy("s", "root").agg(F.count("*").alias("size")).groupBy("s")
    roots = roots.agg(F.max(F.struct("size", "root")).alias("m"), F.count("*").alias("roots"), F.sum("size").alias("size")).where("roots > 1")
    roots = written(roots.select("s", F.col("m.root").alias("main"), "size", (F.col("size") - F.col("m.size")).alias("outside")), "postings")

    few = rows.join(roots.where(F.col("size") <= CROWD), "s")
    out = few.where("root != main").select("s", *(F.col(c).alias(f"{c}_1") for c in ("node", "root", "n")))
    both = out.join(few, "s").where((F.col("root") != F.col("root_1")) & ((F.col("root") == F.col("main")) | (F.col("node") < F.col("node_1"))))
    pairs = both.where(100 * F.least("n", "n_1") >= percent * F.greatest("n", "n_1")).select(*_pairs("node", "node_1")).distinct()

    many = rows.join(roots.where(F.col("size") > CROWD), "s").select("s", "node", "main", F.ceil(F.col("outside") / OUTSIDERS).cast("int").alias("parts")).join(lists, "node")
    own = many.where("root != main").withColumns({"part": F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), "other": F.lit(0)})
    every = many.withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "other": F.lit(1)})
    dealt = own.unionByName(every).select("s", "part", "other", "node", "root", "main", "n", "known").repartition("s", "part").sortWithinPartitions("s", "part", "other")
    return pairs, mapped(dealt, _compared(percent), "a long, b long").distinct()


def _compared(percent: int):
    """Rows (s, part, other, node, root, main, n, known) sorted by s, part, other -> links (a, b) of rows with other = 0 and those with other = 1 behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, index = None, [], None
        for batch in batches:
            key = [np.asarray(batch.column(c)) for c in ("s", "part", "other")]
            new = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in key])]))
            for i, j in zip(new.tolist(), [*new[1:].tolist(), len(batch)]):
                rows = batch.slice(i, j - i)
                if now != (key[0][i], key[1][i]):
                    now, own, index = (key[0][i], key[1][i]), [], None
                if not key[2][i]:
                    own.append(rows)
                elif own:
                    index = index or _Crowd(pa.Table.from_batches(own).combine_chunks().to_batches()[0], percent)
                    for part in slices(rows, 64 << 10):
                        a, b = index.links(part)
                        if len(a):
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


class _Crowd:
    """Nodes by the shingles that they share with others, to be held against further nodes."""

    def __init__(self, rows: pa.RecordBatch, percent: int) -> None:
        self.percent = percent
        self.node, self.root, self.n = (np.asarray(rows.column(c)).astype(np.int64) for c in ("node", "root", "n"))
        tokens, of = _flat(rows)
        order = np.argsort(tokens, kind="stable")
        self.tokens, first = np.unique(tokens[order], return_index=True)
        self.of, self.at = of[order], np.append(first, len(order))

    def links(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a node here and one of the rows that have the share in common, and different roots."""
        node, root, main, n = (np.asarray(rows.column(c)).astype(np.int64) for c in ("node", "root", "main", "n"))
        tokens, of = _flat(rows)
        place = np.searchsorted(self.tokens, tokens)
        there = place < len(self.tokens)
        there[there] = self.tokens[place[there]] == tokens[there]
        place, of = place[there], of[there]
        size = self.at[place + 1] - self.at[place]
        mine = self.of[np.repeat(self.at[place] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        common = np.bincount(np.repeat(of, size) * len(self.node) + mine, minlength=len(node) * len(self.node)).reshape(len(node), -1)
        near = 100 * common >= self.percent * (n[:, None] + self.n - common)
        j, i = np.nonzero(near & (root[:, None] != self.root) & ((root == main)[:, None] | (node[:, None] < self.node)))
        return self.node[i], node[j]


def _flat(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all rows, and the row of each."""
    known = rows.column("known")
    return np.asarray(known.flatten()), np.repeat(np.arange(len(rows)), np.asarray(pc.list_value_length(known)))


def near_groups(docs: DataFrame, shingle: int = 3, percent: int = 85, doc_id: str = "doc_id", text: str = "text", empty_alike: bool = False, likely: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the size of its set, and the smallest doc_id it can reach over links.

    Two rows link where their sets of distinct shingles have at least that per cent of
    their union in common. Words are lower-cased for A-Z only; a text with fewer words
    than a shingle has its whole word sequence as the one shingle. A null text, or one
    without words, has the empty set and links with nothing (with empty_alike, with others
    of that kind). Rows that repeat a doc_id
    with another text are that document too, and link through it. A row without a
    doc_id takes no part: its component is null. No rows give no rows.

    likely: pairs (a, b) of ids that another method found, as fingerprints do. They are held
    against the bound first, and what they join is not compared again.

    Equal sets are one node. The result is written; what was written on the way goes.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "near_groups")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with scratch(spark):
        _groups(rows, shingle, percent, empty_alike, likely).write.parquet(path)
    return spark.read.schema("doc_id long, n_shingles long, component_id long").parquet(path)


def similar_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, likely: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id) of each id, for a stage that keeps one document of each group: texts without words are copies of each other; rows without an id are left out."""
    found = near_groups(docs, shingle, percent, empty_alike=True, likely=likely).where("doc_id is not null")
    return found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def _pairs(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes the links do not join yet."""
    roots = written(components(links), "roots")
    side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where("root_a is null or root_b is null or root_a != root_b").select("a", "b")


def _groups(docs: DataFrame, shingle: int, percent: int, empty_alike: bool, likely: DataFrame | None = None) -> DataFrame:
    tables = n_tables(percent)
    rows = written(mapped(docs, _signed(shingle, tables), SIGNED_DDL), "signed")
    known = rows.where("doc_id is not null" if empty_alike else "doc_id is not null and n > 0")
    nodes = written(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("halves").alias("halves")), "nodes")
    names = nodes.select("s1", "s2", "node")
    ids = known.select("doc_id", "s1", "s2").distinct()
    several = ids.groupBy("doc_id").count().where("count > 1").select("doc_id")
    own = ids.join(several, "doc_id").join(names, ["s1", "s2"]).select(*_pairs("doc_id", "node")).where("a != b")

    keys = written(table_keys(nodes, tables), "keys")
    buckets = keys.groupBy("key").agg(F.count("*").alias("size"), F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub"), F.min("node").alias("least")).where("size > 1")
    members = written(keys.select("key", "node").join(buckets.drop("size"), "key"), "members")
    wanted, first = members.select("node"), own
    if likely is not None:
        node = ids.join(names, ["s1", "s2"]).select("doc_id", "node")
        side = lambda x: node.select(F.col("doc_id").alias(x), F.col("node").alias(f"node_{x}"))
        likely = likely.join(side("a"), "a").join(side("b"), "b").select(*_pairs("node_a", "node_b")).where("a != b").distinct()
        likely = written(likely, "likely")
        wanted = wanted.unionByName(likely.select(F.explode(F.array("a", "b")).alias("node")))
    sets = written(_sets_of(docs.where("doc_id is not null"), wanted.distinct(), names, shingle), "sets")
    tried = members.select("node", F.explode(F.array("hub", "least")).alias("other")).where("node != other").select(*_pairs("node", "other")).distinct()
    if likely is not None:
        first = written(similar(likely, sets, percent).unionByName(own), "links")
        tried = _apart(tried.join(likely, ["a", "b"], "left_anti"), first)
    tried = written(tried, "tried")
    links = written(similar(tried, sets, percent).unionByName(first), "links")

    placed = members.select("key", "node").join(components(links), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    placed = written(placed, "placed")
    apart = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("z")).where("x != z")
    left = placed.join(apart, "key", "left_semi").select("node", "root").distinct()
    pairs, more = prefix_links(sets.join(left, "node"), percent)
    pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(written(similar(pairs, sets, percent).unionByName(more), "links"))
    roots = names.join(components(links), "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("component"))

    found = rows.select("doc_id", "s1", "s2", "n").join(roots, ["s1", "s2"], "left")
    # a text without words has no node: it is reached through the other texts of its id alone
    reach = found.where("component is not null and doc_id is not null").groupBy("doc_id").agg(F.min("component").alias("component_id"))
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(reach, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def kept(doc_id: str = "doc_id", component_id: str = "component_id") -> F.Column:
    """Whether a row stays: those of a component's smallest id do, and those without an id."""
    return F.coalesce(F.col(doc_id) == F.col(component_id), F.lit(True))
