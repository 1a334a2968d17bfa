"""Approximate nearest neighbours through a permutation index.

Every vector is represented by its nearest pivots in order, a permutation. Each pivot
has an inverted file: the vectors that have it among their POSTED nearest, with its
place in their order. A query opens the files of its own nearest pivots, and what it
finds there is ranked by the footrule distance, the sum of the differences of places; a
pivot that a vector is not posted under counts as one place behind the last. The best
are reranked by inner product. There is a pivot for every PER_PIVOT vectors (up to a
bound), so that files, and what a query finds in them, do not grow with the table up to
there.

The index stands in shards: some vectors with the files of these alone. A task takes
blocks of queries through the shards of a group, one shard after the other, opens files,
ranks and reranks there, and keeps the nearest of each query. Postings and sums of places
so never leave a task; a query has as many rows as it is asked for from each of a fixed
number of groups, which follow the input.

How many files are opened, and how many vectors are reranked (of each shard its share),
follows the data: sample queries are compared with all vectors, and both grow until the
sample's true neighbours are found. If that takes every file, all are compared with all.

Places come from distances, nearness is the inner product. One component more,
sqrt(M * M - |v| * |v|) for vectors and zero for queries (M is the longest length),
makes the order by distance the order by inner product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import joined, mapped, new_path, scratch, written, written_to

#: Vectors for each pivot (pivots are a sample of the vectors, by hash); pivots at most, and their bytes, which every worker has.
PER_PIVOT, MOST_PIVOTS, PIVOT_BYTES = 2, 32_768, 32 << 20
#: Places that are posted; files that a query opens, and vectors that it reranks, at first.
POSTED, OPENED, RERANKED = 32, 64, 4_096
#: Sample queries that are compared with all vectors; recall that they must have together, and each.
PROBED, RECALL, RECALL_EACH = 64, 0.93, 0.5
#: Inner products, and pairs of a query and a vector for exact products, that a task holds at a time.
AT_ONCE, PAIRS = 8 << 20, 1 << 18
#: Bytes of a shard's vectors, and its vectors at most; groups of shards; bytes of a block of queries, its queries at most while there are fewer than BLOCKS.
SHARD_BYTES, SHARD_ROWS, SHARD_GROUPS, BLOCK_BYTES, BLOCK_ROWS, BLOCKS = 16 << 20, 1 << 16, 4, 4 << 20, 512, 8


RESULT_DDL = "query_id long, rank int, vec_id long, score double"


def usable(vector: str = "embedding") -> Column:
    """Not null, not empty, not zero, all components finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length 1: of a query only the direction decides who is near."""
    top = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return top / np.sqrt((top**2).sum(1))[:, None]


def greatest(near: np.ndarray, n: int) -> np.ndarray:
    """The columns of the n greatest values of each row in order; ties to the first."""
    rows, m = near.shape
    groups = m // 64
    if groups >= n:
        # The n-th of the groups' greatest has n values at or above it, so the n greatest are among these.
        cut = np.partition(near[:, : groups * 64].reshape(rows, 64, groups).max(1), groups - n, axis=1)[:, groups - n]
        at = np.flatnonzero(near >= cut[:, None])
        if len(at) <= 8 * n * rows:
            row, column = np.divmod(at, m)
            column = column[np.lexsort([column, -near.ravel()[at], row])]
            return column[np.searchsorted(row, np.arange(rows))[:, None] + np.arange(n)]
    best = np.sort(np.argpartition(-near, n - 1, axis=1)[:, :n], axis=1)
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable"), 1)


class Pivots:
    """Pivots in units of the longest vector, and how far the further component of each is below 1."""

    def __init__(self, vectors: np.ndarray, top: float, longest: float) -> None:
        self.top, self.longest = top, longest
        self.vectors, self.low = self._lifted(vectors)

    def scaled(self, vectors: np.ndarray) -> np.ndarray:
        return vectors / self.top / self.longest

    def _lifted(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.scaled(vectors)
        s = np.minimum((x**2).sum(1), 1.0)
        return x.astype(np.float32), (s / (1 + np.sqrt(1 - s))).astype(np.float32)  # 1 - sqrt(1 - s)

    def nearest(self, vectors: np.ndarray, n: int, queries: bool) -> np.ndarray:
        """For each vector its n nearest pivots in order; ties to the first pivot."""
        # All pivots have length 1 with the further component, so the nearest have the greatest inner products.
        n = min(n, len(self.low))
        out = np.empty((len(vectors), n), np.uint16)
        step = max(1, AT_ONCE // len(self.low))
        for i in range(0, len(vectors), step):
            some = vectors[i : i + step].astype(np.float64)
            if queries:
                near = unit(some).astype(np.float32) @ self.vectors.T
            else:
                x, low = self._lifted(some)
                near = x @ self.vectors.T
                near -= np.outer(1 - low, self.low)
            out[i : i + step] = greatest(near, n)
        return out


def _row(names: str, *arrays: np.ndarray) -> pa.RecordBatch:
    """One row that holds arrays as bytes."""
    return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names.split())


def _arrays(batch: pa.RecordBatch, i: int, **kinds) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in kinds.items()]


def _ddl(names: str) -> str:
    return ", ".join(f"{c} binary" for c in names.split())


def _real(df: DataFrame) -> type:
    return np.float32 if df.schema["v"].dataType.elementType.typeName() == "float" else np.float64


SHARD = "entry least v of at first"
BLOCK = "query q wanted"


def _shards(entries: DataFrame, pivots) -> DataFrame:
    """Rows of (entry, least, v), least the smallest id of an entry, as shards: vectors, and of the file of each pivot who stands in it at which place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches, SHARD_BYTES):
            for part in (batch.slice(i, SHARD_ROWS) for i in range(0, batch.num_rows, SHARD_ROWS)):
                v = matrix(part.column("v"))
                near = pivots.value.nearest(v, POSTED, queries=False)
                order = np.argsort(near.ravel(), kind="stable")
                first = np.zeros(len(pivots.value.low) + 1, np.int32)
                np.cumsum(np.bincount(near.ravel(), minlength=len(first) - 1), out=first[1:])
                of, at = np.divmod(order, near.shape[1])
                yield _row(SHARD, np.asarray(part.column("entry")), np.asarray(part.column("least")), v, of.astype(np.uint16), at.astype(np.uint8), first)

    return written(mapped(entries.select("entry", F.element_at("ids", 1).alias("least"), "v"), run, _ddl(SHARD)), "shards")


def _blocks(queries: DataFrame, pivots, opened: int, d: int, n: int) -> DataFrame:
    """n rows of (entry, v) as blocks of queries: vectors, and the nearest pivots of each whose files are opened."""
    most = max(1, BLOCK_BYTES // (8 * d + 2 * opened))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches, BLOCK_BYTES):
            for part in (batch.slice(i, most) for i in range(0, batch.num_rows, most)):
                v = matrix(part.column("v"))
                wanted = pivots.value.nearest(v, opened, queries=True) if opened else np.zeros(0, np.uint16)
                yield _row(BLOCK, np.asarray(part.column("entry")), v, wanted)

    parts = max(-(-n // most), min(BLOCKS, -(-n // BLOCK_ROWS)), 1)
    return written(mapped(queries.select("entry", "v").repartition(parts), run, _ddl(BLOCK)), "blocks")


class Shard:
    """Vectors with the inverted files of these alone."""

    def __init__(self, batch: pa.RecordBatch, i: int, real: type) -> None:
        self.entry, self.least, v, self.of, self.at, self.first = _arrays(batch, i, entry=np.int64, least=np.int64, v=real, of=np.uint16, at=np.uint8, first=np.int32)
        self.v = v.reshape(len(self.entry), -1)

    def found(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Who stands in the files of the wanted pivots, in ascending order, and a number for each: greater is nearer by footrule, ties to the first."""
        lo = self.first[wanted]
        sizes = self.first[wanted + np.uint32(1)] - lo
        where = np.arange(sizes.sum(), dtype=np.int32) + np.repeat(lo - (np.cumsum(sizes, dtype=np.int32) - sizes), sizes)
        place = np.repeat(np.arange(len(wanted), dtype=np.int32), sizes)
        # what a posting saves against a pivot that counts as one place behind the last
        saved = np.bincount(self.of[where], max(len(self.of) // len(self.entry), len(wanted)) + 1 - np.abs(self.at[where] - place), len(self.entry))
        who = np.flatnonzero(saved)
        return who, saved[who] * len(saved) - who

    def ranked(self, wanted: np.ndarray, most: int) -> np.ndarray:
        """The nearest of them by footrule, `most` at most."""
        who, near = self.found(wanted)
        return who if len(who) <= most else who[near >= np.partition(near, len(who) - most)[len(who) - most]]


class Best:
    """The k nearest of each query of a block in the shards it has been through."""

    def __init__(self, names: np.ndarray, vectors: np.ndarray, k: int, pivots: Pivots) -> None:
        self.names, self.v, self.k, self.pivots = names, vectors, k, pivots
        self.x = unit(vectors.astype(np.float64))
        top = np.abs(vectors).max(axis=1).astype(np.float64)
        with np.errstate(over="ignore", under="ignore"):
            # products in units of the greatest that there can be; how far one in single precision is off at most, if none leaves double precision
            self.unit = top * np.sqrt(((vectors / top[:, None]) ** 2).sum(1, dtype=np.float64)) * pivots.top * pivots.longest
        self.off = np.where((self.unit > 1e-250) & (self.unit < 1e300), (vectors.shape[1] + 16) * 2.0**-23, np.inf)
        self.x = self.x.astype(np.float32)
        self.bound = np.full(len(names), -np.inf)
        self.rows = [np.zeros(0, kind) for kind in (np.int64, np.float64, np.int64, np.int64)]  # query's number, minus product, least id, entry

    def search(self, shard: Shard, most: int, wanted: np.ndarray | None) -> None:
        """Rerank the `most` first by footrule; without wanted pivots, compare with the whole shard."""
        x, pairs, n = self.pivots.scaled(shard.v.astype(np.float64)).astype(np.float32), [], 0
        step = max(1, AT_ONCE // len(x))
        for i in range(len(self.names)):
            if wanted is None:
                if i % step == 0:
                    all_near = self.x[i : i + step] @ x.T
                who, near = None, all_near[i % step]
            else:
                who = shard.ranked(wanted[i], most)
                near = x[who] @ self.x[i]
            bound = self.bound[i]
            if bound == -np.inf and len(near) > self.k:
                bound = np.partition(near, len(near) - self.k)[len(near) - self.k] - 2 * self.off[i]
            kept = np.flatnonzero(near >= bound)
            pairs.append((i, kept if who is None else who[kept]))
            n += len(kept)
            if n >= PAIRS:
                self._merge(shard, pairs)
                pairs, n = [], 0
        self._merge(shard, pairs)

    def _merge(self, shard: Shard, pairs: list[tuple[int, np.ndarray]]) -> None:
        query = np.repeat(np.array([i for i, _ in pairs], np.int64), np.array([len(who) for _, who in pairs], np.int64))
        who = np.concatenate([np.zeros(0, np.int64), *(who for _, who in pairs)])
        score, step = np.empty(len(who)), max(1, AT_ONCE // 4 // shard.v.shape[1])
        for i in range(0, len(who), step):
            with np.errstate(over="ignore", invalid="ignore", under="ignore"):
                # added up in order of the components
                each = shard.v[who[i : i + step]].astype(np.float64) * self.v[query[i : i + step]]
                score[i : i + step] = np.add.accumulate(each, axis=1)[:, -1] + 0.0
        query, minus, least, entry = (np.concatenate(both) for both in zip(self.rows, (query, -score, shard.least[who], shard.entry[who])))
        order = np.lexsort([entry, least, minus, query])
        at = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order = order[at < self.k]
        self.rows = [query[order], minus[order], least[order], entry[order]]
        last = at[at < self.k] == self.k - 1
        i = self.rows[0][last]
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            bound = -self.rows[1][last] / self.unit[i] - self.off[i]
        self.bound[i] = np.where(np.isfinite(self.off[i]), bound, -np.inf)


def _search(blocks: DataFrame, shards: DataFrame, pivots, k: int, real: type, depth: int = 0, n: int = 1) -> DataFrame:
    """(query, entry, least, s): the k nearest to each query of those that it looks at, s minus their product.

    These are the first by footrule in its files, of each shard its share of `depth` of n vectors; for blocks
    without places, all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {}
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch, i, real)
                names, q, wanted = _arrays(batch, i, query=np.int64, q=real, wanted=np.uint16)
                if names[0] not in best:
                    best[names[0]] = Best(names, q.reshape(len(names), -1), k, pivots.value)
                best[names[0]].search(shard, -(-depth * len(shard.entry) // n), wanted.reshape(len(names), -1) if len(wanted) else None)
        for b in best.values():
            query, minus, least, entry = b.rows
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (b.names[query], entry, least, minus)], ["query", "entry", "least", "s"])

    # each group of shards with each block in a task of its own
    met = shards.coalesce(SHARD_GROUPS).hint("shuffle_replicate_nl").crossJoin(blocks)
    found = mapped(met, run, "query long, entry long, least long, s double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("s", "least", "entry"))
    return found.withColumn("r", rank).where(F.col("r") <= k).select("query", "entry", "least", "s")


def _ranks(true: pa.Table, block: DataFrame, shards: DataFrame, real: type, n: int) -> np.ndarray:
    """For each true pair (query, entry) of a bounded number of queries the least depth at which the query's files give it, 0 if they don't."""
    pairs = [np.asarray(true.column(c).combine_chunks()) for c in ("query", "entry")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch, i, real)
                names, wanted = _arrays(batch, i, query=np.int64, wanted=np.uint16)
                for name, own in zip(names, wanted.reshape(len(names), -1)):
                    mine = np.flatnonzero(pairs[0] == name)
                    who, near = shard.found(own)
                    is_true = np.isin(shard.entry[who], pairs[1][mine])
                    rank = len(near) - np.searchsorted(np.sort(near), near[is_true])
                    made = np.full(rank.shape, name), shard.entry[who[is_true]], (rank - 1) * n // len(shard.entry) + 1
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], ["query", "entry", "r"])

    met = shards.hint("shuffle_replicate_nl").crossJoin(block)
    found = {(r.query, r.entry): r.r for r in mapped(met, run, "query long, entry long, r long").collect()}
    return np.array([found.get(x, 0) for x in zip(*(p.tolist() for p in pairs))])


def _depth(ranks: np.ndarray, queries: np.ndarray, most: int) -> int | None:
    """The least number of reranked vectors (RERANKED, doubled) with which the sample finds its neighbours; ranks: of these, 0 if not found."""
    depth = RERANKED
    while True:
        hit = (ranks > 0) & (ranks <= depth)
        each = np.array([hit[queries == q].mean() for q in np.unique(queries)])
        if hit.mean() >= RECALL and each.min() >= RECALL_EACH:
            return depth
        if depth >= most:
            return None
        depth *= 2


def nearest(rows: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by `every`, among all other rows.

    Nearness is the inner product of the original vectors in double precision; ties
    go to the smaller id; fewer rows give fewer neighbours. Finite vectors of any size
    take part; a product beyond double precision is infinite, and one that is not a number
    comes last. Rows take no part whose id is null, whose vector is null, zero or has a
    null or non-finite component, or whose vector is not as long as most are (ties: the
    longer). Repeated rows count once; an id with several vectors is not its own
    neighbour. A query that finds fewer than k + 1 vectors in its files is compared with
    all, so that none lacks neighbours. No rows give no rows.

    Equal vectors are searched, indexed and reranked once. A query's list of distinct
    vectors needs no more than the k + 1 smallest ids of each, which is exact.
    """
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "nearest")
    with scratch(spark):
        return written_to(_nearest(rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")), k, every), path)


def _entries(rows: DataFrame, k: int, every: int) -> tuple[DataFrame, DataFrame, int] | None:
    """(v, ids, entry), a numbered entry for each distinct vector, with its k least ids; (v, query_id, entry), the queries; the length of the vectors. None without rows."""
    spark, paths = rows.sparkSession, [new_path(rows.sparkSession, name) for name in ("entries", "asked")]
    real = "float" if rows.schema["v"].dataType.elementType.typeName() == "float" else "double"
    rows = rows.withColumn("v", F.col("v").cast(f"array<{real}>")).where("vec_id is not null").where(usable("v"))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(real))).distinct()  # no negative zeros
    with scratch(spark):
        rows = written(rows, "vectors")
        common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        if common is None:
            return None
        rows = rows.where(F.size("v") == common.n)
        # Spark limits ranks before the shuffle.
        ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k)
        entries = ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.monotonically_increasing_id())
        entries = written_to(entries, paths[0])
        asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
        return entries, written_to(asked.join(entries.select("v", "entry"), "v"), paths[1]), common.n


def _nearest(rows: DataFrame, k: int, every: int) -> DataFrame:
    spark = rows.sparkSession
    made = _entries(rows, k + 1, every)
    if made is None:
        return spark.createDataFrame([], RESULT_DDL)
    entries, asked, d = made
    queries = written(asked.select("entry", "v").dropDuplicates(["entry"]), "queries")
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], RESULT_DDL)
    found = _candidates(entries, queries, n_queries, k + 1, d).join(entries.select("entry", "ids"), "entry")
    lists = found.groupBy("query").agg(F.collect_list(F.struct("s", "ids")).alias("found"))
    flat = F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct(x["s"].alias("s"), i.alias("vec_id")))))
    lists = lists.select(F.col("query").alias("entry"), F.slice(F.array_sort(flat), 1, k + 1).alias("found"))
    rows = asked.select("query_id", "entry").join(lists, "entry").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    rows = rows.select("query_id", F.posexplode("found").alias("i", "x"))
    return rows.select("query_id", (F.col("i") + 1).alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))


def _candidates(entries: DataFrame, queries: DataFrame, n_queries: int, k: int, d: int) -> DataFrame:
    """(query, entry, s): the k nearest found of each query, s minus their product."""
    spark, real = entries.sparkSession, _real(entries)
    x = F.transform("v", lambda x: x.cast("double"))
    size = F.aggregate(x, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    n, top = entries.agg(F.count("*"), F.max(size)).first()
    longest = entries.agg(F.sqrt(F.max(F.aggregate(x, F.lit(0.0), lambda a, x: a + x / top * (x / top))))).first()[0]
    n_pivots = max(1, min(n // PER_PIVOT, MOST_PIVOTS, PIVOT_BYTES // (4 * d)))
    # about so many of least hash, a few more, and of these exactly as many
    h = F.pmod(F.xxhash64("v"), F.lit(1 << 40))
    bound = 1 << 40 if n_pivots < 100 else int((1 << 40) * min(1.0, (n_pivots + 6 * n_pivots**0.5) / n))
    table = entries.select(h.alias("h"), "entry", "v").where(F.col("h") < bound)
    table = (table if n_pivots >= 100 else table.orderBy("h", "entry").limit(n_pivots)).toArrow().combine_chunks()
    order = np.lexsort([np.asarray(table.column(c).combine_chunks()) for c in ("entry", "h")])[:n_pivots]
    held = spark.sparkContext.broadcast(Pivots(matrix(table.column("v").combine_chunks())[order].astype(np.float64), top, longest))
    shards = _shards(entries, held)
    hashed = queries.withColumn("h", F.xxhash64("v", F.lit(1)))
    sample = written(hashed.orderBy("h", "entry").limit(PROBED).select("entry", "v"), "sample")
    true = _search(_blocks(sample, held, 0, d, 1), shards, held, k, real).toArrow().combine_chunks()
    opened = OPENED
    while True:
        ranks = _ranks(true, _blocks(sample, held, opened, d, 1), shards, real, n)
        depth = _depth(ranks, np.asarray(true.column("query").combine_chunks()), n)
        if depth or opened >= n_pivots:
            break
        opened *= 2
    pairs = written(_search(_blocks(queries, held, opened if depth else 0, d, n_queries), shards, held, k, real, depth or n, n), "found")
    # Who found fewer than are asked for looks at all.
    few = pairs.groupBy("query").count().where(F.col("count") >= min(k, n)).select(F.col("query").alias("entry"))
    few = written(queries.join(few, "entry", "left_anti"), "few")
    if n_few := few.count():
        whole = _search(_blocks(few, held, 0, d, n_few), shards, held, k, real)
        pairs = pairs.join(few.select(F.col("entry").alias("query")), "query", "left_anti").unionByName(whole)
    return pairs.select("query", "entry", "s")
