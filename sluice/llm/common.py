"""Helpers shared by the corpus operators: written tables, Arrow text mapping, word spans.

Words here are maximal runs of bytes other than ASCII white space (space and
0x09-0x0D), taken from the UTF-8 form of a text; a null text has no words.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="sluice-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_within: ContextVar[str | None] = ContextVar("scratch", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_within.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write inside are deleted at its end; what depends on them must be written elsewhere by then."""
    path = new_path(spark, "scratch")
    token = _within.set(path)
    try:
        yield
    finally:
        _within.reset(token)
        remove(spark, path)


#: Bytes of a row group of written tables, which a task holds until it is whole.
ROW_GROUP = 32 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    return written_to(df, new_path(df.sparkSession, name))


def written_to(df: DataFrame, path: str) -> DataFrame:
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(name: str, df: DataFrame) -> str:
    """A column name that df does not have, in any case."""
    taken, name = {c.lower() for c in df.columns}, f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column name that may hold dots and backticks, for F.col."""
    return "`" + name.replace("`", "``") + "`"


def plain_names(docs: DataFrame, *used: str, without: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """docs with all columns but the used ones renamed by their place, so that none clashes with an operator's own; and the names they had.

    Columns named in `without` are left out.
    """
    names = [c for c in docs.columns if c not in without or c in used]
    return docs.select(*(F.col(quoted(c)).alias(c if c in used else f"__c{i}") for i, c in enumerate(names))), names


def least_hashed(rows: DataFrame, key: list[str], n: int, total: int) -> DataFrame:
    """n rows (all, if there are fewer) of distinct keys: those of least hash, the same in every run.

    total is the number of rows. A bound on the hash leaves about 4 n of them before any
    are sorted, so that what meets in one task does not follow the table.
    """
    h = F.pmod(F.xxhash64(*key), F.lit(1 << 40))
    bound = 1 << 40 if total <= 4 * n else int((1 << 40) * 4 * n / total)
    return rows.withColumn("__h", h).where(F.col("__h") < bound).orderBy("__h", *key).limit(n).drop("__h")


def give_back() -> None:
    """Return the memory that freed arrays have left with the allocators of this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has one
    if trim:
        trim(0)


#: Spark's setting for the bytes of a batch that goes to a Python worker, what it is unless someone sets it, and what these operators set then.
BATCH_BYTES, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of the session by BATCH bytes, where nobody has set a bound: both sides of each task hold a batch, and texts are long."""
    if spark.conf.get(BATCH_BYTES, None) == BATCH_DEFAULT:
        spark.conf.set(BATCH_BYTES, BATCH)


_kept: dict = {}
_used: set = set()


def kept(key, make: Callable):
    """What a worker keeps from task to task: make() once, until a task of `mapped` ends that has not used it.

    So the tables of one operator are not still there when a worker goes on with another.
    """
    if key not in _kept:
        _kept[key] = make()
    _used.add(key)
    return _kept[key]


# Functions of this module reach a worker by name; a function inside another takes copies of the tables that it names along.


def _begin() -> None:
    _used.clear()


def _end() -> None:
    for key in _kept.keys() - _used:
        del _kept[key]
    give_back()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema), where a task leaves no unused memory with its Python worker, which waits for further tasks."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        yield from run(batches)
        _end()

    small_batches(df.sparkSession)
    return df.mapInArrow(of_task, schema)


def add_columns(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    drop: tuple[str, ...] = (),
    most: int = 2 << 20,
) -> DataFrame:
    """df with columns computed batch by batch; a column of the same name is replaced, `drop` goes.

    make() runs once in each task and returns the function from a batch of about `most`
    bytes to the new arrays.
    """
    odd = {c: f"__odd{i}" for i, c in enumerate(df.columns) if "." in c or "`" in c}
    if odd:  # mapInArrow can't name these
        out = add_columns(df.toDF(*(odd.get(c, c) for c in df.columns)), fields, make, tuple(odd.get(c, c) for c in drop), most)
        names = {v: c for c, v in odd.items()}
        return out.toDF(*(names.get(c, c) for c in out.columns))
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new and f.name not in drop]
    schema = T.StructType([*kept, *fields])
    names, types = [f.name for f in kept], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, most):
                made = [a if a.type == t else a.cast(t) for a, t in zip(f(part), types)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], [*names, *(x.name for x in fields)])

    return mapped(df, run, schema)


def slices(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes, so that memory follows neither text nor batch length."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * most / max(batch.nbytes, 1)))
    for i in range(0, n, step):
        yield batch.slice(i, min(step, n - i))


def joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of about `most` bytes, however small or large they come."""
    waiting, size = [], 0

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    for batch in batches:
        for part in slices(batch, most):
            if waiting and size + part.nbytes > most:
                yield whole()
                waiting, size = [], 0
            waiting.append(part)
            size += part.nbytes
    if waiting:
        yield whole()


class Remembered:
    """What has been computed for a key, in two generations of about `most` keys each; keys of over `longest` live for one call."""

    def __init__(self, most: int, longest: int = 256) -> None:
        self.now, self.before, self.long, self.most, self.longest = {}, {}, [], most, longest

    def of(self, lists: list[list], compute: Callable[[list], list]) -> dict:
        """A table with all keys of the lists; compute(keys) gives the values of those not seen lately."""
        for k in self.long:
            del self.now[k]
        if len(self.now) > self.most:
            self.before, self.now = self.now, {}
        now, before, missing = self.now, self.before, []
        for k in {k for keys in lists for k in keys if k not in now}:
            v = before.get(k)
            if v is None:
                missing.append(k)
            else:
                now[k] = v
        now.update(zip(missing, compute(missing)))
        self.long = [k for k in missing if len(k) > self.longest]
        return now


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, nulls as empty, and its n + 1 offsets."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of each word, a longest run of bytes that `space` (by byte) does not have."""
    solid = np.zeros(len(raw) + 1, bool)
    np.logical_not(space[raw], out=solid[:-1])
    edge = np.zeros(len(raw) + 1, bool)  # a row begins here
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:]
    last = solid[:-1] & (~solid[1:] | edge[1:])
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def gathered(values: list[bytes], number: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers packed in values[number], one after the other, and where those of each run of `number` begin (and the last end); at: the runs."""
    sizes = packed_sizes(values)
    begin, of = np.cumsum(sizes) - sizes, sizes[number]
    total = np.zeros(len(number) + 1, np.int64)
    np.cumsum(of, out=total[1:])
    kind = np.int32 if max(total[-1], begin[-1] if len(begin) else 0) < 1 << 31 else np.int64
    place = np.repeat((begin[number] - total[:-1]).astype(kind), of)
    place += np.arange(total[-1], dtype=kind)
    return np.frombuffer(b"".join(values), "<u4")[place], total[at]


def packed_sizes(values: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, values), np.int64, len(values)) // 4


ODD = np.uint64(0x9E3779B97F4A7C15)
ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def range_sums(values: np.ndarray, base: np.uint64, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """sum of values[i] * base ** (i - first) over i from first to end, modulo 2 ** 64."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:], dtype=np.uint64)
    return (total[end] - total[first]) * powers(inverse(base), n + 1)[first]


_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of eight


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit number for each word, a function of its bytes alone: each eight bytes are mixed with their place, and summed."""
    size = ends - starts
    n = np.maximum((size + 7) >> 3, 1)
    first = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(first, n)
    at = np.repeat(starts, n) + 8 * place
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)[at].view("<u8").ravel()
    eight &= _FIRST[np.minimum(np.repeat(ends, n) - at, 8)]
    place += 1
    eight = mixed(eight ^ place.view(np.uint64) * ODD)
    return mixed((np.add.reduceat(eight, first) if len(n) else eight) + size.view(np.uint64) * ODD2)


#: Partial sums meet in so many groups before the last one.
GROUPS = 16


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of part(batch), an array of `size` doubles.

    Each task sends one array; they are added group-wise, then together.
    """

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slot = np.zeros(size), TaskContext.get().partitionId() % GROUPS
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()])], ["slot", "total"])

    def of_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column("total").to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()])], ["slot", "total"])

    ddl = "slot int, total binary"
    sums = mapped(mapped(mapped(rows, of_task, ddl).repartition(GROUPS, "slot"), of_group, ddl).coalesce(1), of_group, ddl)
    return np.frombuffer(sums.collect()[0].total)
