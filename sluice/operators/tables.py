"""Replacing, merging and publishing tables on plain Parquet."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.contracts import evolve_union


#: How tables are compressed: ids in hex have half their bytes by it, and all of them by Spark's usual codec.
CODEC = {"compression": "zstd"}


class MergeError(ValueError):
    """A merge source has a null key, or one key twice."""


def replace_where(target: DataFrame | None, new: DataFrame, predicate: str) -> DataFrame:
    """target without the rows of the predicate, and all rows of new; columns of either side are kept.

    A null predicate does not match. new is checked as it is read: a row of it that does not
    match fails the job, without a target too. Running it again gives the same table.
    """
    match = F.coalesce(F.expr(predicate), F.lit(False))
    checked = new.where(F.when(match, True).otherwise(F.raise_error(F.lit(f"a new row does not match: {predicate}")).cast("boolean")))
    return checked if target is None else evolve_union(target.where(~match), checked)


def check_source(source: DataFrame, keys: Sequence[str]) -> None:
    """An error unless every key is whole and stands once."""
    null = F.greatest(*(F.col(k).isNull() for k in keys), F.lit(False))
    bad = source.groupBy(*keys).agg(F.count("*").alias("n")).where(null | (F.col("n") > 1)).limit(1).collect()
    if bad:
        raise MergeError(f"key {[bad[0][k] for k in keys]} stands {bad[0]['n']} times" if bad[0]["n"] > 1 else f"null in key {list(keys)}")


def merge_upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_when: str | None = None,
    delete_unmatched_where: str | None = None,
    checked: bool = False,
) -> DataFrame:
    """target with source merged in: matched rows are updated where update_when holds, others inserted.

    update_when sees both sides as t and s; null means no update. Target rows without a
    match stay, or go where delete_unmatched_where (over t) holds. source must have
    each key once and no null in it; that is checked unless `checked` says that each key
    stands once. A null that is let in so is a key like others, so that merging the same
    source again changes nothing.
    Columns are the target's, then those that only the source has. One full outer join;
    give it only the partitions of the target that the source touches.
    """
    if not checked:
        check_source(source, keys)
    t = target.withColumn("__t", F.lit(True)).alias("t")
    s = source.withColumn("__s", F.lit(True)).alias("s")
    on = None
    for k in keys:
        same = F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
        on = same if on is None else on & same
    joined = t.join(s, on, "full_outer")
    here, there = F.col("t.__t").isNotNull(), F.col("s.__s").isNotNull()
    update = F.coalesce(F.expr(update_when), F.lit(False)) if update_when else F.lit(True)
    if delete_unmatched_where:
        joined = joined.where(there | ~F.coalesce(F.expr(delete_unmatched_where), F.lit(False)))
    take = there & (~here | update)

    def column(c: str) -> Column:
        if c not in source.columns:
            return F.col(f"t.{c}")
        if c not in target.columns:
            return F.when(take, F.col(f"s.{c}")).alias(c)
        return F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)

    return joined.select(*(column(c) for c in target.columns), *(column(c) for c in source.columns if c not in target.columns))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete what is at path, if anything is."""
    fs, place = _fs(spark, path)
    fs.delete(place, True)


def publish(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """df as the whole table at path: written beside it, then swapped in, so that df may read path.

    A failed write leaves the old table. Rows go by partition column to their writer,
    and a large partition to several, as Spark splits what it rebalances.
    """
    spark = df.sparkSession
    fs, final = _fs(spark, path)
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    writer = (df.hint("rebalance", *partition_by) if partition_by else df).write.options(**CODEC)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    new = spark._jvm.org.apache.hadoop.fs.Path(staged)
    fs.mkdirs(final.getParent())
    had = fs.exists(final)
    if had and not fs.rename(final, old):
        raise OSError(f"could not set aside {path}")
    if not fs.rename(new, final):
        if had:
            fs.rename(old, final)
        raise OSError(f"could not publish {path}")
    if had:
        fs.delete(old, True)


@contextmanager
def _moves(fs) -> Iterator[Callable]:
    """A function that renames; if anything fails before the end, what it has renamed goes back."""
    done: list[tuple] = []

    def move(a, b) -> None:
        if not fs.rename(a, b):
            raise OSError(f"could not rename {a} to {b}")
        done.append((a, b))

    try:
        yield move
    except BaseException:
        for a, b in reversed(done):
            fs.rename(b, a)
        raise


def publish_partitions(df: DataFrame, path: str, partition_by: str, touched: DataFrame, made: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Replace the touched partitions (one column, named as partition_by) by the rows of df, which must lie in them.

    made: what is written of df, row by row. It runs behind the shuffle, so that columns which
    it derives, as records in JSON, are not shuffled beside what they are derived from.

    Other partitions are not read or written. A touched partition without rows goes,
    which a dynamic overwrite alone would leave in place. Old partitions are set aside,
    new ones renamed in, and the old deleted when all are in place; if a rename fails,
    what was set aside comes back.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    work = f"{path}.staged-{uuid.uuid4().hex}"
    fs, root = _fs(spark, path)
    child = lambda *names: spark._jvm.org.apache.hadoop.fs.Path("/".join(names))
    try:
        dealt = df.hint("rebalance", partition_by)
        (made(dealt) if made else dealt).write.options(**CODEC).partitionBy(partition_by).parquet(f"{work}/new")
        # Spark names the folders of the touched partitions too
        touched.select(partition_by).distinct().withColumn("touched", F.lit(True)).write.partitionBy(partition_by).parquet(f"{work}/touched")
        filled, names = (_folders(fs, child(work, x)) for x in ("new", "touched"))
        if outside := filled - names:
            raise ValueError(f"rows outside the touched partitions: {sorted(outside)[:3]}")
        fs.mkdirs(root)
        fs.mkdirs(child(work, "old"))
        with _moves(fs) as move:
            for name in sorted(names):
                if fs.exists(child(path, name)):
                    move(child(path, name), child(work, "old", name))
                if name in filled:
                    move(child(work, "new", name), child(path, name))
    finally:
        fs.delete(child(work), True)


def replace_files(new: DataFrame, path: str, predicate: str, partition_by: Sequence[str] = (), order: Sequence[str] = ()) -> None:
    """replace_where on disk: the rows of the predicate go, those of new, which must match it, come.

    Only files that hold a matching row are read whole and written again, which a pushed-down
    filter finds by statistics where it can; the other files keep their names and times. With
    `order` new files hold ranges of these columns, so that later predicates on them hit few.
    If a rename fails, the old files come back. new may read the table, which is made if it
    is not there. Columns that only new has are null in what is rewritten, and missing in files that are not.
    """
    spark = new.sparkSession
    path = path.rstrip("/")
    work = f"{path}.staged-{uuid.uuid4().hex}"
    fs, root = _fs(spark, path)
    place = spark._jvm.org.apache.hadoop.fs.Path
    had = fs.exists(root)
    hit, kept = [], None
    if had:
        table = spark.read.parquet(path)
        uris = [r[0] for r in table.where(predicate).select(F.col("_metadata.file_path").alias("f")).distinct().collect()]
        hit = [place(spark._jvm.java.net.URI(u)) for u in uris]  # names in a path are escaped once more in its URI
        if hit:
            kept = spark.read.schema(table.schema).option("basePath", path).parquet(*(str(h) for h in hit))
    rows = replace_where(kept, new, predicate)
    if order:
        rows = rows.repartitionByRange(*partition_by, *order).sortWithinPartitions(*partition_by, *order)
    elif partition_by:
        rows = rows.hint("rebalance", *partition_by)
    try:
        writer = rows.write.options(**CODEC)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{work}/new")
        if not had:
            fs.mkdirs(root.getParent())
            if not fs.rename(place(f"{work}/new"), root):
                raise OSError(f"could not publish {path}")
            return
        fs.mkdirs(place(f"{work}/old"))
        base = len(str(fs.resolvePath(place(f"{work}/new"))))
        with _moves(fs) as move:
            for k, old in enumerate(hit):
                move(old, place(f"{work}/old/{k}"))
            files = fs.listFiles(place(f"{work}/new"), True)
            while files.hasNext():
                made = files.next().getPath()
                if made.getName().startswith("part-"):
                    final = place(path + str(made)[base:])
                    fs.mkdirs(final.getParent())
                    move(made, final)
    finally:
        fs.delete(place(work), True)


def _folders(fs, place) -> set[str]:
    return {s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()} if fs.exists(place) else set()


def upsert_partitions(new: DataFrame, path: str, keys: Sequence[str], partition: str, update_when: str | None = None) -> None:
    """Merge rows, each key once, into the partitioned table at path, which is made if it is not there.

    new is computed once, beside the table; of the table only the partitions that it touches are read and written.
    """
    spark = new.sparkSession
    if not exists(spark, path):
        return publish(new, path, [partition])
    staged = f"{path.rstrip('/')}.rows-{uuid.uuid4().hex}"
    try:
        new.write.options(**CODEC).parquet(staged)
        new = spark.read.schema(new.schema).parquet(staged)
        touched = new.select(F.col(partition).alias("__touched")).distinct()
        target = spark.read.parquet(path)
        old = target.join(touched, target[partition].eqNullSafe(F.col("__touched")), "left_semi")
        publish_partitions(merge_upsert(old, new, keys, update_when, checked=True), path, partition, new.select(partition))
    finally:
        remove(spark, staged)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share; in local mode, where it is unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
