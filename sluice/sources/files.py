"""Files of many batches at once, JSON payloads of parallel arrays, and landing manifests."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice.operators.contracts import BreakingSchema, Contract, conform, drift, evolve_union

#: Schemas that are read at a time, each by a small job.
AT_ONCE = 8
#: Bytes of a file that a task holds while it computes the digest.
BLOCK = 4 << 20


class IntegrityError(ValueError):
    """Landed files are missing or not what they were."""


@dataclass
class FileGroup:
    """Files of one schema, and the names (months, partitions) that they stand for."""

    schema: StructType
    names: list[str]
    files: list[str]

    @property
    def types(self) -> dict[str, str]:
        """Column -> type, names in lower case."""
        return {f.name.lower(): f.dataType.simpleString() for f in self.schema}


def list_files(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*.parquet") -> list[str]:
    """The files under folders, or the files themselves; none of them is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load([paths] if isinstance(paths, str) else list(paths))
    return sorted(r.path for r in found.select("path").collect())


def month_of(name: str) -> str | None:
    found = re.search(r"[0-9]{4}-[0-9]{2}", name.rpartition("/")[2])
    return found and found[0]


def file_groups(spark: SparkSession, files: Mapping[str, Sequence[str]]) -> list[FileGroup]:
    """Files by schema, from their footers alone, which tasks read; files: name -> the files that it stands for.

    What stands together under a name is looked at together, and file by file where its types differ.
    """

    def schema_of(some: Sequence[str]) -> StructType:
        return spark.read.option("mergeSchema", "true").parquet(*some).schema

    def of_name(name: str) -> list[tuple[StructType, str, list[str]]]:
        some = list(files[name])
        try:
            return [(schema_of(some), name, some)]
        except (PySparkException, Py4JJavaError):  # types of a name that do not merge
            if len(some) == 1:
                raise
            return [(schema_of([f]), name, [f]) for f in some]

    groups: dict[str, FileGroup] = {}
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for schema, name, some in (x for found in pool.map(of_name, sorted(files)) for x in found):
            group = groups.setdefault(schema.simpleString(), FileGroup(schema, [], []))
            group.names.append(name)
            group.files += some
    return list(groups.values())


def check_groups(groups: Sequence[FileGroup], contract: Contract) -> None:
    """An error that names each month or partition that breaks the contract, and why; raised before any row is read."""
    broken = [f"{', '.join(dict.fromkeys(g.names))}: {why}" for g in groups for why in drift(contract, g.types).breaking]
    if broken:
        raise BreakingSchema(f"{contract.name} is broken by " + "; ".join(broken))


def read_batches(spark: SparkSession, paths: str | Sequence[str], contract: Contract | None = None) -> DataFrame:
    """Parquet files of months, with _batch_id (the YYYY-MM in the file's name, else null) and _source_file.

    Months may have different schemas: files are read by groups of one schema, each brought
    to the contract, and united; a column that only some have is null in the others. Without a
    contract a column of several types takes the one that the others convert into. A month
    that breaks the contract is an error that names it, before any row is read.
    """
    files: dict[str, list[str]] = {}
    for f in list_files(spark, paths):
        files.setdefault(month_of(f) or "no month", []).append(f)
    if not files:
        raise FileNotFoundError(f"no Parquet files in {paths}")
    groups = file_groups(spark, files)
    if contract:
        check_groups(groups, contract)
    name = F.col("_metadata.file_name")
    month = F.regexp_extract(name, r"([0-9]{4}-[0-9]{2})", 1)
    out = None
    for g in groups:
        rows = spark.read.schema(g.schema).parquet(*g.files).select("*", F.when(month != "", month).alias("_batch_id"), name.alias("_source_file"))
        rows = conform(rows, contract)[0] if contract else rows
        out = rows if out is None else evolve_union(out, rows)
    rest = [c for c in out.columns if c not in ("_batch_id", "_source_file")]
    return out.select(*(F.col(f"`{c}`") for c in rest), "_batch_id", "_source_file")


def read_evolved(spark: SparkSession, path: str, partition: str = "_batch_id") -> DataFrame:
    """A table that is partitioned by one column (text), whose partitions may have different columns and types, united as by evolve_union."""
    return _united(spark, path, table_groups(spark, path), partition)


def table_groups(spark: SparkSession, path: str) -> list[FileGroup]:
    """The partitions of a table by their schemas."""
    files: dict[str, list[str]] = {}
    for f in list_files(spark, path):
        files.setdefault(unquote(f.rpartition("/")[0].rpartition("/")[2]), []).append(f)
    return file_groups(spark, files)


def _united(spark: SparkSession, path: str, groups: Sequence[FileGroup], partition: str) -> DataFrame:
    out = None
    for g in groups:
        schema = StructType(list(g.schema)).add(partition, "string")
        rows = spark.read.schema(schema).option("basePath", path).parquet(*g.files)
        out = rows if out is None else evolve_union(out, rows)
    if out is None:
        raise FileNotFoundError(f"no Parquet files in {path}")
    return out.select(*(F.col(f"`{c}`") for c in out.columns if c != partition), partition)


def write_batches(df: DataFrame, path: str, batch: str, name: str) -> None:
    """A Parquet file `name`_YYYY-MM.parquet under path for each month in the column `batch`, which is not in it; read_batches reads them.

    What a failed run has written beside the folder goes.
    """
    spark = df.sparkSession
    work = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.repartition(batch).write.partitionBy(batch).parquet(work)
        fs.mkdirs(place(path))
        for folder in fs.listStatus(place(work)):
            month = folder.getPath().getName().partition("=")[2]
            for k, f in enumerate(x for x in fs.listStatus(folder.getPath()) if x.getPath().getName().startswith("part-")) if folder.isDirectory() else ():
                if not fs.rename(f.getPath(), place(f"{path}/{name}_{month}{f'.{k}' if k else ''}.parquet")):
                    raise OSError(f"could not land {name} of {month}")
    finally:
        fs.delete(place(work), True)


def parallel_arrays_to_rows(df: DataFrame, index: str, fields: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """A row for each entry of the array `index`, with the entries of the other arrays at its place.

    fields: array name -> type. A short, null or missing array gives nulls; what is
    longer than the index is cut. A null or empty index is an error when it is read.
    """
    whole = F.when(F.size(F.coalesce(F.col(index), F.array())) > 0, F.col(index)).otherwise(F.raise_error(F.lit(f"a payload has no {index}")))
    arrays = [whole.alias("__i"), *((F.coalesce(F.col(f), F.array()) if f.split(".")[0] in df.columns else F.array()).cast(f"array<{t}>").alias(f"__{k}") for k, (f, t) in enumerate(fields.items()))]
    rows = df.select(*keep, *arrays)
    zipped = F.arrays_zip("__i", *(f"__{k}" for k in range(len(fields))))
    rows = rows.select(*keep, F.size("__i").alias("__n"), F.posexplode(zipped).alias("__at", "__x")).where("__at < __n")
    name = lambda f: f.split(".")[-1]
    return rows.select(*keep, F.col("__x.__i").alias(name(index)), *(F.col(f"__x.__{k}").alias(name(f)) for k, f in enumerate(fields)))


def read_payloads(spark: SparkSession, path: str, schema: str, index: str, fields: Mapping[str, str]) -> DataFrame:
    """parallel_arrays_to_rows over JSON files, one payload a file."""
    return parallel_arrays_to_rows(spark.read.schema(schema).json(path, multiLine=True), index, fields)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (path, bytes) -> (name, sha256, bytes): each file is read in blocks into a running digest."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    for batch in batches:
        for path, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist()):
            # Spark gives paths as they are, not as URIs: a % in a name is no escape
            local = path.startswith("file:")
            fs, place = (LocalFileSystem(), "/" + path[5:].lstrip("/")) if local else FileSystem.from_uri(quote(path, safe=":/@"))
            digest = hashlib.sha256()
            with fs.open_input_stream(place, compression=None) as f:
                while block := f.read(BLOCK):
                    digest.update(block)
            yield pa.RecordBatch.from_pydict({"name": [path.rpartition("/")[2]], "sha256": [digest.hexdigest()], "bytes": pa.array([size], pa.int64())})


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """The names of files without a byte, which Spark's file sources pass over; hidden ones are left out, as there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, files = [], place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
    while files.hasNext():
        f = files.next()
        if not f.getLen() and f.getPath().getName()[0] not in "._":
            found.append(f.getPath().getName())
    return found


def manifest(spark: SparkSession, path: str, streamed: bool = True) -> DataFrame:
    """(name, sha256, bytes) of each file under path, of any size, empty ones too.

    The files are listed by Spark and dealt to tasks one by one; a task reads a file in
    blocks of BLOCK bytes, with the file systems that Arrow knows (local or mounted, S3,
    GCS, HDFS). streamed=False reads with Spark's own file source, which reaches every
    store that Spark does but holds a file whole and refuses those of 2 GB and more.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    empty = spark.createDataFrame([(n, hashlib.sha256().hexdigest(), 0) for n in _empty_files(spark, path)], "name string, sha256 string, bytes long")
    if not streamed:
        return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).unionByName(empty)
    # by the path, so that a large file is not behind others that happen to be listed with it
    return files.select("path", F.col("length").alias("bytes")).repartition("path").mapInArrow(_digests, "name string, sha256 string, bytes long").unionByName(empty)


def manifest_mismatches(recorded: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Recorded files (keys) that are missing or changed, with problem; new files are none."""
    now = fresh.select(*keys, F.col("sha256").alias("__now"))
    both = recorded.join(now, list(keys), "left")
    problem = F.when(F.col("__now").isNull(), "missing").when(~F.col("sha256").eqNullSafe(F.col("__now")), "changed")
    return both.select(*keys, problem.alias("problem")).where("problem is not null")


def verify_manifest(recorded: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("name",)) -> None:
    """An error that names the first files that are missing or changed."""
    if bad := manifest_mismatches(recorded, fresh, keys).orderBy(*keys).take(5):
        raise IntegrityError("; ".join(f"{r[keys[-1]]}: {r.problem}" for r in bad))


def land_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a landed folder, written beside it as <folder>.manifest before anything reads the files, and read back."""
    to = f"{path.rstrip('/')}.manifest"
    manifest(spark, path).write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)
