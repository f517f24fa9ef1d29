"""What the operators of this subpackage have in common."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.sources import tables

#: Tables whose rows take long.
SPREAD = ("documents", "pages", "embeddings", "conversations")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster without it this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pageloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, as a URI: a folder named without a scheme is where Spark would look for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def free_name(wanted: str, *frames: DataFrame) -> str:
    """``wanted``, made longer until no frame has a column of that name in any letter case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def core(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns of the rows that have a ``doc_id``, which becomes a long; null texts become empty."""
    own = {"text": F.coalesce(F.col("text"), F.lit("")).alias("text"), "doc_id": F.col("doc_id").cast("long").alias("doc_id")}
    out = [own.get(c, F.col(c)) for c in columns]
    return docs.where(F.col("doc_id").isNotNull()).select(*out)


def table(sf_dir: str, name: str, spark: SparkSession) -> DataFrame:
    """A table; one in fewer splits than the session has cores is spread over them, as ``tables.spread`` tells."""
    return tables.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")) if name in SPREAD else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of the schema's columns, which may be lists, numpy or Arrow arrays."""
    arrays = [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema]
    return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


def buckets_for(total: int, each: int) -> int:
    """Number of hash buckets that hold about ``each`` items of ``total``."""
    return max(1, -(-total // each))


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Where a URI of ``new_path`` is, on the driver as on any executor; other paths are local ones."""
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


#: The C library's way to return free memory, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Returns this process's free memory to the system.

    Workers live on from one task and stage to the next, and would keep the most that any of them needed.
    """
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def freed(function: Callable) -> Callable:
    """``function`` of ``mapInArrow``, or of (key, table) or (key, table, table) of ``applyInArrow``, with ``release`` after it."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release()

    def group_of(key: tuple, group: pa.Table) -> pa.Table:
        out = function(key, group)
        release()
        return out

    def groups_of(key: tuple, first: pa.Table, second: pa.Table) -> pa.Table:
        out = function(key, first, second)
        release()
        return out

    return (batches_of, group_of, groups_of)[function.__code__.co_argcount - 1]


#: Stored tables that exist, and where; what is left when the driver ends goes then.
_STORED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_LEFT: set[str] = set()
#: Has Spark remove the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once into a Parquet table of the shared folder, so that lost executors don't lose it.

    What reads it reads only the columns it needs.  ``discard`` removes it, or else the end of the driver.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        # a new frame, planned under that setting
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.parquet(path)
    _STORED[out] = path
    _LEFT.add(path)
    return out


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder that goes with the driver."""
    path = new_path(spark, name)
    where, local = file_system(path)
    where.create_dir(local)
    _LEFT.add(path)
    return path


def discard(*stored: DataFrame) -> None:
    """Removes tables of ``store`` that nothing will read any more."""
    for df in stored:
        if path := _STORED.pop(df, None):
            _remove(path)


def _remove(path: str) -> None:
    _LEFT.discard(path)
    where, local = file_system(path)
    try:
        where.delete_dir(local)
    except OSError:
        pass


@atexit.register
def _remove_all() -> None:
    for path in list(_LEFT):
        _remove(path)
