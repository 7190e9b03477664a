"""Shared storage for intermediate and versioned tables.

Lineage is cut by writing a Parquet table in the folder that the session names in
``spark.checkpoint.dir``: every executor sees it, so a lost executor costs only its own tasks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of ``scratch``, of each thread: a stream's batches run beside other work.
_scratch: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())
#: Spark's setting (4.1 and later) by which a query's shuffle files go when it ends, and not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A job over a table goes by slices of about so many of its bytes, SLICES at most.
SLICE_BYTES, SLICES = 48 << 20, 8


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cueloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A folder that is not there yet, in the innermost ``scratch`` folder or else in the shared one."""
    return f"{[shared_dir(spark), *_scratch.get()][-1]}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, mode: str = "error", whole: bool = True) -> None:
    """Write ``df`` as Parquet. What was shuffled for it goes with the write: readers have the table. Unless it is ``whole``, the folder is not marked as written."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode(mode).option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", str(whole).lower()).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """``write`` to a new folder, and the table read back."""
    path = path or new_path(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(spark: SparkSession, path: str) -> int:
    """Into how many slices a job over the table goes; each one reads it through."""
    return max(1, min(SLICES, -(-size(spark, path) // SLICE_BYTES)))


def slice_of(rows: DataFrame, by: str, k: int, n: int) -> DataFrame:
    """The k-th of n slices of rows, by a hash of a column."""
    return rows if n == 1 else rows.filter(F.pmod(F.xxhash64(by), F.lit(n)) == k)


def in_slices(parts: Iterable[DataFrame], path: str) -> DataFrame:
    """Tables of one schema, written one after the other, as one table: only one of them is shuffled at a time."""
    paths, schema, spark = [], None, None
    for k, part in enumerate(parts):
        paths, schema, spark = [*paths, f"{path}/slice-{k}"], part.schema, part.sparkSession
        write(part, paths[-1])
    return spark.read.schema(schema).parquet(*paths)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the files in a folder."""
    files, at = _files(spark, path)
    return files.getContentSummary(at).getLength()


def remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether Spark has marked the folder as written whole."""
    files, at = _files(spark, f"{path}/_SUCCESS")
    return files.exists(at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialized inside go when it ends: what is to stay is written before, to a path from outside."""
    path = new_path(spark, "scratch")
    outer = _scratch.set((*_scratch.get(), path))
    try:
        yield
    finally:
        _scratch.reset(outer)
        remove(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Version:
    number: int
    label: str
    path: str


class Versions:
    """Versions of a table in the folders ``path/v=<number>-<label>``.

    A version counts once Spark has marked its folder as written, so readers see the last whole
    one whatever happens to a writer, and what is there is never changed. The state is in the
    folder alone: another process goes on from it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def whole(self) -> list[Version]:
        """Versions that are written, in order."""
        files, at = _files(self.spark, self.path)
        if not files.exists(at):
            return []
        names = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()]
        found = [(*n.removeprefix("v=").split("-", 1), f"{self.path}/{n}") for n in names if n.startswith("v=")]
        marked = [x for x in found if files.exists(_files(self.spark, f"{x[2]}/_SUCCESS")[1])]
        return sorted((Version(int(n), label, path) for n, label, path in marked), key=lambda v: v.number)

    def last(self) -> Version | None:
        return next(reversed(self.whole()), None)

    def next_path(self, label: str = "") -> str:
        """Where the next version goes."""
        last = self.last()
        return f"{self.path}/v={last.number + 1 if last else 1:09}-{label or uuid.uuid4().hex}"

    def trim(self, keep: int = 2) -> None:
        """Remove all but the last versions; readers may still hold the one before the last."""
        for old in self.whole()[:-keep]:
            remove(self.spark, old.path)
