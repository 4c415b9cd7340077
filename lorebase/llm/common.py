"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word characters of every word-based contract: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table of that name; a file or a directory of files."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_local_root: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder name that driver and executors can all reach.

    It lies in ``spark.checkpoint.dir``. Where that is unset in a local session,
    as in tests, it lies in a temporary folder of this process; elsewhere that is
    an error, as executors can't see the driver's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        if not _local_root:
            _local_root.append("file://" + tempfile.mkdtemp(prefix="lorebase-"))
        root = _local_root[0]
    return f"{root.rstrip('/')}/lorebase-{uuid.uuid4().hex}"


_scratch: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged meanwhile by this thread are removed at the end, unless staged to be kept."""
    paths: list[str] = []
    token = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(token)
        remove(spark, paths)


@contextlib.contextmanager
def rows_per_batch(spark: SparkSession, n: int) -> Iterator[None]:
    """Jobs run meanwhile hand at most ``n`` rows at a time to Python: for wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def releasing(work):
    """``work`` for ``mapInArrow``; a worker lives on after a task, so it hands back what the task has freed."""

    @functools.wraps(work)
    def run(batches):
        import ctypes

        import pyarrow as pa

        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def remove(spark: SparkSession, paths: list[str]) -> None:
    for x in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts the lineage: work that several later branches need is done once,
    and a lost executor costs only the reading of files. With ``keep`` the table
    outlives the ``scratch`` that it is made in.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    paths = _scratch.get()
    if paths is not None and not keep:
        paths.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing will read any more."""
    for x in tables:
        remove(x.sparkSession, [x._staged_at])


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"__{name}_{uuid.uuid4().hex}"


#: Bits of the filter of ``divided``, a bound of what it broadcasts.
FILTER_BITS = 1 << 24


def divided(frame: DataFrame, keys: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``frame`` that aren't among ``keys``, rows that may be) by the columns
    of both that bear those names. ``keys`` is a staged table; a filter of a fixed
    size is made of it, so only the second part has to travel for an exact join."""
    place = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    at, bits = fresh("at"), fresh("bits")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.groupBy(F.shiftright(place, 6).alias(at)).agg(F.bit_or(bit).alias(bits))
    met = frame.join(F.broadcast(words), F.shiftright(place, 6) == F.col(at), "left")
    may = F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False))
    return met.where(~may).select(*frame.columns), met.where(may).select(*frame.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
