"""Small helpers that several operators use."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.scratch import scratch_root

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Folders written by :func:`stored` in this process that are not deleted yet.
_written: set[str] = set()


#: With it Spark deletes the shuffle files of a query at its end; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders written since the innermost :func:`scope` of this caller began.
_scope: ContextVar[set[str] | None] = ContextVar("_scope", default=None)


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in folders by a column if asked, and return the table read back.

    This cuts the lineage: a lost executor costs the tasks at hand, not the steps before the table. Results are read
    from such tables when an action runs; :func:`clear` deletes them once the results are written. What the write has
    shuffled is deleted when it ends, so steps don't add up on disk; ``df`` itself stays as it was.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quillmark-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _written.add(path)
    if (mine := _scope.get()) is not None:
        mine.add(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[set[str]]:
    """Tables that are stored inside are deleted at the end, but for those that :func:`keep` has taken out. Results must be
    written or collected by then. Other callers' tables are left alone."""
    mine: set[str] = set()
    token = _scope.set(mine)
    try:
        yield mine
    finally:
        _scope.reset(token)
        for path in mine & _written:
            _delete(spark, path)
            _written.discard(path)


def keep(df: DataFrame) -> DataFrame:
    """``df``, a table made by :func:`stored`, which outlives the scope that it was stored in."""
    for name in {part for file in df.inputFiles() for part in file.split("/") if part.startswith("quillmark-")}:
        mine = _scope.get() or set()
        mine -= {x for x in mine if x.endswith(f"/{name}")}
    return df


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` once nothing reads it any more."""
    for name in {part for file in df.inputFiles() for part in file.split("/") if part.startswith("quillmark-")}:
        for folder in [x for x in _written if x.endswith(f"/{name}")]:
            _delete(df.sparkSession, folder)
            _written.remove(folder)


def clear(spark: SparkSession) -> int:
    """Delete every table that operators of this process have stored, and say how many; call it when their results are
    written or collected."""
    n = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return n


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function over Arrow batches that gives freed memory back to the system at its end.

    Workers serve one task after another; what allocators hold on to would stay with an executor through later steps.
    """

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return tidied


def ascii_lower(text):
    """Lower-case A to Z only, whatever the locale and the other letters."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
