"""Helpers that the training-data operators share.

Every operator first projects its input to the columns it needs under private
names, so extra columns of the input, whatever they are called, cannot clash.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table of a data folder, read through Spark's own file systems."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a local one if it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="loomstead-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/loomstead/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """Write a frame to the shared folder and read it again.

    This cuts the lineage: a lost executor costs no recomputation of what came before.
    """
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back(collect: bool = True) -> None:
    """Return a Python worker's freed memory to the system, so idle workers stay small beside the next stage."""
    import pyarrow

    if collect:
        gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def by_size(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of rows whose sizes come to ``most`` at most; a larger row is alone."""
    begin, held = 0, 0
    for k, n in enumerate(sizes):
        if k > begin and held + n > most:
            yield slice(begin, k)
            begin, held = k, 0
        held += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map over batches that gives its memory back when a task ends."""

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


#: Groups that this Python worker has worked on.
_GROUPS = {"done": 0}


def tidy_group(work: Callable) -> Callable:
    """A function of a group (or of a key and one or two groups) that gives its memory back now and then."""

    def run(*groups):
        _GROUPS["done"] += 1
        try:
            return work(*groups)
        finally:
            if _GROUPS["done"] % 25 == 0:
                give_back(collect=False)

    # Spark counts the parameters.
    by_count = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}
    return by_count[len(inspect.signature(work).parameters)]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_or_empty(text: str = "text") -> Column:
    """The text's UTF-8 bytes; a null text counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def unsigned_crc32(column: Column) -> Column:
    return F.crc32(column).cast("long")
