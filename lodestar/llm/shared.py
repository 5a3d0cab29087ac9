"""Tables in the shared folder, as the operators here use them."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.tables import settle, shared_folder

__all__ = ["batches_of", "hash63", "kept", "settle", "share_bound", "shared_folder", "small", "table", "trim", "trimmed"]

T = TypeVar("T")
_KEPT: dict[str, object] = {}

#: Rows of an id and a digest that are broadcast at most.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(keys: DataFrame) -> DataFrame:
    """Keys to join with: broadcast if they are few, which is counted; else Spark shuffles both sides."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs run within hand Python batches of about ``size`` bytes at most; the session's own limit holds again afterwards.

    Both sides of the pipe hold a batch or two, and the JVM's grow by doubling. A row that is longer is a batch.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hash63(column: str) -> Column:
    """A hash of 63 bits, which shares however small can be taken by."""
    return F.xxhash64(column).bitwiseAND(F.lit((1 << 63) - 1))


def share_bound(wanted: int, of: int) -> int:
    """The bound under which about ``wanted`` of ``of`` hashes of 63 bits lie."""
    return min((1 << 63) - 1, (wanted << 63) // max(1, of))


def kept(kind: str, make: Callable[[], T]) -> T:
    """What tasks of one kind share within a Python worker, such as a cache.

    Workers outlive a job, so what tasks of another kind left is dropped first, and its room
    given back; every kind of task here asks, with something to keep or not.
    """
    if kind not in _KEPT:
        _KEPT.clear()
        gc.collect()
        trim()
        _KEPT[kind] = make()
    return _KEPT[kind]


def trim() -> None:
    """Give room that isn't used any more back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(task: Callable[[Iterator[T]], Iterator[T]]) -> Callable[[Iterator[T]], Iterator[T]]:
    """A task that trims at its end: its worker may lie idle beside tasks of the JVM for a while."""

    def run(batches: Iterator[T]) -> Iterator[T]:
        yield from task(batches)
        trim()

    return run
