"""Helpers shared by the corpus operators: shared tables and row-wise kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.tables import cut, drop, new_folder

__all__ = ["annotate", "cut", "drop", "new_folder", "once_a_process", "small_batches", "tidy", "with_hash"]

#: Rows and bytes of one Arrow batch: bound a Python worker's memory whatever the texts.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def once_a_process(key: tuple, make: Callable, slot: str | None = None):
    """``make()``, remembered by the Python worker for its later tasks.

    Of one ``slot`` a worker remembers the latest only, so what was made for earlier queries goes.
    """
    import sys
    import types

    held = sys.modules.setdefault("_tidewright_held", types.ModuleType("_tidewright_held")).__dict__
    place = key if slot is None else slot
    if place not in held or (slot is not None and held[place][0] != key):
        held.pop(place, None)
        held[place] = (key, make())
    return held[place][1]


def tidy(rows: Iterator, done: Callable[[], None] = lambda: None) -> Iterator:
    """``rows``; at their end ``done()``, and unused memory goes back to the system.

    Python workers live on between tasks, and allocators keep what they once had.
    """
    import ctypes
    import gc

    try:
        yield from rows
    finally:
        done()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def small_batches(spark: SparkSession) -> None:
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def with_hash(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` with ``_h``, a hash of ``cols``, to join on besides them.

    An aggregated side is dealt by its own keys; joined on one key more, it is
    dealt anew like the other side.  A join between two plain exchanges is one
    whose hot keys Spark can split.
    """
    return df.withColumn("_h", F.xxhash64(*cols))


def annotate(
    df: DataFrame,
    inputs: list[str | Column],
    fields: list[T.StructField],
    make: Callable[[], Callable[..., list[list]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns that a Python kernel computes from ``inputs``, row by row.

    ``make()`` runs once a task and returns the kernel; the kernel gets one list
    per input and returns one list per new field; its attribute ``done``, if it
    has one, is called at the task's end.  All columns of ``df`` (or
    those of ``keep``) pass through as Arrow data; a column that has the name
    of a new field is replaced.  Nothing is shuffled.
    """
    small_batches(df.sparkSession)
    new = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    fed = [F.col(f"`{c}`") if isinstance(c, str) else c for c in inputs]
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(f"__in{i}") for i, c in enumerate(fed)])
    schema = T.StructType([*(source.schema[c] for c in kept), *fields])
    n = len(fed)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        kernel = make()

        def rows() -> Iterator[pa.RecordBatch]:
            for batch in found:
                cols = batch.columns
                made = kernel(*[c.to_pylist() for c in cols[len(kept) : len(kept) + n]])
                arrays = [pa.array(v, type=k) for v, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols[: len(kept)], *arrays], names=[*kept, *new])

        yield from tidy(rows(), getattr(kernel, "done", lambda: None))

    return source.mapInArrow(run, schema)
