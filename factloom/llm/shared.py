"""What the operators share: durable tables, bounded Arrow batches, and only the columns that are asked for."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.plans.durable import delete, new_path, written

__all__ = ["arrow_batches", "delete", "new_path", "plain_columns", "released", "small_arrow_batches", "written"]


def small_arrow_batches(spark: SparkSession, rows: int = 500, size: int = 4 << 20) -> None:
    """Bound what one Arrow batch sends to a Python worker, so that long documents can't pile up in one.

    A session's bounds that are smaller stay; larger ones are lowered for good, since frames are run after they are returned.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Other bounds for what is run inside."""
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, (rows, size)):
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def released(part: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`part` of a task, after which its worker, that lives on, gives free memory back to the machine."""

    @wraps(part)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from part(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return run


def plain_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; each must be there. Other columns, whatever their names, can't clash with ours."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df.select(*names)
