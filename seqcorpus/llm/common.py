"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqcorpus.sources.scratch import materialise, scratch_path
from seqcorpus.sources.ship import ship

__all__ = ["QUERIES", "ORACLES", "materialise", "scratch_path", "table", "texts_of", "batches_of", "frugal", "query"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of this package, with its SQL where SQL can express it."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


#: rows and bytes of whole texts that travel to a Python worker at once (one row at least); bound its memory
BATCH_ROWS = "1000"
BATCH_BYTES = str(8 << 20)


def prepare(spark: SparkSession) -> None:
    """Make the package known to the executors, and batches of texts small."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text alone, under fixed names, so that no other column of ``docs`` can clash; null text: empty."""
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` over an Arrow stream, at whose end the worker, which Spark keeps for later tasks, returns the memory it freed."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return wrapped


def batches_of(batches: Iterator[pa.RecordBatch], chars: int = 1 << 23) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of an Arrow stream in groups of a bounded number of characters (one text at least)."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        start = size = 0
        lengths = pa.compute.binary_length(texts).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > chars:
                yield ids[start:i], [t or "" for t in texts.slice(start, i - start).to_pylist()]
                start, size = i, 0
            size += n
        if start < len(ids):
            yield ids[start:], [t or "" for t in texts.slice(start).to_pylist()]
