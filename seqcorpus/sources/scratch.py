"""Shared scratch space for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SCRATCH_CONF = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where none is set (tests)."""
    named = spark.conf.get(SCRATCH_CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SCRATCH_CONF} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="seqcorpus-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path that nothing else writes to."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and read it back: cuts the lineage, survives lost executors, and gives
    Catalyst the real size of the table for its join choices."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.scratch_path = path
    return stored


def is_stored(df: DataFrame) -> bool:
    """Whether ``df`` is a table that ``materialise`` wrote, so that reading it twice computes nothing twice."""
    return "scratch_path" in vars(df)


def release(*stored: DataFrame) -> None:
    """Empty tables that ``materialise`` wrote, once all that reads them is written itself."""
    for df in stored:
        nothing = df.sparkSession.createDataFrame([], df.schema)
        nothing.coalesce(1).write.mode("overwrite").parquet(df.scratch_path)


#: what a piece of a spread scan is to hold: bytes as Catalyst estimates the scanned columns (compressed), and rows
SPREAD_BYTES, SPREAD_ROWS = 2 << 20, 2_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan that yields fewer pieces than the cluster has cores, or large ones; leave others alone.

    A file is often a single row group, which one task would read and process alone, however many pieces the scan
    counts. The number of pieces grows with the input, so that the longest task does not. Equal texts compress to little,
    so rows count beside bytes (a count reads the files' footers only).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    run = df._jdf.queryExecution()
    wanted = max(-(-run.optimizedPlan().stats().sizeInBytes() // SPREAD_BYTES), -(-df.count() // SPREAD_ROWS))
    if run.toRdd().getNumPartitions() >= max(2 * cores, wanted):
        return df
    count = max(cores, wanted)
    return df.repartition(count, *keys) if keys else df.repartition(count)
