"""Vectors that take part, and joins of query blocks with candidate blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F


def finite(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``vec`` (doubles) of the rows whose vectors are not null, have only finite components and are
    as long as most are."""
    vec = F.col(vector_col).cast("array<double>")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & sound)
    usual = kept.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept.filter(F.size("vec") == (usual["n"] if usual else 0))


def sample(vectors: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of ``rows`` rows at most, those of the smallest hashes of the id."""
    found = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).toArrow()
    return found["vec_id"].to_numpy(), matrix(found["vec"])


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of equal length as one array."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def in_blocks(queries: DataFrame, candidates: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
              query_rows: int = 1024, candidate_rows: int = 2048) -> DataFrame:
    """Apply ``work`` to each pair of a query block and a candidate block of the same ``cell``.

    A cell of any size is cut into blocks by a hash of the id, so a hot cell spreads over many tasks; every query of
    a cell still meets every candidate of it once. Counts have a row for each cell, of which there are a bounded number."""
    def blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))

    cells = blocks(queries, query_rows, "q_blocks").join(blocks(candidates, candidate_rows, "x_blocks"), "cell")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id"), F.col(own + "_blocks")).cast("int").alias(own)
        return df.join(F.broadcast(cells), "cell").select(
            *df.columns, block, F.explode(F.sequence(F.lit(0), F.col(other + "_blocks") - 1)).alias(other))

    keys = ["cell", "q", "x"]
    left, right = dealt(queries, "q", "x").groupBy(*keys), dealt(candidates, "x", "q").groupBy(*keys)
    return left.cogroup(right).applyInArrow(work, schema)


def top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query, ties to the smaller id, numbered from one."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= least)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))][:k]
