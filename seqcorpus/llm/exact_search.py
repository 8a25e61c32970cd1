"""Exact search for the largest inner products, by distances to pivots.

Vectors get one more component that makes all their lengths equal (zero for a query), which turns the
largest inner product into the smallest distance. Distances of every vector to a few pivots are computed
once. For a query and a candidate, the largest difference of their pivot distances is a lower bound of
their distance, so an upper bound of their product. In each pair of blocks a query's candidates are
evaluated in the order of their bounds, until no bound left reaches the best k found so far; a first
threshold comes from a fixed sample of candidates. Blocks' best k are merged.

Components are floor(64 x). Pivots and sample are bounded; they steer the order only, never the result.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do vectors of another
length than most; equal vectors tie to the smaller id; fewer than k candidates give fewer rows; an empty table
gives no row. Products are exact up to 2**53, beyond that computed in wrapping 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, query, table
from .vectors import best_of, finite, in_blocks, matrix, sample, top

PIVOTS = 16
SAMPLE = 2048
FOUND = "query_id long, vec_id long, score long"


def spread_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Vectors far from each other: each next one is the farthest from those chosen."""
    chosen, far = [], np.full(len(vectors), np.inf)
    for _ in range(min(n, len(vectors))):
        i = int(far.argmax()) if chosen else 0
        chosen.append(i)
        far = np.minimum(far, ((vectors - vectors[i]) ** 2).sum(1))
    return vectors[chosen]


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of integers held in doubles."""
    most = np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * max(1, queries.shape[-1])
    if most < 2.0**53:
        return candidates @ queries
    return candidates.astype(np.int64) @ queries.astype(np.int64)


def search(vectors: DataFrame, is_query, k: int, pivots: int = PIVOTS, sampled: int = SAMPLE) -> DataFrame:
    """The ``k`` largest inner products of each row for which ``is_query`` holds, among all other rows.

    ``vectors`` has ``vec_id`` and ``vec`` (whole numbers held in doubles)."""
    sample_ids, sample_vectors = sample(vectors, sampled)
    if not len(sample_ids):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    most = vectors.agg(F.max(norm)).first()[0]
    points = spread_pivots(sample_vectors, pivots)
    point_norms = (points**2).sum(1)
    point_lifts = np.sqrt(most - point_norms)

    def measured(lifted: bool):
        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
                if not len(ids):
                    continue
                norms = (x**2).sum(1)
                lift = np.sqrt(np.maximum(0, most - norms)) if lifted else np.zeros(len(x))
                away = norms[:, None] + point_norms - 2 * x @ points.T + (lift[:, None] - point_lifts) ** 2
                columns = [batch.column(0), batch.column(1), pa.array(norms),
                           pa.FixedSizeListArray.from_arrays(pa.array(np.sqrt(np.maximum(0, away)).ravel()), len(points)).cast(pa.list_(pa.float64()))]
                names = ["vec_id", "vec", "norm", "away"]
                if not lifted:
                    first = [np.partition(s := products(q, sample_vectors)[sample_ids != i].astype(float), -k)[-k]
                             if (sample_ids != i).sum() >= k else -np.inf for i, q in zip(ids, x)]
                    columns, names = [*columns, pa.array(first, pa.float64())], [*names, "least"]
                yield pa.RecordBatch.from_arrays(columns, names)

        return measure

    schema = "vec_id long, vec array<double>, norm double, away array<double>"
    candidates = materialise(vectors.mapInArrow(measured(True), schema), "pivot-table").withColumn("cell", F.lit(0))
    queries = materialise(vectors.filter(is_query).mapInArrow(measured(False), schema + ", least double"), "pivot-queries")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, q, x_ids, x = left["vec_id"].to_numpy(), matrix(left["vec"]), right["vec_id"].to_numpy(), matrix(right["vec"])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(q) and len(x):
            q_away, x_away = matrix(left["away"]), np.ascontiguousarray(matrix(right["away"]).T)
            for i in range(len(q)):
                low = np.abs(x_away[0] - q_away[i, 0])
                for j in range(1, len(x_away)):
                    np.maximum(low, np.abs(x_away[j] - q_away[i, j]), out=low)
                span = left["norm"][i].as_py() + most
                bound = (span - low**2) / 2 + 1e-9 * span + 1e-6
                found.append((q_ids[i], *_best(q[i], q_ids[i], x, x_ids, bound, left["least"][i].as_py())))
        sizes = [len(f[1]) for f in found]
        return pa.table({
            "query_id": pa.array(np.repeat([f[0] for f in found], sizes) if found else [], pa.int64()),
            "vec_id": pa.array(np.concatenate([f[1] for f in found]) if found else [], pa.int64()),
            "score": pa.array(np.concatenate([f[2] for f in found]).astype(np.int64) if found else [], pa.int64()),
        })

    def _best(q, own, x, x_ids, bound, least):
        """Evaluates candidates from the largest bound on, until no bound left reaches the k-th best score."""
        open_ = np.flatnonzero((bound >= least) & (x_ids != own))
        order = open_[np.argsort(-bound[open_], kind="stable")]
        ids, scores, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 256
        while at < len(order) and bound[order[at]] >= least:
            part = order[at:at + step]
            new = products(q, x[part])
            kept = new >= least
            ids, scores = np.concatenate([ids, x_ids[part[kept]]]), np.concatenate([scores, new[kept]])
            best = best_of(scores, ids, k)
            ids, scores = ids[best], scores[best]
            if len(scores) == k:
                least = max(least, scores[-1])
            at, step = at + step, 2 * step
        return ids, scores

    return top(in_blocks(queries.withColumn("cell", F.lit(0)), candidates, work, FOUND), k)


def whole_numbers(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    return vectors.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double")))


@query("op3_exact_search")
def op3_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialise(whole_numbers(finite(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")), "vectors")
    return search(vectors, F.col("vec_id") % 20 == 0, 20)
