"""Approximate nearest neighbours by cosine: balanced posting lists, a graph over their centroids.

The space is cut by a bounded sample: it is halved again and again along the line between two means, so all
lists' shares are equal. Centroids are searched through a graph of nearest centroids, by a beam, for
many vectors at once. Every row is put into its nearest list and into others almost as near (boundary vectors). How many
lists a query searches is measured on the table itself: ``PROBES`` queries are compared with all rows, and the number of
lists, nearest first, is the least that holds the share ``recall`` of their true neighbours. So it grows with the lists
where the vectors need it (near-random ones: a share of all lists). A list of any size is searched in blocks. Scores are
cosines of the original vectors in double precision.

Parameters: ``SAMPLE`` rows fit the lists; there are rows / ``LIST_ROWS`` lists, at most ``MOST_LISTS`` (so
centroids and graph stay within some 10 MB, whatever the input).

Edge cases: vectors that are null, zero or hold null or non-finite components take no part, nor do vectors of
another length than most; equal vectors tie to the smaller id; fewer than k candidates give fewer rows; an empty
table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, query, table
from .vectors import best_of, finite, in_blocks, matrix, sample, top

SAMPLE = 32_768
LIST_ROWS = 512
MOST_LISTS = 16_384
REPLICAS = 4
BOUNDARY = 1.15
NEIGHBOURS = 24
RECALL = 0.99  # share of the probes' true neighbours that the searched lists must hold
PROBES = 256
LEAST = 16  # lists that a query searches whatever the probes need
PLANNED = 1 << 22  # distances to centroids held at once
FOUND = "query_id long, vec_id long, score double"


def balanced_centroids(points: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Means of ``lists`` equal parts of the points."""
    random, out = np.random.default_rng(seed), []
    todo = [(points, lists)]
    while todo:
        part, n = todo.pop()
        if n <= 1 or len(part) < 2:
            out.append(part.mean(0))
            continue
        a, b = part[random.choice(len(part), 2, replace=False)]
        for _ in range(6):
            nearer = part @ (a - b) > (a @ a - b @ b) / 2
            if nearer.all() or not nearer.any():
                break
            a, b = part[nearer].mean(0), part[~nearer].mean(0)
        left = n // 2
        order = np.argsort(part @ (b - a), kind="stable")
        cut = max(1, min(len(part) - 1, round(len(part) * left / n)))
        todo += [(part[order[:cut]], left), (part[order[cut:]], n - left)]
    return np.array(out)


class CentroidGraph:
    """Nearest centroids by a beam over a graph: each has edges to its nearest and to a few at random."""

    def __init__(self, centroids: np.ndarray, neighbours: int = NEIGHBOURS, seed: int = 11):
        n = len(centroids)
        self.centroids, self.norms = centroids.astype(np.float32), (centroids**2).sum(1).astype(np.float32)
        near = []
        for at in range(0, n, 1024):
            away = self.norms - 2 * self.centroids[at:at + 1024] @ self.centroids.T
            near.append(np.argpartition(away, min(neighbours, n - 1), 1)[:, :min(neighbours, n)])
        edges = np.concatenate(near)
        random = np.random.default_rng(seed)
        self.edges = np.concatenate([edges, random.integers(0, n, (n, 4))], 1).astype(np.int32)
        self.entries = random.choice(n, min(n, 32), replace=False).astype(np.int32)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids found for each row, nearest first, and their distances."""
        x = x.astype(np.float32)
        rows, n = np.arange(len(x))[:, None], len(self.centroids)
        own = (x**2).sum(1)[:, None]

        def away(c: np.ndarray) -> np.ndarray:
            return np.maximum(0, own[:len(c)] + self.norms[c] - 2 * np.einsum("ij,ikj->ik", x, self.centroids[c]))

        seen = np.zeros((len(x), n), bool)
        held = np.repeat(self.entries[None], len(x), 0)
        seen[rows, held] = True
        held_away, opened = away(held), np.zeros(held.shape, bool)
        while True:
            todo = np.where(opened, np.inf, held_away)
            picks = np.argsort(todo, 1)[:, :4]
            useful = np.take_along_axis(todo, picks, 1) < np.inf
            if not useful.any():
                break
            np.put_along_axis(opened, picks, True, 1)
            new = self.edges[np.take_along_axis(held, picks, 1)].reshape(len(x), -1)
            fresh = ~seen[rows, new]
            new_away = np.where(fresh, away(new), np.inf)
            order = np.argsort(new, 1, kind="stable")  # the same centroid by two edges counts once
            ordered = np.take_along_axis(new, order, 1)
            twice = np.zeros(new.shape, bool)
            np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            new_away[twice] = np.inf
            seen[rows, new] = True
            held, held_away = np.concatenate([held, new], 1), np.concatenate([held_away, new_away], 1)
            opened = np.concatenate([opened, np.zeros(new.shape, bool)], 1)
            kept = np.argsort(held_away, 1, kind="stable")[:, :beam]
            held, held_away, opened = (np.take_along_axis(a, kept, 1) for a in (held, held_away, opened))
            opened |= held_away == np.inf
        order = np.argsort(held_away, 1, kind="stable")
        return np.take_along_axis(held, order, 1), np.sqrt(np.take_along_axis(held_away, order, 1))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_distance(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """All lists for each row, nearest centroid first."""
    away = (centroids**2).sum(1) - 2 * x.astype(np.float32) @ centroids.T
    return np.argsort(away, 1, kind="stable").astype(np.int32)


def true_neighbours(vectors: DataFrame, ids: np.ndarray, probes: np.ndarray, k: int) -> DataFrame:
    """The ``k`` nearest of all rows for each probe, by one scan; a task gives ``k`` rows for each probe at most."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, best_ids = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            own, scores = batch.column(0).to_numpy(), probes @ unit(matrix(batch.column(1))).T
            scores[ids[:, None] == own] = -np.inf
            best = np.concatenate([best, scores], 1)
            best_ids = np.concatenate([best_ids, np.repeat(own[None], len(ids), 0)], 1)
            order = np.lexsort((best_ids, -best), axis=1)[:, :k]
            best, best_ids = np.take_along_axis(best, order, 1), np.take_along_axis(best_ids, order, 1)
        row, column = np.nonzero(best > -2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[row], pa.int64()), pa.array(best_ids[row, column], pa.int64()), pa.array(best[row, column])],
            ["query_id", "vec_id", "score"])

    return top(vectors.mapInArrow(scan, FOUND), k)


def lists_needed(vectors: DataFrame, is_query, candidates: DataFrame, centroids: np.ndarray, k: int, recall: float) -> int:
    """How many lists, nearest first, hold the share ``recall`` of the true neighbours of sampled queries."""
    least = min(LEAST, len(centroids))
    ids, probes = sample(vectors.filter(is_query), PROBES)
    if not len(ids):
        return least
    probes = unit(probes)
    pairs = materialise(true_neighbours(vectors, ids, probes, k).select("query_id", "vec_id").distinct(), "true-neighbours")
    held = pairs.join(candidates.select("vec_id", "cell"), "vec_id").select("query_id", "vec_id", "cell").distinct().toArrow()
    if not len(held):
        return least
    order = by_distance(probes, centroids)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(centroids), dtype=np.int32)[None], 1)
    row = {q: i for i, q in enumerate(ids.tolist())}
    need: dict[tuple[int, int], int] = {}
    for q, v, cell in zip(*(held[c].to_pylist() for c in ("query_id", "vec_id", "cell"))):
        need[q, v] = min(need.get((q, v), len(centroids)), int(rank[row[q], cell]))
    ordered = sorted(need.values())
    return max(least, 1 + ordered[min(len(ordered), int(np.ceil(recall * len(ordered)))) - 1])


def search(vectors: DataFrame, is_query, k: int, recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest found for each row for which ``is_query`` holds, among all other rows.

    ``vectors`` has ``vec_id`` and ``vec`` (doubles, not all zero)."""
    rows = vectors.count()
    if not rows:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    _, points = sample(vectors, SAMPLE)
    graph = CentroidGraph(balanced_centroids(unit(points), max(1, min(MOST_LISTS, rows // LIST_ROWS, len(points) // 2))))
    centroids = graph.centroids

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                lists, away = graph.search(unit(matrix(part.column(1))), 16)
                near = away[:, :REPLICAS] <= BOUNDARY * away[:, :1]
                near[:, :1] = True
                row, column = np.nonzero(near & np.isfinite(away[:, :REPLICAS]))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(lists[row, column], pa.int32())], ["vec_id", "vec", "cell"])

    candidates = materialise(vectors.mapInArrow(post, "vec_id long, vec array<double>, cell int"), "posting-lists")
    most = lists_needed(vectors, is_query, candidates, centroids, k, recall)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(1024, PLANNED // len(centroids)))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                cells = by_distance(unit(matrix(part.column(1))), centroids)[:, :most]
                edges = np.arange(len(part) + 1, dtype=np.int32) * cells.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(edges, pa.array(cells.ravel()))], ["vec_id", "vec", "cells"])

    planned = materialise(vectors.filter(is_query).mapInArrow(plan, "vec_id long, vec array<double>, cells array<int>"), "list-queries")
    queries = planned.select("vec_id", "vec", F.explode("cells").alias("cell"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, q, x_ids, x = left["vec_id"].to_numpy(), matrix(left["vec"]), right["vec_id"].to_numpy(), matrix(right["vec"])
        out: list[tuple[int, int, float]] = []
        if len(q) and len(x):
            scores = (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)
            scores[q_ids[:, None] == x_ids] = -np.inf
            for i in range(len(q)):
                out += [(q_ids[i], x_ids[j], cosine(q[i], x[j])) for j in best_of(scores[i], x_ids, k + 3) if scores[i, j] > -2]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                        ["query_id", "vec_id", "score"])

    return top(in_blocks(queries, candidates, work, FOUND).dropDuplicates(["query_id", "vec_id"]), k)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine by correctly rounded sums, so that it does not depend on block or order."""
    import math

    return math.sumprod(a, b) / (math.sqrt(math.sumprod(a, a)) * math.sqrt(math.sumprod(b, b)))


@query("op6_near_search")
def op6_near_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = finite(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").filter(F.exists("vec", lambda x: x != 0))
    return search(materialise(vectors, "vectors"), F.col("vec_id") % 50 == 0, 5)
