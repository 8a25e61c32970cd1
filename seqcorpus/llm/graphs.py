"""Connected components of an edge table, and joins in which few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqcorpus.sources.scratch import release

from .common import materialise

HOT_SHARE = 1000  # a key with more than this part of all rows is joined by broadcast
PART_EDGES = 1 << 18  # edges that one task contracts


def hot_join(rows: DataFrame, entries: DataFrame, on: Sequence[str], weight: str) -> DataFrame:
    """``rows`` joined to ``entries``, a written table with one row for each key and, in ``weight``, how many rows have it.

    Rows of a frequent key stay where they are and its entry is broadcast (there are fewer than ``HOT_SHARE`` such keys);
    only the others are dealt by key."""
    of, most = entries.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    plain = entries.drop(weight)
    if most * HOT_SHARE <= of:
        return rows.join(plain, list(on))
    is_hot = F.col(weight) * HOT_SHARE > of
    often = rows.join(F.broadcast(entries.filter(is_hot).drop(weight)), list(on))
    seldom = rows.join(F.broadcast(entries.filter(is_hot).select(*on)), list(on), "left_anti")
    return often.unionByName(seldom.join(entries.filter(~is_hot).drop(weight), list(on)))


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """The edges of each of ``parts`` shares replaced by edges from every node to the smallest of its component there."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        ends = np.concatenate([np.zeros((2, 0), np.int64), *map(np.stack, held)], axis=1)
        nodes, place = np.unique(ends, return_inverse=True)
        a, b = place.reshape(ends.shape)
        least = np.arange(len(nodes))
        while True:
            low = np.minimum(least[a], least[b])
            np.minimum.at(least, least[a], low)
            np.minimum.at(least, least[b], low)
            while (least[least] != least).any():
                least = least[least]
            if (least[a] == least[b]).all():
                break
        kept = np.flatnonzero(least != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[kept]), pa.array(nodes[least[kept]])], ["a", "b"])

    return edges.coalesce(parts).mapInArrow(contract, "a long, b long")


def components(edges: DataFrame, rounds: int = 60, part_edges: int = PART_EDGES) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of every node of ``edges`` (``a``, ``b``).

    Each round first contracts the edges in shares of bounded size; where there is only one share, that is the result.
    Otherwise every node is joined to the smallest neighbour of its neighbours, first upwards, then downwards, until nothing
    changes; the number of rounds grows with the logarithm of the longest path. Minima are found by partial
    aggregation, and the edges of a node with very many neighbours are never dealt by it (``hot_join``). Each round
    is written and read again, and its predecessor emptied."""
    now = materialise(_canonical(edges), "edges")
    state = _state(now)
    for _ in range(rounds if state[0] else 0):
        parts = -(-state[0] // part_edges)
        stars = materialise(contracted(now, parts), "contracted")
        release(now)
        if parts == 1:
            now = stars
            break
        both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "minima")
        upward = hot_join(both.filter("b > a"), least, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(_canonical(upward), "large-star")
        lower = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "minima")  # a > b in every edge
        downward = hot_join(large, lower, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(_canonical(downward.union(lower.select("a", F.col("m").alias("b")))), "small-star")
        release(stars, least, large, lower)
        new = _state(now)
        if new == state:
            break
        state = new
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _canonical(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node, without loops."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())
