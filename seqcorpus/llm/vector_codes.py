"""Vectors as short codes: one codebook for each part of the vectors, fitted by a dual-tree form of Lloyd's rounds.

Rows lie in blocks; a block holds, for each part, a tree over its points: halved along the widest component down to
leaves, with the box, the sum and the number of points of every node. It is built once, written, and read by every round. A
codebook has a tree over its entries, with boxes too. A round descends both: distances between two boxes bound those of
all their points and entries, so entry nodes farther than the nearest one can be are dropped for a whole node of points, and
then single entries that another one beats all over the box. A node left with one entry gives it its cached sum and count; in
leaves left with several, distances to these alone are computed. All numbers are integers, so sums do not depend on
blocks or order and equal distances go to the lower index. On near-random vectors few nodes are decided whole (README).

A task sends one row for each part, entry and component; what reaches the driver, and what is sent back, are the
codebooks. Rows are dealt nowhere but for the sums by label.

Components become floor(scale x). Edge cases: vectors that are null or hold null or non-finite components take no part, nor
do vectors of another length than most, nor those with a component whose squared distances may not fit a long (beyond 32,768
for 64 components); null ids are kept and come last among the first entries; repeated rows count each; with fewer rows than
entries there are as many entries as rows; a last part that is too short is filled with zeros; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqcorpus.operators.lookup import lookup_join

from .common import materialise, query, table
from .vectors import matrix

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
BLOCK_ROWS, BLOCK_BYTES, LEAF = 8192, 16 << 20, 24
BLOCKS = "ids array<long>, labels array<string>, orders binary, points binary, low binary, high binary, sums binary, size int"
CODES = "vec_id long, label_key string, code string, error long"


@dataclass
class Tree:
    """Nodes by level from the root; level ``i`` cuts the points, in tree order, at ``edges[i]``."""

    points: np.ndarray
    edges: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]


def level_edges(n: int, leaf: int) -> list[np.ndarray]:
    """Borders of the nodes of every level; each node's halves differ by one point at most."""
    levels = [np.array([0, n])]
    while n > leaf * (len(levels[-1]) - 1):
        e = levels[-1]
        levels.append(np.sort(np.concatenate([e, (e[:-1] + e[1:]) // 2])))
    return levels


def bounds(points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = edges[:-1]
    return np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts), np.add.reduceat(points, starts)


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree]:
    """A tree over ``points`` and their order in it."""
    order, levels = np.arange(len(points)), level_edges(len(points), leaf)
    tree = Tree(points, levels, [], [], [])
    for i, edges in enumerate(levels):
        low, high, sums = bounds(points[order], edges)
        for name, value in zip(("low", "high", "sums"), (low, high, sums)):
            getattr(tree, name).append(value)
        if i + 1 < len(levels):  # sort each node along its widest component
            node = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            along = points[order, (high - low).argmax(1)[node]]
            order = order[np.lexsort((along, node))]
    tree.points = points[order]
    return order, tree


def apart(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distances between each box of the first and each of the second."""
    low, high, low2, high2 = low[:, None], high[:, None], low2[None], high2[None]
    gap = np.maximum(0, np.maximum(low2 - high, low - high2))
    span = np.maximum(high2 - low, high - low2)
    return (gap * gap).sum(2), (span * span).sum(2)


class Codebook:
    """Entries of one part with a tree over them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        order, tree = build(entries, 1)
        self.order, self.low, self.high, self.edges = order, tree.low, tree.high, tree.edges

    def near(self, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Which of the entries ``alive`` (box, entry) may be nearest to some point of each box."""
        alive = alive[:, self.order]
        for level, edges in enumerate(self.edges):
            node = np.add.reduceat(alive, edges[:-1], axis=1, dtype=np.int32) > 0
            least, most = apart(low, high, self.low[level], self.high[level])
            within = np.where(node, most, np.iinfo(np.int64).max).min(1)
            node &= least <= within[:, None]
            alive = alive & np.repeat(node, np.diff(edges), axis=1)
        out = np.zeros_like(alive)
        out[:, self.order] = alive
        return self._beaten(low, high, out)

    def _beaten(self, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Without the entries that the one nearest to the box's middle beats everywhere in the box."""
        e = self.entries
        middle = low + high
        away = ((middle[:, None] - 2 * e[None]) ** 2).sum(2)
        best = np.where(alive, away, np.iinfo(np.int64).max).argmin(1)
        to = e[None] - e[best][:, None]
        corner = np.where(to > 0, high[:, None], low[:, None])  # where the other entry is nearest, compared with the best
        norms = (e * e).sum(1)
        margin = norms[None] - norms[best][:, None] - 2 * (corner * to).sum(2)
        index = np.arange(len(e))[None]
        kept = alive & ((margin < 0) | ((margin == 0) & (index < best[:, None])))
        kept[np.arange(len(best)), best] = True
        return kept


@dataclass
class Assigned:
    """Sums and counts of each entry, each point's entry in tree order, and how many distances were computed."""

    sums: np.ndarray
    counts: np.ndarray
    labels: np.ndarray
    measured: int


def assign(tree: Tree, book: Codebook) -> Assigned:
    """Every point's nearest entry, ties to the lower index."""
    e, p = book.entries, tree.points
    out = Assigned(np.zeros_like(e), np.zeros(len(e), np.int64), np.zeros(len(p), np.int64), 0)
    nodes, alive = np.zeros(1, np.int64), np.ones((1, len(e)), bool)
    for level, edges in enumerate(tree.edges):
        alive = book.near(tree.low[level][nodes], tree.high[level][nodes], alive)
        sure = alive.sum(1) == 1
        label, node = alive[sure].argmax(1), nodes[sure]
        sizes = edges[node + 1] - edges[node]
        np.add.at(out.sums, label, tree.sums[level][node])
        np.add.at(out.counts, label, sizes)
        out.labels[_spans(edges[node], sizes)] = np.repeat(label, sizes)
        nodes, alive = nodes[~sure], alive[~sure]
        if level + 1 < len(tree.edges):
            nodes, alive = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(alive, 2, axis=0)
    edges = tree.edges[-1]
    sizes = edges[nodes + 1] - edges[nodes]
    points, leaf = _spans(edges[nodes], sizes), np.repeat(np.arange(len(nodes)), sizes)
    if len(points):
        left = alive.sum(1)
        choices = np.nonzero(alive)[1]
        pairs = left[leaf]
        first = np.cumsum(pairs) - pairs
        entry = choices[_spans((np.cumsum(left) - left)[leaf], pairs)]
        away = ((p[np.repeat(points, pairs)] - e[entry]) ** 2).sum(1)
        nearest = np.repeat(np.minimum.reduceat(away, first), pairs)
        hits = np.flatnonzero(away == nearest)
        hits = hits[np.unique(np.repeat(np.arange(len(points)), pairs)[hits], return_index=True)[1]]
        label = entry[hits]
        out.labels[points], out.measured = label, len(entry)
        np.add.at(out.sums, label, p[points])
        out.counts += np.bincount(label, minlength=len(e))
    return out


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the given spans, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def block_row(ids: list, labels: list, vectors: np.ndarray, parts: int) -> pa.RecordBatch:
    """One block: its rows and the trees of all parts."""
    n = len(vectors)
    cut = vectors.reshape(n, parts, -1)
    built = [build(np.ascontiguousarray(cut[:, i])) for i in range(parts)]

    def packed(arrays) -> pa.Array:
        return pa.array([b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)], pa.binary())

    return pa.RecordBatch.from_arrays([
        pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())),
        packed(order.astype(np.int32) for order, _ in built), packed(t.points for _, t in built),
        *(packed(np.concatenate(getattr(t, name)) for _, t in built) for name in ("low", "high", "sums")),
        pa.array([cut.shape[2]], pa.int32()),
    ], ["ids", "labels", "orders", "points", "low", "high", "sums", "size"])


def trees_of(row: dict, parts: int) -> Iterator[tuple[np.ndarray, Tree]]:
    """Order and tree of each part of a block."""
    n, size = len(row["ids"]), row["size"]
    edges = level_edges(n, LEAF)
    cuts = np.cumsum([len(e) - 1 for e in edges])[:-1]
    orders = np.frombuffer(row["orders"], np.int32).reshape(parts, n)
    points = np.frombuffer(row["points"], np.int64).reshape(parts, n, size)
    nodes = [np.frombuffer(row[c], np.int64).reshape(parts, -1, size) for c in ("low", "high", "sums")]
    for i in range(parts):
        yield orders[i], Tree(points[i], edges, *(np.split(a[i], cuts) for a in nodes))


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float) -> tuple[DataFrame, int]:
    """``vec_id``, ``vec`` (doubles, scaled and floored) and ``label_key`` of the rows that take part; their length."""
    vec = F.col(vector_col).cast("array<double>")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    key = F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit(""))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"), key.alias("label_key")).filter(
        F.col("vec").isNotNull() & (F.size("vec") > 0) & sound)
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = usual["n"] if usual else 0
    most = math.isqrt(2**62 // max(size, 1)) // 2
    fits = (F.size("vec") == size) & F.forall("vec", lambda x: F.abs(x * scale) < float(most))
    return rows.filter(fits).withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double"))), size


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
           entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id``, ``label_key``, ``code`` and ``error`` of every row that takes part, and the codebook of each part."""
    rows, length = kept_vectors(vectors, id_col, vector_col, label_col, scale)
    size = -(-length // parts) or 1
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * parts * size)))

    def filled(column) -> np.ndarray:
        x = matrix(column).astype(np.int64)
        return np.pad(x, ((0, 0), (0, parts * size - length)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + len(batch)
            while n >= block_rows:
                whole = pa.Table.from_batches(held)
                yield row_of(whole.slice(0, block_rows))
                held, n = whole.slice(block_rows).to_batches(), n - block_rows
        if n:
            yield row_of(pa.Table.from_batches(held))

    def row_of(block: pa.Table) -> pa.RecordBatch:
        return block_row(block["vec_id"].to_pylist(), block["label_key"].to_pylist(), filled(block["vec"]), parts)

    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vec", "label_key").limit(entries).toArrow()
    start = filled(first["vec"]).reshape(len(first), parts, size) if len(first) else np.zeros((0, parts, size), np.int64)
    books = [np.ascontiguousarray(start[:, i]) for i in range(parts)]
    if not len(first):
        return rows.sparkSession.createDataFrame([], CODES), books
    blocks = materialise(rows.select("vec_id", "vec", "label_key").mapInArrow(gather, BLOCKS), "vector-trees")
    for _ in range(rounds):
        books = _next_books(blocks, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in books]
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"])
                codes, errors = np.zeros((n, parts), np.uint8 if entries <= 256 else np.uint16), np.zeros(n, np.int64)
                for i, (order, tree) in enumerate(trees_of(row, parts)):
                    label = assign(tree, found[i]).labels
                    codes[order, i] = label
                    errors[order] += ((tree.points - books[i][label]) ** 2).sum(1)
                digits = 2 * codes.itemsize * parts
                text = codes.astype(codes.dtype.newbyteorder(">")).tobytes().hex()
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()),
                    pa.array([text[at:at + digits] for at in range(0, digits * n, digits)], pa.string()), pa.array(errors),
                ], ["vec_id", "label_key", "code", "error"])

    return blocks.mapInArrow(code, CODES), books


def _next_books(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round; unused entries stay."""
    parts = len(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in books]
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]  # sums and, last, the count
        for batch in batches:
            for row in batch.to_pylist():
                for i, (_, tree) in enumerate(trees_of(row, parts)):
                    done = assign(tree, found[i])
                    total[i][:, :-1] += done.sums
                    total[i][:, -1] += done.counts
        part, entry, place = np.indices((parts, *total[0].shape))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c.ravel(), pa.int32()) for c in (part, entry, place)), pa.array(np.concatenate(total).ravel())],
            ["part", "entry", "place", "total"])

    sums = blocks.mapInArrow(add, "part int, entry int, place int, total long").groupBy("part", "entry", "place").agg(
        F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
    out = [b.copy() for b in books]
    cells = {(r["part"], r["entry"], r["place"]): int(r["total"]) for r in sums.collect()}  # as many as the codebooks hold
    for (part, entry, place), total in cells.items():
        n = cells[part, entry, books[part].shape[1]]
        if n and place < books[part].shape[1]:
            out[part][entry, place] = total // n
    return out


def books_text(books: list[np.ndarray]) -> str:
    """All components by part, entry and place."""
    return ",".join(str(x) for b in books for x in b.ravel().tolist())


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, size: int = 8) -> str:
    places = range(1, size + 1)
    distance = " + ".join(f"(a.v[{i}] - b.v[{i}]) * (a.v[{i}] - b.v[{i}])" for i in places)
    means = ", ".join(f"floor(sum(v[{i}])::DOUBLE / count(*))::BIGINT" for i in places)
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, p, list_transform(range(1, {size + 1}), lambda i: floor(4096 * embedding[p * {size} + i]::DOUBLE)::BIGINT) AS v
  FROM kept, range({parts}) r(p)),
book0 AS MATERIALIZED (
  SELECT p, e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""
near{i} AS MATERIALIZED (
  SELECT a.vec_id, a.label, a.p, any_value(a.v) AS v, min(({distance}) * {entries} + b.e) AS best
  FROM parts a JOIN book{i} b ON a.p = b.p GROUP BY a.vec_id, a.label, a.p)""")
        if i < rounds:
            steps.append(f"""
book{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM book{i} b
  LEFT JOIN (SELECT p, best % {entries} AS e, [{means}] AS v FROM near{i} GROUP BY ALL) n ON b.p = n.p AND b.e = n.e)""")
    return "WITH" + ",".join(steps) + f""",
coded AS (
  SELECT vec_id, label, string_agg(lower(lpad(hex(best % {entries}), 2, '0')), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error
  FROM near{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded"""


@query("op13_vector_codes", _sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = encode(table(spark, sf_dir, "embeddings"))
    codes = materialise(codes, "vector-codes")
    totals = materialise(codes.groupBy("label_key").agg(F.try_sum("error").alias("label_error")), "label-errors")
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return lookup_join(codes, totals, ["label_key"], {"label_error": None}).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
