"""Quality scores: a Gaussian kernel over document statistics, by random Fourier features.

A text becomes some twenty statistics (lengths, shares of character kinds, repetition of words and lines). They are
standardised and mapped by cosines of random projections, whose inner products approximate a Gaussian kernel. Each
partition sums its part of the normal equations; the sums give ridge weights. Raw scores of rows kept out of the
fit are calibrated to probabilities by isotonic regression (pooled neighbours, straight lines between pools).

Labels are used of at most about ``FIT_ROWS`` rows (a hash of the id decides), so what is joined by broadcast and
what reaches the driver (one matrix for each of ``FIT_PARTS`` partitions, ``GRID`` calibration points) is bounded.
Scores are computed for every row in one pass, without a join.

Edge cases: null and empty texts have all-zero statistics and a score like any other; without labels, or with labels of
one kind only, every score is the share of label 1 (0.5 without any); repeated rows score alike; several labels of an
id are averaged; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import batches_of, frugal, materialise, prepare, query, table, texts_of

FIT_ROWS = 100_000
FIT_PARTS = 16
FEATURES = 384
WIDTH = 3.0
RIDGE = 1e-3
GRID = 2000
FOLDS = 5
ACCEPTED = 0.3

_KINDS = np.zeros(256, np.int64)  # other: 0
for _kind, _chars in enumerate((
        b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b".,;:", b"!?", b"'\"()-",
        b"#$%&*@^~", b"|<>{}[]\\/=+_", bytes(range(128, 256))), 1):
    _KINDS[list(_chars)] = _kind
N_KINDS = 12


def statistics(text: str) -> list[float]:
    """Statistics of one text."""
    raw = text.encode()
    n = max(1, len(raw))
    kinds = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=N_KINDS) / n
    words = raw.split()
    counts = Counter(words)
    n_words = max(1, len(words))
    lengths = np.array([len(w) for w in words] or [0])
    lines = raw.split(b"\n")
    endings = sum(w[-1] in b".!?" for w in words) / n_words
    share = np.array(list(counts.values()) or [1]) / n_words
    pairs = sum(a == b for a, b in zip(words, words[1:])) / n_words
    return [
        *kinds.tolist(), math.log1p(len(raw)), math.log1p(len(words)), float(lengths.mean()), math.log1p(int(lengths.max())),
        float(lengths.std()), len(counts) / n_words, float(share.max()) if words else 0.0, float(-(share * np.log(share)).sum()),
        endings, pairs, len(set(lines)) / len(lines), math.log1p(len(raw) / len(lines)),
        sum(w[:1].isupper() for w in words) / n_words,
    ]


N_STATISTICS = len(statistics(""))


@dataclass
class Model:
    """Standardisation, projection, weights and calibration; some kilobytes, sent to every task."""

    prior: float = 0.5
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_STATISTICS))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_STATISTICS))
    weights: np.ndarray | None = None
    points: np.ndarray | None = None
    values: np.ndarray | None = None

    def __post_init__(self):
        random = np.random.default_rng(5)
        self.projection = random.normal(0, 1 / WIDTH, (N_STATISTICS, FEATURES))
        self.phase = random.uniform(0, 2 * np.pi, FEATURES)

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of statistics, and a constant."""
        spread = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = math.sqrt(2 / FEATURES) * np.cos(spread @ self.projection + self.phase)
        return np.concatenate([waves, np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores from 0 to 1."""
        if self.weights is None or not len(x):
            return np.full(len(x), self.prior)
        raw = self.raw(x)
        return np.clip(np.interp(raw, self.points, self.values) if self.points is not None else raw, 0.0, 1.0)


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def isotonic(points: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools neighbours until their means rise; centre and mean of each pool."""
    pools: list[list[float]] = []
    for p, s, n in zip(points, sums, counts):
        pools.append([p * n, s, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _sums(rows: DataFrame, of) -> np.ndarray | None:
    """Sum over all rows of ``of(x, y)``, an array: one for each partition, then of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x = batch.column(0).flatten().to_numpy().reshape(len(batch), -1)
                part = of(x, batch.column(1).to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    found = [np.frombuffer(r["sums"]) for r in rows.select("x", "y").coalesce(FIT_PARTS).mapInArrow(frugal(run), "sums binary").collect()]
    return np.sum(found, 0) if found else None


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model of ``labels.quality`` from texts; labels of the held-out fold are never read."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("y"), batch.column("fold")], ["x", "y", "fold"])

    labelled = texts_of(docs).join(F.broadcast(chosen), "doc_id").select("text", "y", fold(F.col("doc_id")).alias("fold"))
    measured = materialise(labelled.mapInArrow(frugal(measure), "x array<double>, y double, fold long"), "statistics").repartition(FIT_PARTS, F.xxhash64("x", "y"))
    moments = _sums(measured, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x**2).sum(0)]))
    if moments is None:
        return Model()
    n, mean = moments[0], moments[2:2 + N_STATISTICS] / moments[0]
    spread = np.sqrt(np.maximum(moments[2 + N_STATISTICS:] / n - mean**2, 0))
    model = Model(moments[1] / n, mean, np.where(spread > 1e-9, spread, 1.0))
    if not 0 < model.prior < 1:
        return model

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([z.T @ z, (z.T @ y)[:, None]], 1).ravel()

    size = FEATURES + 1
    kept = _sums(measured.filter(F.col("fold") != FOLDS - 1), normal)
    if kept is None:
        return model
    kept = kept.reshape(size, size + 1)
    ridge = RIDGE * n * np.eye(size) / FEATURES
    ridge[-1, -1] = 0
    model.weights = np.linalg.lstsq(kept[:, :-1] + ridge, kept[:, -1], rcond=None)[0]

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(np.round((model.raw(x) + 0.5) * GRID / 2), 0, GRID).astype(int)
        return np.concatenate([np.bincount(at, y, GRID + 1), np.bincount(at, minlength=GRID + 1)])

    counted = _sums(measured.filter(F.col("fold") == FOLDS - 1), histogram)
    if counted is not None:
        sums, counts = counted[:GRID + 1], counted[GRID + 1:]
        used = np.flatnonzero(counts)
        model.points, model.values = isotonic(used * 2 / GRID - 0.5, sums[used], counts[used])
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches_of(batches):
            scores = model.score(np.array([statistics(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return texts_of(docs, id_col, text_col).mapInArrow(frugal(run), "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, least: float = ACCEPTED, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, whose score reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                scores = model.score(np.array([statistics(t or "") for t in texts]))
                yield part.filter(pa.array(scores >= least))

    prepare(docs.sparkSession)
    return docs.mapInArrow(frugal(run), docs.schema)


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))
