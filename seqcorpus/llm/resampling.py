"""Importance resampling of documents towards a target text set, over hashed word n-grams.

A feature is a run of 1 to ``width`` consecutive words; its bucket is its CRC-32 modulo the number of buckets. How much
more often a bucket occurs in the target than in the documents is its gain; a document's weight is the sum of the gains
of its features, and a draw by score (weight plus a Gumbel draw of its id) is a draw without replacement by weight.

Checksums of all features of a batch are found at once. CRC-32 is linear: the checksum of a span is the XOR of one
contribution for each byte, which depends on the byte and its distance from the span's end, and of a constant for the
length. Contributions come from one table of ``BLOCK`` distances, and ``bitwise_xor.reduceat`` sums them by span. A
longer span is cut into blocks from its end; neighbouring blocks are folded, the earlier one moved on by the
length of the later, until one is left.

Documents are read twice (counts, then weights) and nothing but ids, weights and ranks is shuffled or written. Counts
have one row for each task and bucket. Ranks are given only to rows above a proven quantile, by range.

Edge cases: a null or empty text has no feature and weight 0; null ids draw as the empty id and come last among ties;
rows repeated as a whole draw alike and take neighbouring ranks; words of any length are hashed whole; a
text without words is never drawn; an empty target or table gives gains of the smoothed counts alone; an empty table gives
no row. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqcorpus.operators.numbering import positions

from .common import materialise, query, table, texts_of

BLOCK = 64  # distances from the end that the table holds
SLICE = 1 << 19  # bytes whose contributions are held at once, unless one block has more
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)  # bytes of words after lower-casing; A-Z count as a-z
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


class SpanChecksums:
    """CRC-32 of many spans of a buffer at once."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, step >> np.uint32(1) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
        self.step = step
        rows = [step]
        for _ in range(block - 1):
            rows.append(self._next(rows[-1]))
        self.table = np.concatenate(rows)
        #: what a remainder becomes when a block of zeros follows it, by each of its four bytes
        moved = np.arange(256, dtype=np.uint32)[None] << np.array([[0], [8], [16], [24]], np.uint32)
        for _ in range(block):
            moved = self._next(moved)
        self.moved = moved
        self.constants = np.array([zlib.crc32(bytes(n)) for n in range(block + 1)], np.uint32)

    def _next(self, state: np.ndarray) -> np.ndarray:
        return state >> np.uint32(8) ^ self.step[state & np.uint32(255)]

    @staticmethod
    def _move(state: np.ndarray, by: np.ndarray) -> np.ndarray:
        out = by[0][state & np.uint32(255)]
        for k in (1, 2, 3):
            out = out ^ by[k][state >> np.uint32(8 * k) & np.uint32(255)]
        return out

    def _remainders(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """XOR of the contributions of each span of at most ``block`` bytes."""
        ends = np.cumsum(sizes)
        out = np.zeros(len(starts), np.uint32)
        at = 0
        while at < len(starts):
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + SLICE, "right")))
            size, last = sizes[at:to], ends[at:to] - done
            first, place = last - size, np.arange(last[-1])
            bytes_ = data[np.repeat(starts[at:to] - first, size) + place]
            away = np.repeat(last - 1, size) - place
            out[at:to] = np.bitwise_xor.reduceat(self.table[away * 256 + bytes_], first)
            at = to
        return out

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Checksum of each span ``data[start:end]``; no span is empty."""
        sizes = ends - starts
        if not len(sizes):
            return np.zeros(0, np.uint32)
        blocks = -(-sizes // self.block)
        if blocks.max() == 1:
            return self._remainders(data, starts, sizes) ^ self.constants[sizes]
        firsts = np.cumsum(blocks) - blocks
        place = np.repeat(firsts + blocks - 1, blocks) - np.arange(blocks.sum())  # counted from the end
        block_ends = np.repeat(ends, blocks) - place * self.block
        block_starts = np.maximum(np.repeat(starts, blocks), block_ends - self.block)
        state, moved = self._remainders(data, block_starts, block_ends - block_starts), self.moved
        while place.any():
            odd = np.flatnonzero(place & 1)  # the block after it in this order is its even neighbour
            state[odd + 1] ^= self._move(state[odd], moved)
            kept = place & 1 == 0
            state, place = state[kept], place[kept] >> 1
            moved = self._move(moved, moved)
        lengths, which = np.unique(sizes, return_inverse=True)
        known = [self.constants[n] if n <= self.block else zlib.crc32(bytes(int(n))) for n in lengths]
        return state ^ np.array(known, np.uint32)[which]


@lru_cache(1)
def checksums() -> SpanChecksums:
    return SpanChecksums()


def joined_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words of all texts with one space after each, their starts and ends there, and the text of each."""
    column = column.cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column) or edges[0] == edges[-1]:
        return np.zeros(0, np.uint8), *[np.zeros(0, np.int64) for _ in range(3)]
    data = np.frombuffer(column.buffers()[2], np.uint8)[edges[0]:edges[-1]]
    edges = edges - edges[0]
    inside = WORD[data]
    before, after = np.roll(inside, 1), np.roll(inside, -1)
    before[edges[:-1][edges[:-1] < len(data)]] = False
    after[edges[1:][edges[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    sizes = ends - starts
    to = np.cumsum(sizes + 1) - 1
    out = np.full(int(to[-1]) + 1 if len(to) else 0, 32, np.uint8)
    out[np.repeat(to - sizes - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = LOWER[data[inside]]
    return out, to - sizes, to, np.searchsorted(edges[1:], starts, "right")


def buckets_of(column: pa.Array, width: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... ``width`` words: the bucket of each run of each text and the text's place, in order."""
    data, starts, ends, texts = joined_words(column)
    for n in range(1, width + 1):
        last = len(starts) - n + 1
        same = np.flatnonzero(texts[:max(last, 0)] == texts[n - 1:]) if last > 0 else np.zeros(0, np.int64)
        found = checksums()(data, starts[same], ends[same + n - 1])
        yield (found % np.uint32(buckets)).astype(np.int64), texts[same]


def bucket_counts(texts: DataFrame, width: int, buckets: int) -> np.ndarray:
    """How many features of all texts lie in each bucket; a task sends a row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found, _ in buckets_of(batch.column(0), width, buckets):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)  # one row for each bucket reaches the driver
    out[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the logarithm of target share by corpus share, with one added to every count."""
    all_corpus, all_target = int(corpus.sum()) + len(corpus), int(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log(float((t + 1) * all_corpus) / float((s + 1) * all_target)))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(texts: DataFrame, gain: np.ndarray, width: int) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` of each text."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            words, features, total = (np.zeros(n, np.int64) for _ in range(3))
            for k, (found, owner) in enumerate(buckets_of(batch.column(1), width, len(gain))):
                each = np.bincount(owner, minlength=n)
                sums = np.concatenate([[0], np.cumsum(gain[found])])
                ends = np.cumsum(each)
                features, total = features + each, total + sums[ends] - sums[ends - each]
                words = words if k else each
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (words, features, total))],
                ["doc_id", "n_words", "n_features", "weight"])

    return texts.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def scored(texts: DataFrame, gain: np.ndarray, width: int, seed: int) -> DataFrame:
    """Weights with ``score``: the weight and a Gumbel draw of seed and id, in whole thousandths."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((draw + 0.5) / F.lit(4294967296.0)))).cast("long")
    return weights(texts, gain, width).withColumn("score", F.col("weight") + gumbel)


def ranked(rows: DataFrame, share: int, least_words: int) -> DataFrame:
    """``rows`` with ``rank``: the place of each drawn row, null for the others.

    ``share`` percent of the rows of ``least_words`` words are drawn. Only rows at least as good as a quantile that lies
    surely below the last drawn one are sorted; the quantile's error has a proven bound, and it is checked."""
    eligible = F.col("n_words") >= least_words
    share_kept, error = share / 100, 0.001
    of, floor_ = rows.filter(eligible).agg(
        F.count("*"), F.percentile_approx("score", max(0.0, 1 - share_kept - 4 * error), round(1 / error))).first()
    drawn = share * of // 100
    if not drawn:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    good = eligible & (F.col("score") >= F.lit(floor_))
    if rows.filter(good).count() < drawn:
        good = eligible
    placed = positions(rows.filter(good), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")], name="rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(rows.filter(~good).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, share: int = 10, seed: int = 2024, width: int = 1, buckets: int = 10_000,
             least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``docs``."""
    texts = texts_of(docs, id_col, text_col)
    wanted = target.select(F.coalesce(F.col(target_col), F.lit("")).alias("text"))
    gain = gains(bucket_counts(texts, width, buckets), bucket_counts(wanted, width, buckets))
    return ranked(materialise(scored(texts, gain, width, seed), "scores"), share, least_words)


_CRC = """
list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode(w))),
    lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::INT, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))"""

SQL = rf"""
WITH crc_steps AS (
  SELECT list(v ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
texts AS (
  SELECT doc_id, text FROM documents UNION ALL SELECT NULL, text FROM benchmark WHERE text IS NOT NULL),
found AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
runs AS (SELECT doc_id, unnest(ws) AS w FROM found),
hashed AS (
  SELECT w, xor({_CRC}, 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT w FROM runs), crc_steps),
counts AS (
  SELECT bucket, count(doc_id) AS s, count(*) - count(doc_id) AS t FROM runs JOIN hashed USING (w) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts),
gained AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain
  FROM counts, totals),
weighed AS (
  SELECT doc_id, sum(gain)::BIGINT AS weight FROM runs JOIN hashed USING (w) JOIN gained USING (bucket)
  WHERE doc_id IS NOT NULL GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5)
      / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM found LEFT JOIN weighed USING (doc_id) WHERE doc_id IS NOT NULL),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""


@query("op11_resampling", SQL)
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
