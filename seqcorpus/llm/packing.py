"""Best-fit packing of documents into sequences, with a fixed number of open sequences.

Documents longer than a sequence are cut: the first piece takes what is left over, all others fill
a sequence. Shorter pieces go, in the order they arrive, into the open sequence with the least free
space that holds them. Open sequences are kept by free space; a bitset has a bit for each free space
at which one is open, so the best fit is the lowest bit at or above the piece's length. Where all
``open_bins`` are open and none fits, the fullest closes.

Each task packs the pieces it is dealt (by a hash of the id, so a hot source spreads), longest first;
it holds only the open sequences. A sequence's number is its task's number and its own within the task.

Edge cases: a null or empty text is the end id alone, a piece of one token; equal rows are packed
each by itself; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import batches_of, frugal, materialise, query, table, texts_of
from .tokens import END_ID, encoder, vocabulary_path

LENGTH = 1024
OPEN_BINS = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def cut(n_tokens: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Start and length of each piece of a document: a first one that may be shorter, then full ones."""
    first = n_tokens % length
    full = [(at, length) for at in range(first, n_tokens, length)]
    return [(0, first), *full] if first else full


class Packer:
    """Open sequences by free space; ``place`` gives a piece's sequence and offset at once."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS):
        self.length, self.open_bins = length, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.bits = self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest
            free, found = self.length, self.n_bins
            self.n_bins += 1
        left = free - size
        if left:
            self.by_free[left].append(found)
            self.bits |= 1 << left
            self.n_open += 1
        return found, self.length - free


def token_pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: place, length and checksum, not the ids themselves."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in batches_of(batches):
            rows = []
            for doc_id, ids in zip(doc_ids, encoder(vocabulary).encode(texts)):
                ids = np.append(ids, np.array(end_id, ids.dtype)).astype("<u4")
                for piece, (start, n) in enumerate(cut(len(ids), length)):
                    rows.append((doc_id, piece, start, n, zlib.crc32(ids[start:start + n])))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts_of(docs, id_col, text_col).mapInArrow(frugal(encode), PIECES)


def pack(pieces: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs ``doc_id``, ``piece``, ``length`` among its columns."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        packer = Packer(length, open_bins)
        for batch in batches:
            placed = [packer.place(n) for n in batch.column(batch.schema.get_field_index("length")).to_pylist()]
            if placed:
                sequences, offsets = zip(*placed)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([base + s for s in sequences], pa.int64()), pa.array(offsets, pa.int64())],
                    [*batch.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {k}" for c, k in pieces.dtypes) + ", sequence_id long, offset long"
    dealt = pieces.repartition(F.xxhash64("doc_id", "piece"))
    order = [F.desc("length"), *(c for c in pieces.columns if c != "length")]
    return dealt.sortWithinPartitions(*order).mapInArrow(frugal(place), schema)


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = materialise(token_pieces(table(spark, sf_dir, "documents"), vocabulary_path()), "pieces")
    return pack(pieces)
