"""Token ids in Arrow files of equal-length sequences with masks, open to random access.

A part file is an Arrow IPC file. Each record batch has ``sequences`` rows of two fixed-size lists of
``length``: ``ids`` and ``mask`` (true where an id stands; only the tail of a part's last sequence is
padded). The buffers are not compressed, so a memory-mapped file gives any sequence as a view. Beside
it an index file (``.index``) has ``doc_id``, ``start`` and ``n_tokens`` of each document of the part, in order.

Parts are ranges of ``doc_id``, so the ids of all parts one after another are the corpus in ascending
``doc_id`` order. A task writes under a name of its own and returns it; only names that the finished
tasks returned are ever read, so a task that runs twice or dies leaves no wrong data behind.

Edge cases: a null or empty text is the end id alone; null ``doc_id`` comes first; rows with equal
``doc_id`` are kept, ordered by text; an empty table gives no file and no row.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import batches_of, materialise, query, scratch_path, table, texts_of
from .tokens import END_ID, encoder, vocabulary_path

LENGTH = 1024
SEQUENCES = 512
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "path string, first_id long, n_docs long, n_tokens long"


def file_at(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and inner path of a folder's URI or of a plain path."""
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


class PartWriter:
    """Appends documents to one part file; holds one record batch of ids at most."""

    def __init__(self, folder: str, dtype: np.dtype, length: int = LENGTH, sequences: int = SEQUENCES):
        self.fs, inner = file_at(folder)
        self.fs.create_dir(inner, recursive=True)
        name = f"part-{uuid.uuid4().hex}.arrow"
        self.path, self.inner = f"{folder}/{name}", f"{inner}/{name}"
        self.dtype, self.length, self.room = dtype, length, length * sequences
        self.kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([
            pa.field("ids", pa.list_(self.kind, length), nullable=False),
            pa.field("mask", pa.list_(pa.bool_(), length), nullable=False),
        ])
        self.sink = self.fs.open_output_stream(self.inner)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.index_sink = self.fs.open_output_stream(self.inner + ".index")
        self.index = pa.ipc.new_file(self.index_sink, INDEX)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = 0
        self.first_id: int | None = None

    def add(self, doc_ids: list, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], np.int64)
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), starts, sizes], schema=INDEX))
        if not self.n_docs:
            self.first_id = doc_ids[0]
        self.n_docs += len(ids)
        self.n_tokens += int(sizes.sum())
        self.held += ids
        self.n_held += int(sizes.sum())
        if self.n_held >= self.room:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.room * self.room
            for at in range(0, whole, self.room):
                self._write(flat[at:at + self.room], self.room)
            self.held, self.n_held = [flat[whole:].copy()], len(flat) - whole

    def _write(self, flat: np.ndarray, size: int) -> None:
        padded = np.zeros(size, self.dtype)
        padded[:len(flat)] = flat
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, np.arange(size) < len(flat))]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate([np.zeros(0, self.dtype), *self.held])
        if len(flat):
            self._write(flat, -(-len(flat) // self.length) * self.length)
        for x in (self.file, self.sink, self.index, self.index_sink):
            x.close()


class PartReader:
    """Random access to a part file: sequences, masks and token ranges as views of the mapped file."""

    def __init__(self, path: str):
        self.fs, self.inner = file_at(path)
        self.file = pa.ipc.open_file(self._open(self.inner))
        self.length = self.file.schema.field("ids").type.list_size
        self.step = len(self.file.get_batch(0)) if self.file.num_record_batches else 1

    def _open(self, inner: str):
        return pa.memory_map(inner) if isinstance(self.fs, pa.fs.LocalFileSystem) else self.fs.open_input_file(inner)

    def _flat(self, batch: int) -> np.ndarray:
        return self.file.get_batch(batch).column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``."""
        batch = self.file.get_batch(i // self.step)
        row = i % self.step
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)[row * self.length:(row + 1) * self.length]
        mask = batch.column(1).flatten().slice(row * self.length, self.length)
        return ids, mask.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on; a view unless they lie in several record batches."""
        room = self.step * self.length
        found = []
        while n > 0:
            batch, at = divmod(start, room)
            found.append(self._flat(batch)[at:at + n])
            start, n = start + len(found[-1]), n - len(found[-1])
        return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, "<u4")

    def documents(self) -> Iterator[pa.RecordBatch]:
        index = pa.ipc.open_file(self._open(self.inner + ".index"))
        for i in range(index.num_record_batches):
            yield index.get_batch(i)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, length: int = LENGTH, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write all of ``docs`` below ``folder``; one row for each part file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for doc_ids, texts in batches_of(batches):
            encode = encoder(vocabulary)
            end = np.array([end_id], encode.dtype)
            writer = writer or PartWriter(folder, encode.dtype, length)
            writer.add(doc_ids, [np.concatenate([ids, end]) for ids in encode.encode(texts)])
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({
                "path": [writer.path], "first_id": pa.array([writer.first_id], pa.int64()),
                "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens],
            })

    ranged = texts_of(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ranged.mapInArrow(write, MANIFEST), "token-parts")


def read_tokens(parts: DataFrame) -> DataFrame:
    """The documents of written part files with their place in the whole stream and a checksum of their ids.

    The running total has one row for each file."""
    before = F.sum("n_tokens").over(W.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1))
    placed = parts.select("path", F.coalesce(before, F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = PartReader(path)
                for found in part.documents():
                    starts, sizes = (found.column(i).to_numpy() for i in (1, 2))
                    crcs = [zlib.crc32(part.tokens(s, n).astype("<u4")) for s, n in zip(starts.tolist(), sizes.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [found.column(0), pa.array(starts + base), found.column(2), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, parts.count())
    return placed.repartition(files, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = write_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), vocabulary_path())
    return read_tokens(parts)
