"""External programs and raw bytes."""

from __future__ import annotations

import subprocess
import threading
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from .files import FileReader, FileWriter, read_chunks
from .ship import ship

BYTES_SCHEMA = "path string, chunk_no bigint, bytes binary"
READ_SIZE = 16 * 1024
ROWS = 4096


def run_through(command: list[str], chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Standard output of ``command`` while ``chunks`` are fed to it by a second thread. Fails if
    feeding fails or the program does not end with 0; its errors go to the worker's own."""
    child = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE)
    failure: list[BaseException] = []

    def feed() -> None:
        try:
            for chunk in chunks:
                child.stdin.write(chunk)
        except BrokenPipeError:
            pass  # the program stopped reading; its exit code decides
        except BaseException as e:  # handed to the reading thread
            failure.append(e)
            child.kill()
        finally:
            try:
                child.stdin.close()
            except BrokenPipeError:
                pass

    feeder = threading.Thread(target=feed, daemon=True)
    feeder.start()
    try:
        while data := child.stdout.read1(READ_SIZE):
            yield data
        code = child.wait()
        feeder.join()
        if failure:
            raise RuntimeError(f"feeding {command} failed") from failure[0]
        if code != 0:
            raise RuntimeError(f"{command} ended with code {code}")
    finally:
        if child.poll() is None:
            child.kill()
            child.wait()
        child.stdout.close()


def _split_lines(chunks: Iterator[bytes]) -> Iterator[str]:
    rest = b""
    for chunk in chunks:
        *whole, rest = (rest + chunk).split(b"\n")
        for line in whole:
            yield line.decode("utf-8")
    if rest:
        yield rest.decode("utf-8")


def _line_piper(command: list[str]) -> Callable:
    def pipe(batches):
        import pyarrow as pa

        def texts() -> Iterator[bytes]:
            for batch in batches:
                lines = batch.column(0).to_pylist()
                yield "".join(f"{x or ''}\n" for x in lines).encode("utf-8")

        held: list[str] = []
        for line in _split_lines(run_through(command, texts())):
            held.append(line)
            if len(held) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    return pipe


def pipe_lines(df: DataFrame, command: str, column: str = "value") -> DataFrame:
    """A3: each partition's lines through one run of ``command`` (split on white space, no shell). A null is an empty line."""
    ship(df.sparkSession)
    return df.select(column).mapInArrow(_line_piper(command.split()), "value string")


def _byte_piper(command: list[str]) -> Callable:
    def pipe(batches):
        import pyarrow as pa

        names: list[str] = []

        def feed() -> Iterator[bytes]:
            for batch in batches:
                names.extend(batch.column(0).slice(0, 1).to_pylist())
                yield from batch.column(2).to_pylist()

        for i, data in enumerate(run_through(command, feed())):
            path = names[0] if names else None
            yield pa.RecordBatch.from_arrays(
                [pa.array([path], pa.string()), pa.array([i], pa.int64()), pa.array([data], pa.binary())],
                names=["path", "chunk_no", "bytes"],
            )

    return pipe


def read_bytes(spark: SparkSession, paths: str) -> DataFrame:
    """A5: whole files as chunks in order, unzipped by name; one partition per file."""
    register(spark)
    return spark.read.format("rawbytes").load(paths)


def pipe_files(spark: SparkSession, paths: str, command: str) -> DataFrame:
    """A4: one run of ``command`` per file, output chunks in order."""
    return read_bytes(spark, paths).mapInArrow(_byte_piper(command.split()), BYTES_SCHEMA)


def write_bytes(df: DataFrame, path: str, ext: str = "", codec: str = "gzip", mode: str = "append") -> None:
    """The ``bytes`` of each partition, in order, as one file."""
    register(df.sparkSession)
    writer = df.select("path", "chunk_no", "bytes").write.format("rawbytes").mode(mode)
    writer.option("extension", ext).option("codec", codec).save(path)


class BytesReader(FileReader):
    def read(self, partition):
        import pyarrow as pa

        for i, chunk in enumerate(read_chunks(partition.path)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.path]), pa.array([i], pa.int64()), pa.array([chunk], pa.binary())],
                names=["path", "chunk_no", "bytes"],
            )


class BytesWriter(FileWriter):
    def encode(self, batches):
        for batch in batches:
            yield from (b for b in batch.column(2).to_pylist() if b is not None)


class BytesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawbytes"

    def schema(self) -> str:
        return BYTES_SCHEMA

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema: StructType) -> BytesReader:
        return BytesReader(self._options())

    def writer(self, schema: StructType, overwrite: bool) -> BytesWriter:
        o = self._options()
        return BytesWriter(o, overwrite, o.get("extension", ""), o.get("codec", "gzip"))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(BytesSource)
