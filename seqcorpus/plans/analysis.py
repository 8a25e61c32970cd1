"""Analysis job: text files through an external program, compressed output."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.pipe import pipe_files, pipe_lines, write_bytes
from ..sources.records import resolve_inputs


def run(
    spark: SparkSession, spec: str, command: str, output: str, by_file: bool = True, always_list: bool = False,
    extension: str = ".txt",
) -> None:
    """The inputs of ``spec`` (A2) through ``command``, written as gzip files to ``output``.

    ``by_file``: one run for each whole file, bytes in and bytes out (A4, A6), for programs whose records span lines.
    Otherwise one run for each split, line by line (A3). A task run again starts its program anew; only files of
    finished attempts are kept.
    """
    paths = resolve_inputs(spark, spec, always_list)
    if not paths:
        raise ValueError(f"{spec} names no input")
    if by_file:
        write_bytes(pipe_files(spark, ",".join(paths), command), output, extension)
    else:
        pipe_lines(spark.read.text(paths), command).write.text(output, compression="gzip")
