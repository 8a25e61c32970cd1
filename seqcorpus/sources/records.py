"""Text sources (A1, A2, A18, A19, A23, D6, H4) and their writer (A20-A22). Compressed files are recognised by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, WindowSpec, functions as F

from ..functions.arrays import bind, computed_once
from ..operators.cells import DEBUG_CHARS, by_batch, debug_rows
from .scratch import materialise

END_MARK = "EOS"
RECORD_END = "\nEOS\n"
COMMENT_MARK = "#"
# List lines must be longer than this, per job.
EXAMPLE_JOB_LIST_MIN, DICTIONARY_JOB_LIST_MIN = 4, 5


def marked_records(value: Column) -> Column:
    """The records, each ending in a line with the mark alone, of a text cut at ``RECORD_END``.

    Only a whole line is a mark: a line such as ``# VIDEOS`` is content. Marks at the head of the text are
    empty records, one each. A file may end in the mark without a newline, or without a mark; so a newline
    directly before the mark's own cannot be told from the file's last one and is dropped. Two empty records
    that follow each other share the newline between their marks and count as one.
    """
    mark = len(END_MARK)
    odd = (value == "") | (value == END_MARK) | value.startswith(END_MARK + "\n") | value.endswith("\n" + END_MARK) | value.endswith("\n")
    whole = F.array(F.concat(value, F.lit("\n" + END_MARK)))  # most texts are one record, which is looked at once
    heads = F.when(value.startswith(END_MARK + "\n"), F.regexp_extract(value, "^(?:EOS\\n)+", 0)).otherwise("")
    empty = F.array_repeat(F.lit(END_MARK), (F.length(heads) / (mark + 1)).cast("int"))
    rest = F.substr(value, F.length(heads) + 1)
    unended = (
        F.when(rest.endswith("\n" + END_MARK), F.left(rest, F.length(rest) - mark - 1))
        .when(rest.endswith("\n"), F.left(rest, F.length(rest) - 1))
        .otherwise(rest)
    )
    lone = F.when(F.length(unended) > 0, F.concat(unended, F.lit("\n" + END_MARK))).otherwise(F.lit(END_MARK))
    record = F.when((value == "") | (rest == END_MARK), END_MARK).when(rest != "", lone)
    return F.when(odd, F.concat(empty, F.array_compact(F.array(record)))).otherwise(whole)


def read_records(
    spark: SparkSession, paths: str | Sequence[str], strict: bool = True, streaming: bool = False, name: str = "raw",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """A1: one row per record, ending in the mark.

    ``strict`` fails on malformed UTF-8; otherwise such records get a ``valid`` of false. A stream takes at most
    ``files_per_trigger`` new files at once.
    """
    reader = (spark.readStream if streaming else spark.read).option("lineSep", RECORD_END)
    if streaming and files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.text(paths if isinstance(paths, str) else list(paths))
    if strict:
        checked = computed_once(rows, __text=F.validate_utf8("value"))
        return checked.select(F.explode(marked_records(F.col("__text"))).alias(name))
    return rows.select(F.explode(marked_records(F.col("value"))).alias(name), F.is_valid_utf8("value").alias("valid"))


def resolve_inputs(spark: SparkSession, spec: str, always_list: bool = False) -> list[str]:
    """A2: ``@file`` names a file of paths, one per line; anything else is a path itself.

    The dictionary job always takes a list and drops shorter lines (``always_list``), but keeps
    ``#`` lines; the example job drops both.
    """
    if not always_list and not spec.startswith("@"):
        return spec.split(",")
    lines = spark.read.text(spec[1:] if spec.startswith("@") else spec)
    if always_list:
        kept = lines.filter(F.length("value") > DICTIONARY_JOB_LIST_MIN)
    else:
        kept = lines.filter(
            ~F.col("value").startswith(COMMENT_MARK) & (F.length("value") > EXAMPLE_JOB_LIST_MIN)
        )
    return [r[0] for r in kept.collect()]


def _split_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, block, __mid, value) of one scan, written: ids of rows and of their splits are then the same ones."""
    rows = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("__mid"),
        "value",
    )
    return materialise(rows, "lines")


def _scanned(rows: DataFrame, *carried: Column, across: bool = False) -> DataFrame:
    """One row per split: its first id, the lines before it and ``carried`` windows over earlier splits.

    It is a written table, so its size, which grows with splits and comments, decides how it is joined."""
    splits = rows.groupBy("path", "block").agg(
        F.count("*").alias("__n"), F.min("__mid").alias("__first"),
        F.max(F.when(_is_comment(), F.struct("__mid", "value"))).getField("value").alias("__last"),
    )
    before = F.coalesce(F.sum("__n").over(_earlier(across)), F.lit(0)).alias("__before")
    return materialise(splits.select("path", "block", "__first", before, *carried), "splits")


def _earlier(across: bool = False) -> WindowSpec:
    ordered = W.orderBy("path", "block") if across else W.partitionBy("path").orderBy("block")
    return ordered.rowsBetween(W.unboundedPreceding, -1)


def _is_comment() -> Column:
    return F.col("value").startswith(COMMENT_MARK)


def numbered_lines(spark: SparkSession, paths: str | Sequence[str], across: bool = False) -> DataFrame:
    """(path, block, line_no, value): lines with their 0-based number in the file or, ``across`` files, in all of them
    in the order of their names.

    Every split counts its own lines; numbers follow from the counts of the splits before it, so files of any
    size are numbered where they lie. Lines and splits come from one written scan.
    """
    rows = _split_lines(spark, paths)
    joined = rows.join(_scanned(rows, across=across), ["path", "block"])
    number = F.col("__before") + F.col("__mid") - F.col("__first")
    return joined.select("path", "block", number.alias("line_no"), "value")


def with_comments(rows: DataFrame) -> DataFrame:
    """Numbered lines of a written scan with the latest ``#`` line of the file so far (``comment``) and ``is_comment``.

    A scan in segments under "the last that is not null": inside a split by a window, across splits over one row
    per split, whose last comment is carried to those after it.
    """
    carried = F.last("__last", ignorenulls=True).over(_earlier()).alias("__carried")
    inside = W.partitionBy("path", "block").orderBy("__mid").rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("__local", F.last(F.when(_is_comment(), F.col("value")), ignorenulls=True).over(inside))
    joined = local.join(_scanned(rows, carried), ["path", "block"])
    number = F.col("__before") + F.col("__mid") - F.col("__first")
    comment = F.coalesce("__local", "__carried", F.lit(""))
    return joined.select(
        "path", "block", number.alias("line_no"), "value", comment.alias("comment"), _is_comment().alias("is_comment"))


def read_annotated_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, line_no, comment, raw) for every line that is not a comment."""
    rows = with_comments(_split_lines(spark, paths)).filter(~F.col("is_comment"))
    return rows.select("path", "line_no", "comment", F.col("value").alias("raw"))


def parse_debug_table(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Records of a debug table to (comment, chars array<struct<ch, tags array<struct<tag, prob>>>>).

    A line holds a character, n tags and n probabilities; an empty last block gives no row. Records whose lines are all
    plain are read by Arrow batch, the others by expressions.
    """
    others = [c for c in df.columns if c != raw]
    plain = by_batch(lambda texts: debug_rows(texts, END_MARK), f"struct<comment: string, chars: {DEBUG_CHARS}>", F.col(raw))
    read = computed_once(df.select(*others, raw), __plain=plain)
    lines = F.filter(F.split(F.col(raw), "\n"), lambda x: (x != "") & (x != END_MARK))
    cut = computed_once(read, __lines=F.when(F.col("__plain").isNull(), lines))

    def one(parts: Column) -> Column:
        return bind(
            ((F.size(parts) - 1) / 2).cast("int"),
            lambda n: F.struct(
                parts[0].alias("ch"),
                F.zip_with(
                    F.slice(parts, F.lit(2), n), F.slice(parts, n + 2, n),
                    lambda t, p: F.struct(t.alias("tag"), p.cast("float").alias("prob")),
                ).alias("tags"),
            ),
        )

    comments = F.filter("__lines", lambda x: x.startswith("# "))
    fields = F.transform(
        F.filter("__lines", lambda x: ~x.startswith("# ")),
        lambda x: F.filter(F.split(x, "\t"), lambda p: p != ""),
    )
    rows = computed_once(
        cut,
        comment=F.coalesce("__plain.comment", bind(comments, lambda c: F.get(c, F.size(c) - 1)), F.lit("")),
        chars=F.coalesce("__plain.chars", F.transform(fields, one)),
    )
    return rows.filter((F.size("chars") > 0) | (F.col("comment") != "")).select(*others, "comment", "chars")


def read_debug_table(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A19 over files: (comment, chars) of every record."""
    return parse_debug_table(read_records(spark, paths))


def write_records(df: DataFrame, path: str, record: str = "value", compression: str = "gzip") -> None:
    """Records that end in the mark (``decode.token_lines``, ``decode.debug_lines``: A20, A21), one file per partition.

    :func:`read_records` gives them back; the order inside a partition is kept. A null record is not written.
    """
    kept = F.array_compact(F.array(F.col(record).cast("string")))  # a filter would compute a costly record again
    df.select(F.explode(kept).alias("value")).write.text(path, compression=compression)


def source_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(source, path, bytes) of the files that ``paths`` (folders or glob patterns) name, numbered from 0 in name order.

    Spark's scan passes over empty files, so they get no number. It reads no content. One row per file, so the numbering's single task holds names only.
    """
    found = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    named = found.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes")).distinct()
    place = (F.row_number().over(W.orderBy("path")) - 1).cast("bigint").alias("source")
    return named.select(place, "path", "bytes")


def read_sources(spark: SparkSession, paths: str | Sequence[str], parallel: int = 1) -> DataFrame:
    """H4: (turn, source, path, line_no, value): the lines of all files of a pattern, files in name order.

    ``turn`` orders a reader that has ``parallel`` files open and takes a line of each in turn: files are opened
    ``parallel`` at a time, and order is by (turn, line_no, source). With 1 that is file after file. Every file is read
    where it lies, in splits.
    """
    if parallel < 1:
        raise ValueError("at least one file must be open")
    files = materialise(source_files(spark, paths), "sources").select("source", "path")
    turn = F.call_function("div", F.col("source"), F.lit(parallel).cast("bigint")).alias("turn")
    return numbered_lines(spark, paths).join(files, "path").select(turn, "source", "path", "line_no", "value")
