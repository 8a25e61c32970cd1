"""Dictionary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import is_viable, norm_variants
from ..operators.lattice import TOKEN_KEY
from ..operators.lookup import FIRST_CHAR_ID
from ..operators.numbering import positions
from ..operators.vocab import RESERVED_CHARS, RESERVED_TAG
from .records import numbered_lines

KEY_SEPARATOR = "\x01"
# Shortest line that holds a key and a count; segmentation tags, B first.
MIN_LINE = 3
SEG_LABELS = ["NUL", "B", "I", "E"]


def _fields(value: Column) -> Column:
    return F.filter(F.split(value, "\t"), lambda p: p != "")


def _is_count(text: Column) -> Column:
    return text.rlike("^[+-]?[0-9]+$") & text.try_cast("bigint").isNotNull()


def read_dict_tsv(
    spark: SparkSession, path: str, fixed: bool = False, max_lines: int | None = None, offset: int = 0
) -> DataFrame:
    """(position, key, cnt) of ``key<TAB>count`` lines, from position 0; a folder's files follow each other by name.

    Shorter lines are dropped and do not count; at most ``max_lines - offset`` lines are kept. Without
    ``fixed`` either column may be the count; with it a line that does not parse is an error.
    """
    lines = numbered_lines(spark, path, across=True)
    if max_lines is not None:
        lines = lines.filter(F.col("line_no") < max_lines)
    kept = lines.filter(F.length("value") >= MIN_LINE)
    placed = positions(kept.select("line_no", "value"), [F.col("line_no")])
    if max_lines is not None:
        placed = placed.filter(F.col("position") <= max_lines - offset)
    rows = placed.select((F.col("position") - 1).alias("position"), "value", _fields(F.col("value")).alias("f"))
    first, second = F.get("f", F.lit(0)), F.get("f", F.lit(1))
    two = F.size("f") == 2
    bad = F.raise_error(F.concat(F.lit("unparseable line: "), F.col("value")))
    if fixed:
        key = F.when(two & _is_count(second), first).otherwise(bad)
        count = second
    else:
        key = F.when(two & _is_count(first), second).when(two & _is_count(second), first).otherwise(bad)
        count = F.when(_is_count(first), first).otherwise(second)
    return rows.select("position", norm_variants(key).alias("key"), count.cast("bigint").alias("cnt"))


def cut_vocab(rows: DataFrame, max_full: int, max_rows: int) -> DataFrame:
    """A13 on (position from 0, key, ...): the head is kept as it is, behind it only viable entries,
    ``max_rows`` in all. Adds ``id``, the place among the kept rows."""
    kept = rows.filter((F.col("position") < max_full) | is_viable(F.col("key")))
    placed = positions(kept, [F.col("position")], name="__place")
    return placed.filter(F.col("__place") <= max_rows).select(
        *rows.columns, (F.col("__place") - 1).alias("id")
    )


def read_vocab_tsv(spark: SparkSession, path: str, max_full: int, max_rows: int) -> DataFrame:
    return cut_vocab(read_dict_tsv(spark, path), max_full, max_rows)


def read_chardic(spark: SparkSession, path: str) -> DataFrame:
    """(ch, id), ids from 4 by line."""
    rows = numbered_lines(spark, path, across=True)
    return rows.select(
        F.split("value", "\t")[0].alias("ch"), (F.col("line_no") + FIRST_CHAR_ID).cast("int").alias("id")
    )


def read_vdic(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) by place among the non-empty lines."""
    kept = numbered_lines(spark, path).filter(F.col("value") != "")
    placed = positions(kept.select("path", "line_no", "value"), [F.col("path"), F.col("line_no")])
    return placed.select((F.col("position") - 1).alias("id"), F.col("value").alias("label"))


def read_difficulty(spark: SparkSession, path: str, sep: str = KEY_SEPARATOR) -> DataFrame:
    """The seven key columns and ``rank``. See ``sampling.default_rank`` for misses."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    keyed = parts.select(F.split(F.col("f")[0], sep).alias("k"), F.col("f")[1].cast("int").alias("rank"))
    return keyed.select(*[F.coalesce(F.get("k", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(TOKEN_KEY)], "rank")


def write_difficulty(df: DataFrame, path: str, sep: str = KEY_SEPARATOR) -> None:
    line = F.concat(F.concat_ws(sep, *TOKEN_KEY), F.lit("\t"), F.col("rank").cast("string"))
    df.select(line.alias("value")).write.text(path)


def _write_lines(df: DataFrame, order: list[Column], value: Column, path: str) -> None:
    """A folder of sorted text files, in the order of their names; small dictionaries are one file."""
    df.orderBy(*order).select(value.alias("value")).write.text(path)


def dic_line(key: str) -> Column:
    return F.concat(F.col(key), F.lit("\t"), F.col("cnt").cast("string"))


def char_labels(chars: DataFrame) -> DataFrame:
    """Labels of a character dictionary by id, the four reserved ones first."""
    spark = chars.sparkSession
    head = spark.range(1).select(F.posexplode(F.lit(RESERVED_CHARS)).alias("id", "label"))
    return head.unionByName(chars.select("id", "label"))


def tag_labels(tags: DataFrame, kind: str) -> DataFrame:
    spark = tags.sparkSession
    head = spark.range(1).select(F.lit(0).alias("id"), F.lit(RESERVED_TAG).alias("label"))
    rows = tags.filter(F.col("kind") == kind)
    return head.unionByName(rows.select("id", F.col("tag").alias("label")))


def write_dicts(by_freq: DataFrame, by_code: DataFrame, tags: DataFrame, base: str) -> None:
    """``.dic`` (key, count) and ``.vdic`` (labels by id) folders for characters in both orders
    and for every tag kind, plus the fixed segmentation dictionary."""
    for name, chars in (("chars.byfreq", by_freq), ("chars.bycode", by_code)):
        _write_lines(chars, [F.col("id")], dic_line("ch"), f"{base}/{name}.dic")
        _write_lines(char_labels(chars), [F.col("id")], F.col("label"), f"{base}/{name}.vdic")
    for kind in ("pos", "subpos", "ctype", "cform"):
        rows = tags.filter(F.col("kind") == kind)
        _write_lines(rows, [F.col("id")], dic_line("tag"), f"{base}/{kind}.dic")
        _write_lines(tag_labels(tags, kind), [F.col("id")], F.col("label"), f"{base}/{kind}.vdic")
    spark = tags.sparkSession
    seg = spark.range(1).select(F.posexplode(F.lit(SEG_LABELS)).alias("id", "label"))
    _write_lines(seg, [F.col("id")], F.col("label"), f"{base}/seg.vdic")
    plain = seg.filter(F.col("id") > 0).withColumn("cnt", F.lit(0))
    _write_lines(plain, [F.col("id")], dic_line("label"), f"{base}/seg.dic")
