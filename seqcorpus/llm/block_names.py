"""Exact duplicates by deterministic block naming, without a hash deciding that two texts are equal.

A normalised text is cut into blocks of ``BLOCK`` bytes. All blocks are sorted by content and equal ones get one integer
name. Then the names of neighbouring blocks are paired, the pairs are sorted and named in the same way, and so on, until
each document has one name; a level names half as many things as the one before. Two texts are equal exactly if they
end at the same level with the same name.

All of it is DataFrame operations. Texts are dealt once, by range of their blocks (of a block's head and hash, so that
sampled borders are short; blocks are told apart by all their bytes); after that only integers travel. A block
that is very frequent (counted by hash, which decides on nothing else; there can be at most ``HOT_SHARE`` of them) is
dealt to ``SALTS`` ranges, named in each, and its names are joined to the least of them by a broadcast of as many rows. The
same holds for pairs of names, and for texts: only their names, counts and the row that stays are joined back to the rows, by
broadcast where very many rows share them. No group is gathered: of a group one row stays, found by partial aggregation.

Of equal texts the row with the most code points in the original text stays, then that of the smallest id (null ids last),
then the first row. Rows are numbered as the scan gives them, so ``docs`` must give the same rows again if a task is lost:
a table, or a DataFrame made from one without a shuffle.

Edge cases: null text counts as empty, and all empty texts (and those of white space alone) are equal; rows repeated as a
whole, and rows with one id, are rows of their own, of which one stays; null ids are kept; texts of any length are read
whole; an empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import materialise, query, table

BLOCK, HEAD = 1024, 16  # bytes
HOT_SHARE = 1000  # what holds more than this part of all rows is dealt to several ranges
SALTS = 64
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without white space of ASCII; null: empty."""
    return functools.reduce(lambda t, c: F.replace(t, F.lit(c)), BLANKS, F.coalesce(text, F.lit("")))


def named(rows: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """``rows`` with ``name`` in place of ``keys``: one integer for each different value of them.

    ``rows`` is read twice before it is dealt (hot values, range borders)."""
    value = F.xxhash64(*keys)
    counts = materialise(rows.groupBy(value.alias("value")).agg(F.count("*").alias("n")), f"{label}-counts")
    of = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r["value"] for r in counts.filter(F.col("n") * HOT_SHARE > of).select("value").collect()]  # under HOT_SHARE rows
    is_hot = value.isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64("row", "pos"), F.lit(SALTS))).otherwise(F.lit(-1)).cast("int")
    texts = rows.select(*keys).dtypes[0][1] == "binary"
    heads = [F.substring(keys[0], 1, HEAD), value] if texts else [F.col(k) for k in keys]
    rows = rows.select("*", F.struct(*heads, salt).alias("border"), salt.alias("salt"))
    by = ["border", *keys]
    placed = rows.repartitionByRange("border").sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    first = F.min("place").over(W.partitionBy(*by))  # the ranges already hold each value whole
    plain = [c for c in rows.columns if c not in (*keys, "border", "salt")]
    local = placed.withColumn("name", first)
    if not hot:
        return materialise(local.select(*plain, "name"), label)
    kept = F.when(F.col("salt") >= 0, F.struct(*keys))  # of a hot value its first row in a range carries the content
    local = materialise(local.select(*plain, "name", F.when(F.col("place") == F.col("name"), kept).alias("content")), label)
    shared = local.filter("content is not null").select("content", "name")
    least = materialise(shared.join(shared.groupBy("content").agg(F.min("name").alias("least")), "content").select("name", "least"), "hot-names")
    return local.join(F.broadcast(least), "name", "left").select(*plain, F.coalesce("least", "name").alias("name"))


def identities(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """``doc_id``, ``points``, ``sha`` and the identity (``level``, ``name``) of every row of ``docs``; ``row`` numbers them."""
    text = F.col(text_col)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("points"), normalised(text).alias("text"))
    rows = rows.select("row", "doc_id", "points", F.unhex(F.sha2("text", 256)).alias("sha"), F.col("text").cast("binary").alias("text"))
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("text") / block).cast("int") - 1)
    cut = rows.select("*", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    at_head = [F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("doc_id", "points", "sha")]  # once for each text
    cut = cut.select("row", "pos", "last", *at_head, F.substring("text", F.col("pos") * block + 1, F.lit(block)).alias("block"))
    level, names = 0, named(cut, ["block"], "block-names")
    done = []
    while True:
        attributes = ["row", "doc_id", "points", "sha"]
        done.append(names.filter("last = 0").select(*attributes, F.lit(level).alias("level"), "name"))
        more = names.filter("last > 0")
        if more.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
        half = F.floor(F.col("pos") / 2).cast("int")

        def side(of: int) -> Column:
            return F.max(F.when(F.col("pos") % 2 == of, F.col("name")))

        pairs = more.groupBy("row", half.alias("pos"), F.floor(F.col("last") / 2).cast("int").alias("last")).agg(
            *[F.max(c).alias(c) for c in attributes[1:]], side(0).alias("left"), F.coalesce(side(1), F.lit(-1)).alias("right"))
        level, names = level + 1, named(materialise(pairs, "pairs"), ["left", "right"], "pair-names")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row of ``docs``."""
    rows = materialise(identities(docs, id_col, text_col, block), "identities")
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    groups = rows.groupBy("level", "name").agg(F.count("*").alias("group_size"), best.alias("best"))
    groups = materialise(groups.select(
        "level", "name", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")), "groups")
    of = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    is_hot = F.col("group_size") * HOT_SHARE > of
    hot = F.broadcast(groups.filter(is_hot))  # under HOT_SHARE rows
    on = ["level", "name"]
    often = rows.join(hot, on)
    seldom = rows.join(F.broadcast(groups.filter(is_hot).select(*on)), on, "left_anti").join(groups.filter(~is_hot), on)
    return often.unionByName(seldom).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


SQL = r"""
WITH cleaned AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER best = 1 AS kept, sha256(t) AS text_sha256
FROM cleaned WINDOW best AS (PARTITION BY t ORDER BY points DESC, doc_id)
"""


@query("op12_exact_copies", SQL)
def op12_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"))
