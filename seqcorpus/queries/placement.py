"""Sort keys, layout, mixing, batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import hashing
from ..functions.arrays import joined
from ..operators import encode, layout, lookup
from ..operators.numbering import positions
from .base import KEY_LENGTH, query, sql_unit
from .encoding import HASH_SQL

SID = fx.SID

KEY_SQL = f"""
lens AS (SELECT *, greatest(4, (n + 2 + floor({sql_unit("doc_id, line_no", "length")} * 7) - 3)::INT) AS len FROM hashed),
keyed AS (SELECT doc_id, line_no, (CASE WHEN hash < 0 THEN {KEY_LENGTH} - len ELSE len - {KEY_LENGTH} END)::INT AS k1, hash AS k2 FROM lens)"""


def keyed(spark, sf):
    chars, _ = fx.dictionaries(spark, sf)
    rows = fx.joined_text(spark, sf)
    codes = rows.select(*SID, encode.encode_chars(F.col("text"), lookup.char_table(chars)).alias("chars"))
    hashed = codes.withColumn("k2", hashing.seq_hash(F.col("chars"), narrow=True))
    draw = hashing.uniform(1, [F.col(c) for c in SID], "length")
    length = hashing.jitter_len(F.size("chars"), draw)
    return hashed.withColumn("k1", hashing.zigzag_key(length, F.col("k2"), KEY_LENGTH))


@query("zigzag_layout", "WITH " + HASH_SQL + "," + KEY_SQL + """
SELECT doc_id, line_no, k1, k2, row_number() OVER (ORDER BY k1, k2, doc_id, line_no) AS place FROM keyed""", ("coded",))
def zigzag_layout(spark, sf):
    rows = keyed(spark, sf).select(*SID, "k1", "k2")
    return positions(rows, [F.col("k1"), F.col("k2"), *[F.col(c) for c in SID]], name="place")


@query("sorted_by_length", "WITH " + HASH_SQL + "," + KEY_SQL + "SELECT doc_id, line_no, k1, k2 FROM keyed", ("coded",))
def sorted_by_length(spark, sf):
    return layout.sort_by_length(keyed(spark, sf).select(*SID, "k1", "k2"), 8)


@query("hash_layout", "WITH " + HASH_SQL + "," + KEY_SQL + """
SELECT k1, k2, count(*) AS rows, 1::BIGINT AS files FROM keyed GROUP BY k1, k2""", ("coded",))
def hash_layout(spark, sf):
    """Equal keys share a file."""
    laid = layout.shuffle_by_hash(keyed(spark, sf).select("k1", "k2"), 8)
    placed = laid.withColumn("file", F.spark_partition_id())
    return placed.groupBy("k1", "k2").agg(F.count("*").alias("rows"), F.countDistinct("file").alias("files"))


FILES = 8


@query("sorted_files", "WITH " + HASH_SQL + "," + KEY_SQL + f""",
p AS (SELECT *, row_number() OVER (ORDER BY k1, k2, doc_id, line_no) - 1 AS pos, count(*) OVER () AS n FROM keyed)
SELECT doc_id, line_no, k1, k2, (pos * {FILES} // n)::INT AS file,
       row_number() OVER (PARTITION BY pos * {FILES} // n ORDER BY pos) - 1 AS place FROM p""", ("coded",))
def sorted_files(spark, sf):
    """File and place that every sentence really has, read off the partitions of the layout."""
    laid = layout.ordered_files(keyed(spark, sf).select(*SID, "k1", "k2"), FILES, [F.col(c) for c in ("k1", "k2", *SID)])
    at = F.monotonically_increasing_id()
    return laid.select(
        *SID, "k1", "k2", F.spark_partition_id().alias("file"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))


@query("shuffled_files", f"""
WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {sql_unit("doc_id", "shuffle")}, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
SELECT doc_id, (pos * {FILES} // n)::INT AS file, row_number() OVER (PARTITION BY pos * {FILES} // n ORDER BY pos) - 1 AS place FROM p""")
def shuffled_files(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id")
    draw = hashing.uniform(1, [F.col("doc_id")], "shuffle")
    laid = layout.ordered_files(docs.withColumn("draw", draw), FILES, [F.col("draw"), F.col("doc_id")])
    at = F.monotonically_increasing_id()
    return laid.select("doc_id", F.spark_partition_id().alias("file"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))


HASHED_FILES_SQL = f"""
k AS (SELECT source, lang, count(*) * {FILES} > (SELECT count(*) FROM documents) AS heavy FROM documents GROUP BY ALL),
f AS (SELECT doc_id, source, lang, heavy, floor((CASE WHEN heavy THEN {sql_unit("source, lang, doc_id", "file")}
      ELSE {sql_unit("source, lang", "file")} END) * {FILES})::INT AS file FROM documents JOIN k USING (source, lang))"""


def source_files(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "source", "lang")
    return layout.hashed_files(docs, FILES, ["source", "lang"], ["doc_id"])


@query("hashed_files", "WITH " + HASHED_FILES_SQL + "SELECT doc_id, source, lang, heavy, file FROM f")
def hashed_files(spark, sf):
    """Documents by source and language; a pair that fills more than a file is dealt over all."""
    return source_files(spark, sf).select("doc_id", "source", "lang", "heavy", F.spark_partition_id().alias("file"))


@query("file_manifest", "WITH " + HASHED_FILES_SQL + """
SELECT file, count(*) AS rows, min(source || '/' || lang || '/' || doc_id) AS first, max(source || '/' || lang || '/' || doc_id) AS last
FROM f GROUP BY file""")
def file_manifest(spark, sf):
    laid = source_files(spark, sf).withColumn("key", F.concat_ws("/", "source", "lang", "doc_id"))
    return layout.manifest(laid, ["key"]).select("file", "rows", F.col("first.key").alias("first"), F.col("last.key").alias("last"))


@query("shuffled_rows", f"""
SELECT doc_id, n_chars, row_number() OVER (ORDER BY {sql_unit("doc_id", "shuffle")}, doc_id) AS place FROM documents""")
def shuffled_rows(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "n_chars")
    drawn = docs.withColumn("draw", hashing.uniform(1, [F.col("doc_id")], "shuffle"))
    return positions(drawn, [F.col("draw"), F.col("doc_id")], name="place").drop("draw")


@query("shuffled_order", f"""
SELECT doc_id, round({sql_unit("doc_id", "shuffle")}, 9) AS draw FROM documents""")
def shuffled_order(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id")
    return layout.shuffle_rows(docs, ["doc_id"]).select("doc_id", F.round("draw", 9).alias("draw"))


@query("repeated_epochs", """
SELECT page_id, length(html) AS chars, e::INT AS epoch FROM pages, range(1, 4) r(e)""")
def repeated_epochs(spark, sf):
    pages = fx.table(spark, sf, "pages").select("page_id", F.length("html").cast("bigint").alias("chars"))
    return layout.repeat_epochs(pages, 3)


@query("mixed_sources", """
WITH s AS (SELECT doc_id AS id, 0 AS source_no FROM documents UNION ALL SELECT page_id, 1 FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY id) AS source_pos FROM s)
SELECT id, source_no, source_pos, (source_pos - 1) // (CASE source_no WHEN 0 THEN 3 ELSE 1 END) AS cycle FROM n""")
def mixed_sources(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    pages = fx.table(spark, sf, "pages").select(F.col("page_id").alias("id"))
    return layout.mix_sources([docs, pages], [3, 1], [F.col("id")])


MIXED_ROWS = 1_000


@query("mixed_limited", f"""
WITH s AS (SELECT doc_id AS id, 0 AS source_no FROM documents UNION ALL SELECT page_id, 1 FROM pages
  UNION ALL SELECT vec_id, 2 FROM embeddings),
n AS (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY id) AS source_pos FROM s),
c AS (SELECT *, (source_pos - 1) // (CASE source_no WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 5 END) AS cycle FROM n),
p AS (SELECT *, row_number() OVER (ORDER BY cycle, source_no, source_pos) AS place FROM c)
SELECT id, source_no, source_pos, cycle, place FROM p WHERE place <= {MIXED_ROWS}""")
def mixed_limited(spark, sf):
    """The first rows of the mix, by the formula of their place."""
    sources = [fx.table(spark, sf, t).select(F.col(c).alias("id"))
               for t, c in (("documents", "doc_id"), ("pages", "page_id"), ("embeddings", "vec_id"))]
    return layout.mix_sources(sources, [3, 1, 5], [F.col("id")], MIXED_ROWS, place="place", ordered=False)


BOUNDARIES = layout.bucket_boundaries()
SIZES = layout.batch_sizes(2000, BOUNDARIES)

BATCH_SQL = f"""
l AS (SELECT doc_id, line_no, codes, len(codes) AS length,
      len(list_filter({BOUNDARIES}, lambda b: b <= len(codes)))::INT AS bucket FROM coded),
b AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY doc_id, line_no) - 1) // {SIZES}[bucket + 1] AS batch_no FROM l),
w AS (SELECT *, count(*) OVER g AS size, max(length) OVER g AS width FROM b WINDOW g AS (PARTITION BY bucket, batch_no))"""


def codes(spark, sf):
    chars, _ = fx.dictionaries(spark, sf)
    rows = fx.joined_text(spark, sf)
    return rows.select(*SID, encode.encode_chars(F.col("text"), lookup.char_table(chars)).alias("chars"))


@query("length_batches", "WITH " + BATCH_SQL + """
SELECT bucket, batch_no, size, width::INT AS width, doc_id, line_no, length::INT AS length,
       array_to_string(list_concat(codes, list_transform(range(width - length), lambda i: 0::BIGINT)), ',') AS chars FROM w""", ("coded",))
def length_batches(spark, sf):
    batches = layout.bucket_batches(
        codes(spark, sf), [F.col(c) for c in SID], boundaries=BOUNDARIES, sizes=SIZES, keep=SID)
    rows = batches.select("bucket", "batch_no", "size", "width", F.inline("rows"))
    return rows.withColumn("chars", joined(F.col("chars")))


@query("batch_stats", "WITH " + BATCH_SQL + """
SELECT bucket, batch_no, count(*) AS size, max(length)::INT AS width, sum(width - length)::BIGINT AS padding FROM w GROUP BY bucket, batch_no""", ("coded",))
def batch_stats(spark, sf):
    return layout.batch_shapes(codes(spark, sf), [F.col(c) for c in SID], boundaries=BOUNDARIES, sizes=SIZES)


@query("fixed_batches", """
WITH b AS (SELECT *, (row_number() OVER (ORDER BY doc_id, line_no) - 1) // 5 AS batch_no FROM coded)
SELECT batch_no, count(*) AS size, max(n + 2)::INT AS width FROM b GROUP BY batch_no""", ("coded",))
def fixed_batches(spark, sf):
    batches = layout.bucket_batches(codes(spark, sf), [F.col(c) for c in SID], boundaries=[], sizes=[5])
    return batches.select("batch_no", "size", "width")


@query("length_mask", "WITH " + BATCH_SQL + """
SELECT doc_id, line_no, width::INT AS width, (width - length)::BIGINT AS masked,
       (width - length) * -1e9::DOUBLE + 0.0::DOUBLE AS mask_sum FROM w""", ("coded",))
def length_mask(spark, sf):
    batches = layout.bucket_batches(
        codes(spark, sf), [F.col(c) for c in SID], boundaries=BOUNDARIES, sizes=SIZES, keep=SID)
    rows = batches.select("width", F.inline("rows"))
    masked = rows.withColumn("mask", layout.length_mask(F.col("length"), F.col("width")))
    return masked.select(
        *SID, "width", F.size(F.filter("mask", lambda m: m < 0)).cast("bigint").alias("masked"),
        F.aggregate("mask", F.lit(0.0), lambda a, m: a + m).alias("mask_sum"))
