"""File sources and sinks: each query writes data derived from the tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.arrays import joined
from ..operators import decode, encode, lattice
from ..operators.sampling import default_rank
from ..plans import dictionary
from ..sources import dicts, examples, pipe, records, tfrecord
from ..sources.scratch import materialise, scratch_path
from ..streaming.counts import read_versions, write_versions
from .base import query
from .encoding import MASK_SQL, coded
from .selection import RANK_SQL
from ..operators.masking import mask_plan

SID = fx.SID


def write_dumps(spark, sf, compression: str = "gzip") -> str:
    """Dumps as text files whose records end in ``EOS`` lines."""
    path = scratch_path(spark, "dumps")
    body = F.left("raw", F.length("raw") - len(records.RECORD_END) + 1)
    out = fx.dumps(spark, sf).select(body.alias("value")).write
    out.option("lineSep", records.RECORD_END).option("compression", compression).text(path)
    return path


@query("records_roundtrip", """
SELECT '# S-ID:' || doc_id || '-' || line_no AS comment, count(*) AS nodes, sum(n)::BIGINT AS chars
FROM nodes GROUP BY doc_id, line_no""", ("nodes",))
def records_roundtrip(spark, sf):
    good, _ = lattice.quarantine(lattice.parse_lattice(records.read_records(spark, write_dumps(spark, sf)), fields=("surface",)))
    chars = F.aggregate("nodes", F.lit(0).cast("bigint"), lambda a, n: a + F.length(n["surface"]))
    return good.select("comment", F.size("nodes").cast("bigint").alias("nodes"), chars.alias("chars"))


@query("streamed_counts", "SELECT kind, value, cnt FROM counts", ("counts",))
def streamed_counts(spark, sf):
    """The dictionary counts as a stream over the folder, two files a trigger, each adding what it changed."""
    stored = scratch_path(spark, "counts")
    write_versions(spark, write_dumps(spark, sf), stored, scratch_path(spark, "stream"), 2).awaitTermination()
    return read_versions(spark, stored)


@query("carried_comments", """
WITH a AS (SELECT doc_id, line_no, line, row_number() OVER (ORDER BY doc_id, line_no) AS r, '# doc ' || doc_id AS comment FROM lines)
SELECT comment, line AS raw, count(*) AS rows FROM a GROUP BY comment, line""", ("lines",))
def carried_comments(spark, sf):
    path = scratch_path(spark, "annotated")
    rows = fx.lines(spark, sf).withColumn("value", F.when(
        F.col("line_no") == F.min("line_no").over(fx.by_document()),
        F.concat(F.lit("# doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("line"))).otherwise(F.col("line")))
    ordered = rows.repartition(8, "doc_id").sortWithinPartitions(*SID)
    ordered.select("value").write.text(path)
    back = records.read_annotated_lines(spark, path)
    return back.groupBy("comment", "raw").agg(F.count("*").alias("rows"))


@query("numbered_lines", """
WITH c AS (SELECT surface, count(*) AS cnt FROM tokens0 GROUP BY surface)
SELECT row_number() OVER (ORDER BY cnt DESC, surface) - 1 AS line_no, surface || chr(9) || cnt AS value FROM c""", ("tokens0",))
def numbered_lines(spark, sf):
    return records.numbered_lines(spark, write_word_counts(spark, sf), across=True).select("line_no", "value")


def word_counts(spark, sf):
    return fx.tokens(spark, sf).groupBy(F.col("surface").alias("word")).agg(F.count("*").alias("cnt"))


def write_word_counts(spark, sf, count_first: bool = False) -> str:
    """Word counts, most frequent first, in files that follow each other by name."""
    path = scratch_path(spark, "words")
    pair = ["word", F.col("cnt").cast("string")]
    line = F.concat_ws("\t", *(reversed(pair) if count_first else pair))
    keys = [F.col("cnt").desc(), F.col("word")]
    ordered = materialise(word_counts(spark, sf), "word-counts").repartitionByRange(8, *keys).sortWithinPartitions(*keys)
    ordered.select(line.alias("value")).write.text(path)
    return path


@query("dict_tsv", """
WITH c AS (SELECT surface, count(*) AS cnt FROM tokens0 GROUP BY surface),
o AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, surface) - 1 AS position FROM c)
SELECT position, CASE WHEN instr(surface, '?') < 2 THEN surface
  ELSE array_to_string(list_sort(list_filter(string_split(surface, '?'), lambda p: p <> '')), '?') END AS key, cnt FROM o""", ("tokens0",))
def dict_tsv(spark, sf):
    return dicts.read_dict_tsv(spark, write_word_counts(spark, sf), fixed=True)


@query("vocab_tsv", """
WITH c AS (SELECT surface, count(*) AS cnt FROM tokens0 GROUP BY surface),
o AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, surface) - 1 AS position FROM c),
k AS (SELECT position, CASE WHEN instr(surface, '?') < 2 THEN surface
  ELSE array_to_string(list_sort(list_filter(string_split(surface, '?'), lambda p: p <> '')), '?') END AS key, cnt FROM o),
v AS (SELECT * FROM k WHERE position < 100 OR instr(key, '?') > 1 OR instr(key, '/') < 2
      OR split_part(key, '/', 1) <> substr(key, instr(key, '/') + 1)),
n AS (SELECT *, row_number() OVER (ORDER BY position) - 1 AS id FROM v)
SELECT position, key, cnt, id FROM n WHERE id < 5000""", ("tokens0",))
def vocab_tsv(spark, sf):
    return dicts.read_vocab_tsv(spark, write_word_counts(spark, sf, count_first=True), 100, 5000)


def write_dictionaries(spark, sf) -> str:
    base = scratch_path(spark, "dicts")
    dicts.write_dicts(*dictionary.dictionaries(fx.sentences(spark, sf, lattice.COUNT_FIELDS)), base)
    return base


@query("chardic_file", "SELECT ch, id::INT AS id FROM chardict", ("chardict",))
def chardic_file(spark, sf):
    return dicts.read_chardic(spark, write_dictionaries(spark, sf) + "/chars.bycode.dic")


@query("vdic_file", """
SELECT id, tag AS label FROM tagdict WHERE kind = 'pos' UNION ALL SELECT 0, 'NUL'""", ("tagdict",))
def vdic_file(spark, sf):
    return dicts.read_vdic(spark, write_dictionaries(spark, sf) + "/pos.vdic")


@query("difficulty_file", "WITH " + RANK_SQL + """
SELECT surface, lower(surface) AS reading, lower(surface) AS dicform, pos, subpos, ctype, cform, rank,
       (SELECT default_rank FROM mx)::INT AS default_rank FROM difficulty""", ("tokens",))
def difficulty_file(spark, sf):
    path = scratch_path(spark, "difficulty")
    dicts.write_difficulty(fx.token_ranks(spark, sf), path)
    back = dicts.read_difficulty(spark, path)
    return back.withColumn("default_rank", F.lit(default_rank(back)))


@query("tfrecord_roundtrip", "WITH " + MASK_SQL + f"""
SELECT '2,' || string_agg(coalesce(d.id, 1)::VARCHAR, ',' ORDER BY cp) || ',3' AS chars,
       '0,' || string_agg(op::VARCHAR, ',' ORDER BY cp) || ',0' AS bert, (count(*) + 2)::INT AS length, 5 AS kinds
FROM ops LEFT JOIN chardict d USING (ch) GROUP BY doc_id, line_no""", ("chars", "chardict"))
def tfrecord_roundtrip(spark, sf):
    path = scratch_path(spark, "examples")
    rows = coded(spark, sf, fields=encode.EXAMPLE_FIELDS).filter(F.col("reason").isNull())
    examples.write_examples(rows.withColumn("bert", mask_plan(F.col("path"), SID)), path)
    back = examples.parse_examples(examples.read_examples(spark, path), 5)
    return back.select(joined(F.col("chars")).alias("chars"), joined(F.col("bert")).alias("bert"), "length",
                       F.size("tags").alias("kinds"))


@query("sequence_roundtrip", """
SELECT conv_id, turn, role, text FROM conversations""")
def sequence_roundtrip(spark, sf):
    """One record per conversation: its id as context, turns, roles and texts as feature lists."""
    path = scratch_path(spark, "conversations")
    turns = fx.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    rows = turns.select(
        "conv_id", F.transform("t", lambda x: F.array(x["turn"])).alias("turn"),
        F.transform("t", lambda x: F.array(x["role"])).alias("role"),
        F.transform("t", lambda x: F.array(x["text"])).alias("text"))
    tfrecord.write_tfrecords(rows, path, sequence=True)
    back = tfrecord.read_tfrecords(spark, path, rows.schema, sequence=True)
    flat = [F.flatten(c).alias(c) for c in ("turn", "role", "text")]
    return back.select("conv_id", F.inline(F.arrays_zip(*flat)))


@query("token_text_files", f"""
WITH fit AS (SELECT doc_id, line_no FROM tokens GROUP BY ALL)
SELECT surface || ' * * ' || CASE WHEN n >= 6 THEN 'NUL' ELSE pos END || ' 0 ' || subpos || ' 0 ' || ctype || ' 0 ' || cform || ' 0 NIL' AS value,
       count(*) AS rows FROM tokens JOIN fit USING (doc_id, line_no) GROUP BY value
UNION ALL SELECT 'EOS', count(*) FROM fit""", ("tokens",))
def token_text_files(spark, sf):
    _, tags = fx.dictionaries(spark, sf)
    rows = coded(spark, sf).filter(F.col("reason").isNull())
    text = F.array_join(F.transform("path", lambda n: n["surface"]), "")
    tokens = decode.decode_tokens(rows.select(*SID, text.alias("text"), "tags"), tags, "text")
    path = scratch_path(spark, "juman")
    tokens.select(decode.token_lines(F.lit(""), F.col("tokens")).alias("value")).write.text(path, compression="gzip")
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("rows"))


@query("pipe_lines", """
SELECT translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS value, count(*) AS rows FROM lines GROUP BY value""", ("lines",))
def pipe_lines(spark, sf):
    out = pipe.pipe_lines(fx.lines(spark, sf).select(F.col("line").alias("value")), "tr a-z A-Z")
    return out.groupBy("value").agg(F.count("*").alias("rows"))


@query("pipe_files", """
SELECT translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS value, count(*) AS rows FROM lines GROUP BY value""", ("lines",))
def pipe_files(spark, sf):
    source, target = scratch_path(spark, "plain"), scratch_path(spark, "piped")
    fx.lines(spark, sf).select(F.col("line").alias("value")).write.text(source, compression="gzip")
    pipe.write_bytes(pipe.pipe_files(spark, source, "tr a-z A-Z"), target, ".txt")
    return spark.read.text(target).groupBy("value").agg(F.count("*").alias("rows"))


@query("raw_bytes", """
SELECT sum(strlen(line) + 1)::BIGINT AS bytes, count(*) AS lines FROM lines""", ("lines",))
def raw_bytes(spark, sf):
    source = scratch_path(spark, "plain")
    fx.lines(spark, sf).select(F.col("line").alias("value")).write.text(source, compression="gzip")
    chunks = pipe.read_bytes(spark, source)
    ends = F.length(F.col("bytes")) - F.length(F.expr("replace(cast(bytes as string), '\n', '')").cast("binary"))
    return chunks.agg(F.sum(F.length("bytes")).alias("bytes"), F.sum(ends).alias("lines"))


