"""Characters and tags to ids, hashes, masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import hashing, text
from ..functions.arrays import joined
from ..operators import encode, lattice, lookup, masking
from .base import NARROW, WIDE, query, sql_unit

SID = fx.SID


def coded(spark, sf, max_length: int | None = None, fields=encode.TAGGED_FIELDS, **options):
    chars, tags = fx.dictionaries(spark, sf)
    found = lattice.best_path(fx.sentences(spark, sf, fields))
    return encode.encode_sentences(found, chars, tags, SID, max_length, **options)


@query("codepoints", """
SELECT ch, format('{}:{:x}', ch, unicode(ch)) AS label, count(*) AS cnt FROM chars GROUP BY ch""", ("chars",))
def codepoints(spark, sf):
    chars = fx.joined_text(spark, sf).select(F.explode(text.codepoints(F.col("text"))).alias("ch"))
    counts = chars.groupBy("ch").agg(F.count("*").alias("cnt"))
    return counts.select("ch", text.codept_repr(F.col("ch")).alias("label"), "cnt")


@query("encoded_sentences", """
SELECT doc_id, line_no, (n + 2)::INT AS codes, array_to_string(codes, ',') AS chars FROM coded""", ("coded",))
def encoded_sentences(spark, sf):
    """Documents to encoded sentences: tokens, counts, dictionary, ids."""
    chars, _ = fx.dictionaries(spark, sf)
    ids = encode.encode_chars(F.col("text"), lookup.char_table(chars))
    rows = fx.joined_text(spark, sf)
    return rows.select(*SID, (F.length("text") + 2).alias("codes"), joined(ids).alias("chars"))


@query("too_long", """
SELECT doc_id, line_no, (n + 2)::INT AS codes, 'too_long' AS reason FROM coded WHERE n + 2 > 600""", ("coded",))
def too_long(spark, sf):
    """What a length limit of 600 sets apart."""
    done = coded(spark, sf, 600).filter(F.col("reason").isNotNull())
    return done.select(*SID, F.size("codes").alias("codes"), "reason")


@query("in_range", """
SELECT doc_id, line_no, (n + 2)::INT AS codes, n + 2 BETWEEN 10 AND 200 AS fits FROM coded""", ("coded",))
def in_range(spark, sf):
    sizes = fx.joined_text(spark, sf).select(*SID, (F.length("text") + 2).alias("codes"))
    return sizes.withColumn("fits", encode.in_range(F.col("codes"), 10, 200))


@query("encoded_paths", """
SELECT doc_id, line_no, (n + 2)::INT AS codes, array_to_string(codes, ',') AS chars FROM coded""", ("coded",))
def encoded_paths(spark, sf):
    done = coded(spark, sf).filter(F.col("reason").isNull())
    return done.select(*SID, F.size("codes").alias("codes"), joined(F.col("chars")).alias("chars"))


@query("raw_codes", """
SELECT doc_id, line_no, array_to_string(list(coalesce(d.id, 2) ORDER BY cp), ',') AS codes
FROM chars LEFT JOIN benchdict d USING (ch) GROUP BY doc_id, line_no""",
       ("chars", "benchdict"))
def raw_codes(spark, sf):
    """Documents by the characters of another table, so that there are misses."""
    ids = encode.encode_chars(F.col("text"), lookup.char_table(fx.benchmark_chars(spark, sf), 2), bos_eos=False, default=2)
    return fx.joined_text(spark, sf).select(*SID, joined(ids).alias("codes"))


@query("char_join", """
SELECT ch, coalesce(id, 1) AS id, cnt FROM (SELECT ch, count(*) AS cnt FROM chars GROUP BY ch)
LEFT JOIN (SELECT ch, id::INT AS id FROM benchdict) USING (ch)""", ("chars", "benchdict"))
def char_join(spark, sf):
    chars = fx.joined_text(spark, sf).select(F.explode(text.codepoints(F.col("text"))).alias("ch"))
    counts = chars.groupBy("ch").agg(F.count("*").alias("cnt"))
    return lookup.char_join(counts, fx.benchmark_chars(spark, sf))


@query("tag_join", """
SELECT kind, tag, coalesce(id, 0) AS id, cnt FROM (
  SELECT CASE kind WHEN 'conjtype' THEN 'ctype' WHEN 'conjform' THEN 'cform' ELSE kind END AS kind,
         value AS tag, cnt FROM counts WHERE kind <> 'cpt')
LEFT JOIN (SELECT kind, tag, id::INT AS id FROM tagdict WHERE tag <> 'mixed') USING (kind, tag)""", ("counts", "tagdict"))
def tag_join(spark, sf):
    pairs = encode.TAG_KINDS
    nodes = fx.sentences(spark, sf, pairs).select(F.inline("nodes"))
    rows = nodes.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("tag")) for k in pairs])))
    counts = rows.groupBy("kind", "tag").agg(F.count("*").alias("cnt"))
    return lookup.tag_join(counts, fx.dictionaries(spark, sf)[1].filter("tag <> 'mixed'"))


@query("resolved_tags", """
WITH t AS (
  SELECT doc_id, line_no, cp, seg,
    CASE WHEN n >= 6 THEN 0 ELSE p.id END AS pos, s.id AS subpos, c.id AS ctype, f.id AS cform
  FROM chars
  JOIN (SELECT tag, id FROM tagdict WHERE kind = 'pos') p ON p.tag = chars.pos
  JOIN (SELECT tag, id FROM tagdict WHERE kind = 'subpos') s ON s.tag = chars.subpos
  JOIN (SELECT tag, id FROM tagdict WHERE kind = 'ctype') c ON c.tag = chars.ctype
  JOIN (SELECT tag, id FROM tagdict WHERE kind = 'cform') f ON f.tag = chars.cform)
SELECT doc_id, line_no, '0,0,0,0,0,' ||
       string_agg(concat_ws(',', seg, pos, subpos, ctype, cform), ',' ORDER BY cp) || ',0,0,0,0,0' AS tags
FROM t GROUP BY doc_id, line_no""", ("chars", "tagdict"))
def resolved_tags(spark, sf):
    return coded(spark, sf).filter(F.col("reason").isNull()).select(*SID, joined(F.col("tags")).alias("tags"))


@query("unk_flags", f"""
WITH f AS (SELECT *, unnest(range(n)) AS p FROM nodes)
SELECT doc_id, line_no, count(*) + 2 AS flags, sum(unk::BIGINT)::BIGINT AS unknown,
       '0,' || string_agg(unk::INT::VARCHAR, ',' ORDER BY node_id, p) || ',0' AS unks
FROM f GROUP BY doc_id, line_no""", ("nodes",))
def unk_flags(spark, sf):
    rows = coded(spark, sf, fields=encode.EXAMPLE_FIELDS).filter(F.col("reason").isNull())
    return rows.select(
        *SID, F.size("unks").cast("bigint").alias("flags"),
        F.aggregate("unks", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("unknown"),
        joined(F.col("unks")).alias("unks"),
    )


@query("path_unk_flags", f"""
SELECT doc_id, line_no, count(*) + 2 AS flags, '0,' || string_agg((pos = 'mixed')::INT::VARCHAR, ',' ORDER BY cp) || ',0' AS unks
FROM chars GROUP BY doc_id, line_no""", ("chars",))
def path_unk_flags(spark, sf):
    rows = coded(spark, sf, fields=encode.EXAMPLE_FIELDS, path_only_unks=True).filter(F.col("reason").isNull())
    return rows.select(*SID, F.size("unks").cast("bigint").alias("flags"), joined(F.col("unks")).alias("unks"))


@query("char_tags", """
SELECT seg, kind, tag, count(*) AS cnt FROM (
  SELECT seg, unnest(['pos', 'subpos', 'ctype', 'cform']) AS kind, unnest([pos, subpos, ctype, cform]) AS tag FROM (
    SELECT *, CASE WHEN p = 0 THEN 1 WHEN p = n - 1 THEN 3 ELSE 2 END AS seg FROM (
      SELECT *, unnest(range(n)) AS p FROM nodes)))
GROUP BY seg, kind, tag""", ("nodes",))
def char_tags(spark, sf):
    _, tags = fx.dictionaries(spark, sf)
    found, tables = lookup.tag_ids(fx.sentences(spark, sf, ("start", "end", *encode.TAG_KINDS)), tags, encode.TAG_KINDS, SID)
    rows = found.select(F.inline(encode.char_tag_rows(F.col("nodes"), tables)))
    # characters of equal tags are counted together before a row for each kind is made of them
    seen = rows.groupBy("seg", *encode.TAG_KINDS).agg(F.count("*").alias("n"))
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("id")) for k in encode.TAG_KINDS]
    counts = seen.select("seg", "n", F.inline(F.array(*kinds))).groupBy("seg", "kind", "id").agg(F.sum("n").alias("cnt"))
    labels = tags.select("kind", "id", "tag")
    return counts.join(labels, ["kind", "id"]).select("seg", "kind", "tag", "cnt")


@query("seg_tags", """
SELECT doc_id, line_no, string_agg(seg::VARCHAR, '' ORDER BY cp) AS seg FROM chars GROUP BY doc_id, line_no""", ("chars",))
def seg_tags(spark, sf):
    found = lattice.best_path(fx.sentences(spark, sf, lattice.PATH_FIELDS))
    tags = F.flatten(F.transform("path", lambda n: F.transform(
        F.sequence(n["start"], n["end"] - 1), lambda c: encode.seg_tag(c, n["start"], n["end"]))))
    return found.select(*SID, joined(tags, "").alias("seg"))


@query("width_normalise", f"""
WITH w AS (SELECT doc_id, line_no, tok_no, start_idx, surface,
    translate(surface, '{NARROW}', '{WIDE}') AS wide FROM tokens),
f AS (SELECT *, regexp_full_match(wide, '[！-｟]*') AS is_wide,
    {sql_unit("doc_id, line_no, start_idx", "width")} < 0.5 AS taken FROM w)
SELECT doc_id, line_no, count(*) FILTER (is_wide) AS wide_tokens, count(*) FILTER (is_wide AND taken) AS changed,
       string_agg(CASE WHEN is_wide AND taken THEN translate(wide, '{WIDE}', '{NARROW}') ELSE wide END, ' ' ORDER BY tok_no) AS text
FROM f GROUP BY doc_id, line_no""", ("tokens",))
def width_normalise(spark, sf):
    toks = fx.lines(spark, sf).select(*SID, fx.token_structs(F.col("line")).alias("toks"))
    wide = F.transform("toks", lambda t: F.struct(
        text.han2zen(t["surface"]).alias("wide"),
        hashing.uniform(1, [F.col("doc_id"), F.col("line_no"), t["start"]], "width").alias("u")))
    rows = toks.select(*SID, F.transform(wide, lambda t: F.struct(
        t["wide"].alias("wide"), text.is_full_width(t["wide"]).alias("is_wide"), t["u"].alias("u"),
        encode.random_zen2han(t["wide"], 0.5, t["u"]).alias("new"))).alias("w"))
    def count(test):
        return F.size(F.filter("w", test)).cast("bigint")
    return rows.select(
        *SID, count(lambda t: t["is_wide"]).alias("wide_tokens"),
        count(lambda t: t["is_wide"] & (t["u"] < 0.5)).alias("changed"),
        F.array_join(F.transform("w", lambda t: t["new"]), " ").alias("text"),
    )


@query("augmented_codes", f"""
WITH k AS (SELECT chars.*, coalesce(d.id, 1) AS id,
    n = 1 AND chars.pos = 'mixed' AND {sql_unit("doc_id, line_no, start_idx", "unk")} < 0.5 AS hidden
  FROM chars LEFT JOIN chardict d USING (ch))
SELECT doc_id, line_no, '2,' || string_agg((CASE WHEN hidden THEN 1 ELSE id END)::VARCHAR, ',' ORDER BY cp) || ',3' AS chars
FROM k GROUP BY doc_id, line_no""", ("chars", "chardict"))
def augmented_codes(spark, sf):
    rows = coded(spark, sf, fields=encode.EXAMPLE_FIELDS, augment=encode.Augment(unk_prob=0.5)).filter(F.col("reason").isNull())
    return rows.select(*SID, joined(F.col("chars")).alias("chars"))


HASH_SQL = """
m AS (SELECT doc_id, line_no, n, codes, list_transform(codes, lambda a: (a::HUGEINT * 3432918353 % 4294967296)::BIGINT) AS k FROM coded),
k AS (SELECT doc_id, line_no, n, codes, list_transform(k, lambda a:
    ((((a * 32768) % 4294967296 + (a >> 17))::HUGEINT * 461845907) % 4294967296)::BIGINT) AS k FROM m),
h AS (SELECT doc_id, line_no, n, codes, list_reduce(list_prepend(3735928559::BIGINT, k), lambda s, x: (
    (((xor(((((s * 8192) % 4294967296 + (s >> 19)) * 5 + 3864292196) % 4294967296), x) * 8192) % 4294967296
     + (xor(((((s * 8192) % 4294967296 + (s >> 19)) * 5 + 3864292196) % 4294967296), x) >> 19)) * 5 + 3864292196) % 4294967296)) AS s,
    ((n + 2)::HUGEINT * 3432918353 % 4294967296)::BIGINT AS t FROM k),
u AS (SELECT doc_id, line_no, n, codes, xor(s, ((((t * 32768) % 4294967296 + (t >> 17))::HUGEINT * 461845907) % 4294967296)::BIGINT) AS h FROM h),
hashed AS (SELECT doc_id, line_no, n, codes, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::INT AS hash,
    (((h & 1073741568) >> 8)::DOUBLE / 4194303)::FLOAT AS unit FROM u)
"""


@query("seq_hash", "WITH " + HASH_SQL + "SELECT doc_id, line_no, hash, round(unit::DOUBLE, 6) AS unit FROM hashed", ("coded",))
def seq_hash(spark, sf):
    chars, _ = fx.dictionaries(spark, sf)
    ids = encode.encode_chars(F.col("text"), lookup.char_table(chars))
    rows = fx.joined_text(spark, sf)
    hashed = rows.select(*SID, hashing.seq_hash(ids, narrow=True).alias("hash"))
    unit = hashing.hash_unit(F.col("hash")).cast("double")
    return hashed.select(*SID, "hash", F.round(unit, 6).alias("unit"))


MASK_SQL = f"""
tk AS (SELECT chars.*, start_idx AS s0, {sql_unit("doc_id, line_no, start_idx", "token")} AS ut,
       {sql_unit("doc_id, line_no, start_idx", "token", 1)} AS vt,
       {sql_unit("doc_id, line_no, cp", "char")} AS uc, {sql_unit("doc_id, line_no, cp", "char", 1)} AS vc FROM chars),
ops AS (SELECT doc_id, line_no, cp, ch, CASE
    WHEN ut < 0.07::DOUBLE THEN CASE WHEN vt < 0.1 THEN 1 WHEN vt < 0.2 THEN 2 ELSE 3 END
    WHEN uc < 0.08::DOUBLE * 0.93::DOUBLE THEN CASE WHEN vc < 0.1 THEN 1 WHEN vc < 0.2 THEN 2 ELSE 3 END
    ELSE 0 END AS op FROM tk)
"""


@query("mask_plan", "WITH " + MASK_SQL + """
SELECT doc_id, line_no, '0,' || string_agg(op::VARCHAR, ',' ORDER BY cp) || ',0' AS bert FROM ops GROUP BY doc_id, line_no""", ("chars",))
def mask_plan(spark, sf):
    found = lattice.best_path(fx.sentences(spark, sf, lattice.PATH_FIELDS))
    return found.select(*SID, joined(masking.mask_plan(F.col("path"), SID)).alias("bert"))


@query("masked_chars", "WITH " + MASK_SQL + f""",
best AS (SELECT ch, id, row_number() OVER (ORDER BY cnt DESC, ch) AS r, sqrt(cnt + 100) AS w FROM chardict),
cum AS (SELECT id, r, sum(w) OVER (ORDER BY r) / sum(w) OVER () AS upto FROM best),
tab AS (SELECT list(id ORDER BY r) AS ids, list(upto ORDER BY r) AS uptos FROM cum),
x AS (SELECT o.doc_id, o.line_no, o.cp, op, coalesce(d.id, 1) AS id,
        {sql_unit("o.doc_id, o.line_no, o.cp + 1", "random")} AS u FROM ops o LEFT JOIN chardict d USING (ch)),
y AS (SELECT doc_id, line_no, cp, CASE op WHEN 3 THEN 99999
        WHEN 2 THEN ids[least(len(list_filter(uptos, lambda z: z <= u)), len(ids) - 1) + 1] ELSE id END AS new, id FROM x, tab)
SELECT doc_id, line_no, '2,' || string_agg(new::VARCHAR, ',' ORDER BY cp) || ',3' AS chars,
       '2,' || string_agg(id::VARCHAR, ',' ORDER BY cp) || ',3' AS chars_orig
FROM y GROUP BY doc_id, line_no""", ("chars", "chardict"))
def masked_chars(spark, sf):
    chars, _ = fx.dictionaries(spark, sf)
    rows = coded(spark, sf).filter(F.col("reason").isNull())
    planned = rows.select(*SID, "chars", masking.mask_plan(F.col("path"), SID).alias("bert"))
    done = masking.masked(planned, masking.random_char_table(chars), 99999, SID)
    return done.select(*SID, joined(F.col("chars")).alias("chars"), joined(F.col("chars_orig")).alias("chars_orig"))
