"""Counting, dictionaries, lattices."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.arrays import joined
from ..operators import lattice, vocab
from ..plans import dictionary
from ..sources.scratch import materialise
from .base import query

SID = fx.SID


@query("feature_counts", "SELECT kind, value, cnt FROM counts", ("counts",))
def feature_counts(spark, sf):
    return vocab.feature_counts(fx.sentences(spark, sf, lattice.COUNT_FIELDS))


@query("char_dictionary", "SELECT ch, cnt, id::INT AS id, format('{}:{:x}', ch, unicode(ch)) AS label FROM chardict", ("chardict",))
def char_dictionary(spark, sf):
    return dictionary.dictionaries(fx.sentences(spark, sf, lattice.COUNT_FIELDS))[1]


@query("char_dictionary_by_freq", """
SELECT ch, cnt, (3 + row_number() OVER (ORDER BY cnt DESC, ch))::INT AS id,
       format('{}:{:x}', ch, unicode(ch)) AS label FROM charset""", ("charset",))
def char_dictionary_by_freq(spark, sf):
    return dictionary.dictionaries(fx.sentences(spark, sf, lattice.COUNT_FIELDS))[0]


@query("tag_dictionary", "SELECT kind, tag, cnt, id::INT AS id FROM tagdict", ("tagdict",))
def tag_dictionary(spark, sf):
    return dictionary.dictionaries(fx.sentences(spark, sf, lattice.COUNT_FIELDS))[2]


@query("top_per_kind", """
SELECT kind, value, cnt FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY cnt DESC, value) AS r FROM counts)
WHERE r <= 3""", ("counts",))
def top_per_kind(spark, sf):
    return vocab.top_per_kind(vocab.feature_counts(fx.sentences(spark, sf, lattice.COUNT_FIELDS)), 3)


@query("lattice_nodes", """
SELECT doc_id, line_no, node_id, prev_id::VARCHAR AS prev, start_idx AS start_at, start_idx + n AS end_at, surface,
       lower(surface) || '/' || surface AS canonical, lower(surface) AS reading, lower(surface) AS dicform,
       pos, subpos, ctype, cform,
       CASE pos WHEN 'mixed' THEN 1 WHEN 'word' THEN 2 WHEN 'num' THEN 3 ELSE 4 END AS pos_num,
       (n + 0.5)::DOUBLE AS feature_score, CASE WHEN ctype = 'cap' THEN -(n + 0.5)::DOUBLE END AS lm_score,
       -(tok_no % 100 + 0.25)::DOUBLE AS analysis_score, node_rank::VARCHAR AS ranks,
       CASE WHEN unk THEN '未知語,' ELSE '' END || '正規化代表表記=' || replace(lower(surface), '|', '/') || '/' || replace(lower(surface), '|', '/') AS features
FROM nodes""", ("nodes",))
def lattice_nodes(spark, sf):
    n = fx.sentences(spark, sf).select(*SID, F.inline("nodes"))
    shown = F.transform("features", lambda f: F.concat_ws("=", f["key"], f["value"]))
    return n.select(
        *SID, F.col("node_id").cast("bigint").alias("node_id"), joined(F.col("prev")).alias("prev"),
        F.col("start").cast("bigint").alias("start_at"), F.col("end").cast("bigint").alias("end_at"),
        "surface", "canonical", "reading", "dicform", "pos", "subpos", "ctype", "cform", "pos_num",
        *[
            F.nanvl(F.col(c), F.lit(None)).cast("double").alias(c)
            for c in ("feature_score", "lm_score", "analysis_score")
        ],
        joined(F.col("ranks")).alias("ranks"), F.array_join(shown, ",").alias("features"),
    )


@query("lattice_scores", """
SELECT doc_id, line_no, node_id, (-(tok_no % 100 + 0.25))::VARCHAR AS cumulative, 1 AS details,
       CASE WHEN ctype = 'cap' THEN 1 ELSE 0 END AS lm_scores
FROM nodes""", ("nodes",))
def lattice_scores(spark, sf):
    rows = F.transform(
        "nodes",
        lambda n: F.struct(
            n["node_id"].cast("bigint").alias("node_id"),
            joined(F.transform(lattice.cumulative_scores(n), lambda s: s.cast("decimal(9,2)"))).alias("cumulative"),
            F.size(lattice.score_details(n)).alias("details"),
            F.size(F.flatten(F.transform(lattice.score_details(n), lambda d: d["lm"]))).alias("lm_scores"),
        ),
    )
    fields = ("node_id", "feature_score", "lm_score", "analysis_score", "ranks")
    return fx.sentences(spark, sf, fields).select(*SID, F.inline(rows))


@query("bad_records", """
SELECT doc_id, line_no, '# S-ID:' || doc_id || '-' || line_no AS comment,
       CASE (doc_id * 7 + line_no) % 11 WHEN 0 THEN 'short_line' ELSE 'bad_number' END AS reason
FROM lines WHERE (doc_id * 7 + line_no) % 11 IN (0, 1)""", ("lines",))
def bad_records(spark, sf):
    pick = F.pmod(F.col("doc_id") * 7 + F.col("line_no"), F.lit(11))
    tail = F.when(pick == 0, "-\t1\t0\nEOS").when(pick == 1, "-\tx" + "\t0" * 16 + "\nEOS").otherwise("EOS")
    damaged = fx.dumps(spark, sf).withColumn(
        "raw", F.concat(F.expr("left(raw, length(raw) - 3)"), tail)
    )
    _, bad = lattice.quarantine(lattice.parse_lattice(damaged))
    return bad


@query("top_one", """
SELECT doc_id, line_no, count(*) AS nodes, string_agg(node_id::VARCHAR, ',' ORDER BY tok_no) AS ids
FROM nodes WHERE node_rank = 1 GROUP BY doc_id, line_no""", ("nodes",))
def top_one(spark, sf):
    kept = lattice.top_one(fx.sentences(spark, sf, ("node_id", "ranks")))
    return kept.select(
        *SID, F.size("nodes").cast("bigint").alias("nodes"),
        joined(F.transform("nodes", lambda n: n["node_id"])).alias("ids"),
    )


@query("best_path", """
SELECT doc_id, line_no, count(*) AS nodes, string_agg(node_id::VARCHAR, ',' ORDER BY tok_no) AS ids,
       string_agg(surface, ' ' ORDER BY tok_no) AS text
FROM nodes WHERE node_rank = 1 GROUP BY doc_id, line_no""", ("nodes",))
def best_path(spark, sf):
    found = lattice.best_path(fx.sentences(spark, sf, lattice.PATH_FIELDS))
    return found.select(
        *SID, F.size("path").cast("bigint").alias("nodes"),
        joined(F.transform("path", lambda n: n["node_id"])).alias("ids"),
        F.array_join(F.transform("path", lambda n: n["surface"]), " ").alias("text"),
    )


@query("picked_features", """
SELECT doc_id, line_no, count(*) AS nodes, string_agg(replace(lower(surface), '|', '/') || '/' || replace(lower(surface), '|', '/'), ' ' ORDER BY tok_no) AS norm,
       string_agg(surface, ' ' ORDER BY tok_no) AS surf,
       string_agg(lower(surface) || '/' || surface, ' ' ORDER BY tok_no) AS canonical
FROM tokens GROUP BY doc_id, line_no""", ("tokens",))
def picked_features(spark, sf):
    found = lattice.best_path(fx.sentences(spark, sf))

    def words(kind: str):
        return F.array_join(F.transform("path", lambda n: lattice.pick_feature(n, kind)), " ")

    return found.select(
        *SID, F.size("path").cast("bigint").alias("nodes"),
        words("norm").alias("norm"), words("surf").alias("surf"), words("canon").alias("canonical"),
    )


@query("freq_ranks", """
WITH c AS (SELECT surface AS token, count(*) AS cnt FROM tokens0 GROUP BY surface),
o AS (SELECT *, row_number() OVER w AS position, sum(cnt) OVER w AS run FROM c
      WINDOW w AS (ORDER BY cnt DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT sum(cnt) FILTER (position > 100) AS total, sum(cnt) FILTER (position <= 100) AS top FROM o)
SELECT token, cnt, position, (CASE WHEN position <= 100 THEN 0 ELSE
       greatest(least(((run - top) * 19)::BIGINT // total::BIGINT, 18), 0) + 1 END)::INT AS rank FROM o, t""", ("tokens0",))
def freq_ranks(spark, sf):
    counts = fx.tokens(spark, sf).groupBy(F.col("surface").alias("token")).agg(F.count("*").alias("cnt"))
    return vocab.freq_ranks(counts, 100, 20)


@query("part_ranks", """
WITH c AS (SELECT l_partkey AS token, sum(l_quantity)::BIGINT AS cnt FROM lineitem GROUP BY l_partkey),
o AS (SELECT *, row_number() OVER w AS position, sum(cnt) OVER w AS run FROM c
      WINDOW w AS (ORDER BY cnt DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT sum(cnt) FILTER (position > 5) AS total, sum(cnt) FILTER (position <= 5) AS top FROM o)
SELECT token, cnt, position, (CASE WHEN position <= 5 THEN 0 ELSE
       greatest(least(((run - top) * 9)::BIGINT // total::BIGINT, 8), 0) + 1 END)::INT AS rank FROM o, t""")
def part_ranks(spark, sf):
    items = fx.table(spark, sf, "lineitem")
    counts = items.groupBy(F.col("l_partkey").alias("token")).agg(F.sum("l_quantity").cast("bigint").alias("cnt"))
    return vocab.freq_ranks(counts, 5, 10)


@query("rank_classes", """
WITH c AS (SELECT surface AS token, count(*) AS cnt FROM tokens0 GROUP BY surface),
o AS (SELECT *, row_number() OVER w AS position, sum(cnt) OVER w AS run FROM c
      WINDOW w AS (ORDER BY cnt DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT sum(cnt) FILTER (position > 100) AS total, sum(cnt) FILTER (position <= 100) AS top FROM o)
SELECT token, cnt, (CASE WHEN position <= 100 THEN 0 ELSE
       greatest(least(((run - top) * 19)::BIGINT // total::BIGINT, 18), 0) + 1 END)::INT AS rank FROM o, t""", ("tokens0",))
def rank_classes(spark, sf):
    """Ranks of all tokens where only those of a cut count are put in order."""
    counts = fx.tokens(spark, sf).groupBy(F.col("surface").alias("token")).agg(F.count("*").alias("cnt"))
    return vocab.freq_ranks(counts, 100, 20, position=False)


@query("subsample_prob", """
WITH c AS (SELECT surface AS word, count(*) AS cnt FROM tokens0 GROUP BY surface),
f AS (SELECT word, cnt, cnt::DOUBLE / sum(cnt) OVER () AS f FROM c)
SELECT word, cnt, round(least(1.0, (sqrt(f / 1e-5) + 1) * (1e-5 / f)), 6) AS prob FROM f""", ("tokens0",))
def subsample_prob(spark, sf):
    words = materialise(fx.tokens(spark, sf).groupBy(F.col("surface").alias("word")).agg(F.count("*").alias("cnt")), "words")
    total = words.agg(F.sum("cnt")).scalar()
    return words.select("word", "cnt", F.round(vocab.subsample_prob(F.col("cnt"), total), 6).alias("prob"))
