"""Decoding and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import scores
from ..functions.arrays import joined
from ..functions.text import codepoints
from ..operators import decode, encode, lookup, metrics
from ..sources.records import parse_debug_table
from ..sources.scratch import materialise
from .base import query
from .encoding import coded

SID = fx.SID

TOKEN_SQL = """
fit AS (SELECT t.*, CASE WHEN n >= 6 THEN 'NUL' ELSE pos END AS shown FROM tokens t)"""


def tagged(spark, sf):
    """(doc_id, line_no, text, comment, tags): texts with the tags of their lattices."""
    rows = coded(spark, sf).filter(F.col("reason").isNull())
    text = F.array_join(F.transform("path", lambda n: n["surface"]), "")
    return rows.select(*SID, "comment", text.alias("text"), "tags")


@query("decoded_tokens", "WITH " + TOKEN_SQL + """
SELECT doc_id, line_no, start_idx::INT AS start, surface, shown AS pos, subpos, ctype, cform FROM fit""", ("tokens",))
def decoded_tokens(spark, sf):
    _, tags = fx.dictionaries(spark, sf)
    rows = decode.decode_tokens(tagged(spark, sf), tags, "text")
    return rows.select(*SID, F.inline("tokens"))


@query("juman_lines", "WITH " + TOKEN_SQL + """
SELECT doc_id, line_no, '# S-ID:' || doc_id || '-' || line_no || chr(10) ||
  string_agg(concat_ws(' ', surface, '* *', shown, '0', subpos, '0', ctype, '0', cform, '0 NIL'), chr(10) ORDER BY tok_no)
  || chr(10) || 'EOS' AS value FROM fit GROUP BY doc_id, line_no""", ("tokens",))
def juman_lines(spark, sf):
    _, tags = fx.dictionaries(spark, sf)
    rows = decode.decode_tokens(tagged(spark, sf), tags, "text")
    return rows.select(*SID, decode.token_lines(F.col("comment"), F.col("tokens"), "juman").alias("value"))


@query("mrph_lines", "WITH " + TOKEN_SQL + """
SELECT doc_id, line_no, string_agg(surface || '_' || shown || ':' || subpos, ' ' ORDER BY tok_no)
  || ' # S-ID:' || doc_id || '-' || line_no AS value FROM fit GROUP BY doc_id, line_no""", ("tokens",))
def mrph_lines(spark, sf):
    _, tags = fx.dictionaries(spark, sf)
    rows = decode.decode_tokens(tagged(spark, sf), tags, "text")
    return rows.select(*SID, decode.token_lines(F.col("comment"), F.col("tokens"), "mrph").alias("value"))


def debug_text(spark, sf):
    _, tags = fx.dictionaries(spark, sf)
    # Stand-in probabilities: 1 / (tag id + 1).
    probs = F.transform("tags", lambda t: F.lit(1.0) / (t + 1))
    rows = tagged(spark, sf).withColumn("probs", probs)
    seg = ["NUL", "B", "I", "E"]
    return rows.select(*SID, decode.debug_lines(
        F.col("comment"), F.col("text"), F.col("tags"), F.col("probs"), seg, decode.label_tables(tags)).alias("value"))


DEBUG_SQL = f"""
ids AS (SELECT c.doc_id, c.line_no, cp, ch, c.seg, p.tag AS pt, p.id AS pid, c.subpos, s.id AS sid, c.ctype, y.id AS yid, c.cform, f.id AS fid, n
  FROM chars c
  JOIN (SELECT tag, id FROM tagdict WHERE kind = 'pos') p ON p.tag = c.pos
  JOIN (SELECT tag, id FROM tagdict WHERE kind = 'subpos') s ON s.tag = c.subpos
  JOIN (SELECT tag, id FROM tagdict WHERE kind = 'ctype') y ON y.tag = c.ctype
  JOIN (SELECT tag, id FROM tagdict WHERE kind = 'cform') f ON f.tag = c.cform),
cells AS (SELECT *, CASE WHEN n >= 6 THEN 'NUL' ELSE pt END AS pos, CASE WHEN n >= 6 THEN 0 ELSE pid END AS posid,
  CASE seg WHEN 1 THEN 'B' WHEN 2 THEN 'I' ELSE 'E' END AS segl FROM ids)"""


@query("debug_table", "WITH " + DEBUG_SQL + f"""
SELECT doc_id, line_no, '# S-ID:' || doc_id || '-' || line_no || chr(10) || string_agg(concat_ws(chr(9), ch, segl, pos, subpos, ctype, cform,
   printf('%.1f', 100.0 / (seg + 1)), printf('%.1f', 100.0 / (posid + 1)), printf('%.1f', 100.0 / (sid + 1)),
   printf('%.1f', 100.0 / (yid + 1)), printf('%.1f', 100.0 / (fid + 1))), chr(10) ORDER BY cp) || chr(10) || 'EOS' AS value
FROM cells GROUP BY doc_id, line_no""", ("chars", "tagdict"))
def debug_table(spark, sf):
    return debug_text(spark, sf)


@query("debug_table_parsed", "WITH " + DEBUG_SQL + f"""
SELECT doc_id, line_no, '# S-ID:' || doc_id || '-' || line_no AS comment, string_agg(ch, '' ORDER BY cp) AS text,
   string_agg(segl || '/' || pos, ' ' ORDER BY cp) AS tags
FROM cells GROUP BY doc_id, line_no""", ("chars", "tagdict"))
def debug_table_parsed(spark, sf):
    rows = parse_debug_table(debug_text(spark, sf).withColumnRenamed("value", "raw"))
    return rows.select(
        *SID, "comment", F.array_join("chars.ch", "").alias("text"),
        F.array_join(F.transform("chars", lambda c: F.concat(
            F.get(c["tags"], F.lit(0))["tag"], F.lit("/"), F.get(c["tags"], F.lit(1))["tag"])), " ").alias("tags"))


COUNT_SQL = """
cnt AS (SELECT count(DISTINCT (doc_id, line_no)) AS sentences, count(*) FILTER (gold = 1 AND pred = 1) AS shared,
   count(*) FILTER (gold = 1 AND pred <> 1) AS gold_only, count(*) FILTER (gold <> 1 AND gold <> 0 AND pred = 1) AS pred_only FROM goldpred),
cum AS (SELECT *, sum((gold = 1)::INT) OVER w AS g, sum((pred = 1 AND gold <> 0)::INT) OVER w AS p FROM goldpred
   WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY pos_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
hits AS (SELECT *, lead(g) OVER w AS g2, lead(p) OVER w AS p2 FROM cum WHERE gold = 1 AND pred = 1
   WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY pos_no)),
mat AS (SELECT count(*) FILTER (g2 - g = 1 AND p2 - p = 1) AS matched FROM hits),
ends AS (SELECT doc_id, line_no, max(g) AS lg, max(p) AS lp FROM cum GROUP BY doc_id, line_no),
ali AS (SELECT count(*) AS aligned FROM hits h JOIN ends e USING (doc_id, line_no) WHERE g2 IS NULL AND g = lg AND p = lp),
allc AS (SELECT * FROM cnt, mat, ali)"""

PRF_SQL = """
SELECT tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / greatest(p + r, 1e-9), 9) AS f1 FROM (
SELECT *, greatest(tp, 0) / greatest(greatest(tp, 0) + fp, 1.0::DOUBLE) AS p, greatest(tp, 0) / greatest(greatest(tp, 0) + fn, 1.0::DOUBLE) AS r FROM counted)"""


def rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if c in ("precision", "recall", "f1") else F.col(c) for c in df.columns])


@query("seg_counts", "WITH " + COUNT_SQL + "SELECT * FROM allc", ("goldpred",))
def seg_counts(spark, sf):
    return metrics.seg_counts(fx.gold_pred(spark, sf))


@query("seg_boundary_prf", "WITH " + COUNT_SQL + ", counted AS (SELECT shared - sentences AS tp, pred_only AS fp, gold_only AS fn FROM allc)" + PRF_SQL, ("goldpred",))
def seg_boundary_prf(spark, sf):
    return rounded(metrics.seg_boundary_prf(metrics.seg_counts(fx.gold_pred(spark, sf))))


def _token_sql(bonus: str) -> str:
    return ("WITH " + COUNT_SQL + f", counted AS (SELECT matched + {bonus} AS tp, shared + pred_only - matched - {bonus} AS fp,"
            f" shared + gold_only - matched - {bonus} AS fn FROM allc)" + PRF_SQL)


@query("seg_token_prf", _token_sql("sentences"), ("goldpred",))
def seg_token_prf(spark, sf):
    return rounded(metrics.seg_token_prf(metrics.seg_counts(fx.gold_pred(spark, sf))))


@query("seg_token_prf_strict", _token_sql("aligned"), ("goldpred",))
def seg_token_prf_strict(spark, sf):
    return rounded(metrics.seg_token_prf(metrics.seg_counts(fx.gold_pred(spark, sf)), strict=True))


@query("batch_seg_prf", "WITH " + COUNT_SQL + """,
counted AS (SELECT greatest(shared - sentences, 0) AS tp, greatest(pred_only, 1) AS fp, greatest(gold_only, 1) AS fn FROM allc)
SELECT tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / greatest(p + r, 1e-6), 9) AS f1
FROM (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM counted)""", ("goldpred",))
def batch_seg_prf(spark, sf):
    return rounded(metrics.batch_seg_prf(metrics.seg_counts(fx.gold_pred(spark, sf))))


@query("seg_accuracy", """
SELECT count(*) FILTER (gold <> 0) AS labels, count(*) FILTER (gold <> 0 AND gold = pred) AS hits,
       round(count(*) FILTER (gold <> 0 AND gold = pred) / greatest(count(*) FILTER (gold <> 0), 1), 9) AS accuracy FROM goldpred""", ("goldpred",))
def seg_accuracy(spark, sf):
    rows = metrics.tag_accuracy(fx.gold_pred(spark, sf), "gold", "pred", ["seg"]).drop("kind")
    return rows.withColumn("accuracy", F.round("accuracy", 9))


@query("label_accuracy", """
SELECT lang, count(*) FILTER (quality + toxic <> 0) AS labels, count(*) FILTER (quality + toxic <> 0 AND quality + toxic = 1) AS hits,
  round(count(*) FILTER (quality + toxic <> 0 AND quality + toxic = 1) / greatest(count(*) FILTER (quality + toxic <> 0), 1), 9) AS accuracy
FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def label_accuracy(spark, sf):
    rows = fx.table(spark, sf, "labels").join(fx.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    done = metrics.accuracy(rows, F.col("quality") + F.col("toxic"), F.lit(1), ["lang"])
    return done.withColumn("accuracy", F.round("accuracy", 9))


@query("tag_accuracy", "WITH " + DEBUG_SQL + f""",
fit AS (SELECT doc_id, line_no FROM cells GROUP BY ALL),
k AS (SELECT unnest(['seg', 'pos', 'subpos', 'ctype', 'cform']) AS kind, unnest([seg, posid, sid, yid, fid]) AS gold
      FROM cells JOIN fit USING (doc_id, line_no))
SELECT kind, count(*) FILTER (gold <> 0) AS labels, count(*) FILTER (gold = 1) AS hits,
       round(count(*) FILTER (gold = 1) / greatest(count(*) FILTER (gold <> 0), 1), 9) AS accuracy FROM k GROUP BY kind""", ("chars", "tagdict"))
def tag_accuracy(spark, sf):
    """Predicting the first tag everywhere."""
    rows = tagged(spark, sf).select("tags", F.transform("tags", lambda _: F.lit(1).cast("bigint")).alias("pred"))
    done = metrics.tag_accuracy(rows, "tags", "pred", ["seg", *encode.TAG_KINDS])
    return done.withColumn("accuracy", F.round("accuracy", 9))


@query("tag_coverage", "WITH " + DEBUG_SQL + f""",
fit AS (SELECT doc_id, line_no FROM cells GROUP BY ALL),
c AS (SELECT cells.* FROM cells JOIN fit USING (doc_id, line_no))
SELECT sum(4 + (posid <> 0)::INT)::BIGINT AS set_tags, count(*) + 2 * count(DISTINCT (doc_id, line_no)) AS positions,
       count(DISTINCT (doc_id, line_no)) AS sentences,
       round(sum(4 + (posid <> 0)::INT) / greatest((count(*) + count(DISTINCT (doc_id, line_no))) * 5, 1), 9) AS coverage FROM c""", ("chars", "tagdict"))
def tag_coverage(spark, sf):
    rows = tagged(spark, sf).select("tags", (F.size("tags") / 5).cast("int").alias("length"))
    done = metrics.tag_coverage(rows, "tags", "length", 5)
    return done.withColumn("coverage", F.round("coverage", 9))


@query("gold_pred_join", """
SELECT coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, lang, count(*) AS docs FROM labels FULL JOIN documents USING (doc_id) GROUP BY ALL""")
def gold_pred_join(spark, sf):
    from ..operators.lookup import gold_pred_join as join

    rows = join(fx.table(spark, sf, "labels"), fx.table(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"])
    marked = rows.fillna(-1, ["quality", "toxic"])
    return marked.groupBy("quality", "toxic", "lang").agg(F.count("*").alias("docs"))


MODEL_SQL = """
bw AS (SELECT unnest(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '')) AS w FROM benchmark),
bc AS (SELECT substr(w, p + 1, 1) AS ch, CASE WHEN p = 0 THEN 1 WHEN p = length(w) - 1 THEN 3 ELSE 2 END AS seg
       FROM (SELECT w, unnest(range(length(w))) AS p FROM bw)),
model AS (SELECT ch, seg AS pred FROM (SELECT ch, seg, count(*) AS n FROM bc GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY ch ORDER BY n DESC, seg) = 1),
goldpred AS (SELECT doc_id, line_no, cp + 1 AS pos_no, seg AS gold, coalesce(pred, 0) AS pred, pred IS NOT NULL AS in_pred
             FROM chars LEFT JOIN model USING (ch))"""


def benchmark_tagger(spark, sf):
    """(ch, pred): the segmentation tag that a character has most often in the texts of ``benchmark``."""
    texts = fx.table(spark, sf, "benchmark").select(F.translate("text", "\n", " ").alias("line"))
    cells = texts.select(F.inline(F.arrays_zip(
        codepoints(F.array_join(fx.pieces(F.col("line")), "")).alias("ch"), fx.gold_tags(F.col("line")).alias("seg"))))
    counts = cells.groupBy("ch", "seg").agg(F.count("*").alias("n"))
    return materialise(counts.groupBy("ch").agg(F.max_by("seg", F.struct("n", -F.col("seg"))).alias("pred")), "tagger")


def tagged_positions(spark, sf):
    """Gold tags of all documents beside the tagger's, which has none for characters it has not met."""
    gold = fx.tagged_chars(spark, sf)
    found = lookup.lookup_join(gold, benchmark_tagger(spark, sf), ["ch"], {}).filter(F.col("pred").isNotNull())
    return metrics.aligned(gold, found.select(*SID, "position", F.col("pred").alias("tag")), SID)


@query("aligned_accuracy", "WITH " + MODEL_SQL + """
SELECT gold, count(*) AS positions, count(*) FILTER (in_pred) AS predicted, count(*) FILTER (gold = pred) AS hits,
       round(count(*) FILTER (gold = pred) / count(*), 9) AS accuracy FROM goldpred GROUP BY gold""", ("chars",))
def aligned_accuracy(spark, sf):
    """E8 on (sentence, position): a tagger learned from another table, with the positions it left out."""
    rows = tagged_positions(spark, sf)
    done = rows.groupBy("gold").agg(
        F.count_if("in_gold").alias("positions"), F.count_if("in_pred").alias("predicted"),
        F.count_if(F.col("gold") == F.col("pred")).alias("hits"))
    return done.withColumn("accuracy", F.round(F.col("hits") / F.col("positions"), 9))


@query("aligned_batch_prf", "WITH " + MODEL_SQL + """,
counted AS (SELECT line_no, greatest(count(*) FILTER (gold = 1 AND pred = 1) - count(DISTINCT doc_id), 0) AS tp,
   greatest(count(*) FILTER (gold <> 1 AND pred = 1), 1) AS fp, greatest(count(*) FILTER (gold = 1 AND pred <> 1), 1) AS fn
   FROM goldpred GROUP BY line_no)
SELECT line_no, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / greatest(p + r, 1e-6), 9) AS f1
FROM (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM counted)""", ("chars",))
def aligned_batch_prf(spark, sf):
    """F16 for every line number as a batch of its own, over aligned positions with gaps."""
    rows = metrics.aligned_sentences(tagged_positions(spark, sf), SID)
    return rounded(metrics.batch_seg_prf(metrics.seg_counts(rows, by=["line_no"]), ["line_no"]))


def emb():
    return F.col("embedding")


@query("argmax_tags", """
SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS tag, label,
       list_position(embedding, list_max(embedding)) - 1 = label AS hit FROM embeddings""")
def argmax_tags(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select("vec_id", scores.argmax_tag(emb()).alias("tag"), "label")
    return rows.withColumn("hit", F.col("tag") == F.col("label"))


@query("tag_prob", """
SELECT vec_id, round(exp(list_max(embedding)::DOUBLE - ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))))), 6) AS prob FROM embeddings""")
def tag_prob(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", F.round(scores.tag_prob(emb()), 6).alias("prob"))


@query("tag_loss", """
WITH e AS (SELECT vec_id, embedding, label, ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))) AS norm FROM embeddings),
c AS (SELECT *, norm - embedding[label + 1]::DOUBLE AS ce, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS tot,
      embedding[label + 1]::DOUBLE AS g FROM e)
SELECT vec_id, round(ce, 6) AS plain, round(greatest(ce + ln(0.9::DOUBLE), 0), 6) AS one_sided, round((ce + ln(0.9::DOUBLE)) ** 2, 6) AS squared,
       round(0.9::DOUBLE * ce + 0.1::DOUBLE / 63 * (63 * norm - (tot - g)), 6) AS smoothed FROM c""")
def tag_loss(spark, sf):
    gold = F.col("label")
    forms = {
        "plain": scores.tag_loss(emb(), gold),
        "one_sided": scores.tag_loss(emb(), gold, 0.1, exp_smoothing=True, one_sided=True),
        "squared": scores.tag_loss(emb(), gold, 0.1, exp_smoothing=True),
        "smoothed": scores.tag_loss(emb(), gold, 0.1),
    }
    return fx.table(spark, sf, "embeddings").select("vec_id", *[F.round(v, 6).alias(k) for k, v in forms.items()])


@query("weighted_loss", """
WITH c AS (SELECT label % 3 AS grp, label, ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))) - embedding[label + 1]::DOUBLE AS ce FROM embeddings)
SELECT grp, round(sum(CASE WHEN label <> 0 THEN ce * 0.5 ELSE 0 END), 5) AS loss_sum, count(*) FILTER (label <> 0) AS weighted,
  round(coalesce(sum(CASE WHEN label <> 0 THEN ce * 0.5 ELSE 0 END) / nullif(count(*) FILTER (label <> 0), 0), 0), 6) AS loss FROM c GROUP BY grp""")
def weighted_loss(spark, sf):
    rows = fx.table(spark, sf, "embeddings").withColumn("grp", F.col("label") % 3)
    done = metrics.weighted_loss(rows, scores.tag_loss(emb(), F.col("label")), F.col("label"), 0.5, ["grp"])
    return done.withColumn("loss_sum", F.round("loss_sum", 5)).withColumn("loss", F.round("loss", 6))


@query("top_k_scores", """
WITH u AS (SELECT vec_id, unnest(embedding) AS s, unnest(range(len(embedding))) AS i FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS r FROM u)
SELECT vec_id, string_agg(i::VARCHAR, ',' ORDER BY r) AS best, round(min(s)::DOUBLE, 6) AS last_score FROM r WHERE r <= 10 GROUP BY vec_id""")
def top_k_scores(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select("vec_id", decode.top_k_scores(emb(), 10).alias("b"))
    return rows.select(
        "vec_id", joined(F.transform("b", lambda p: p["index"])).alias("best"),
        F.round(F.array_min(F.transform("b", lambda p: p["score"])).cast("double"), 6).alias("last_score"))


@query("moving_mean", """
SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 5, 6) AS mean FROM events""")
def moving_mean(spark, sf):
    events = fx.table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    done = metrics.moving_mean(events, "value", [F.col("ts"), F.col("event_id")], ["user_id"], 5)
    return done.select("event_id", "user_id", F.round("mean", 6).alias("mean"))


@query("moving_rate", """
WITH d AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6::DOUBLE, 0) AS step FROM events),
s AS (SELECT event_id, user_id, sum(value) OVER w AS v, sum(step) OVER w AS t FROM d
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, round(coalesce(v / nullif(t, 0), 0), 6) AS rate FROM s""")
def moving_rate(spark, sf):
    events = fx.table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    timed = events.withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    done = metrics.moving_rate(timed, "value", "seconds", [F.col("ts"), F.col("event_id")], ["user_id"], 5)
    return done.select("event_id", "user_id", F.round("rate", 6).alias("rate"))


@query("finite_mean", """
SELECT event_type, round(sum(value) FILTER (isfinite(value)), 4) AS total, count(*) FILTER (isfinite(value)) AS finite,
       round(coalesce(sum(value) FILTER (isfinite(value)), 0) / (count(*) FILTER (isfinite(value)) + 1), 6) AS mean FROM (
  SELECT event_type, CASE event_id % 50 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE ELSE value END AS value FROM events) GROUP BY event_type""")
def finite_mean(spark, sf):
    pick = F.col("event_id") % 50
    noisy = F.when(pick == 0, float("nan")).when(pick == 1, float("inf")).otherwise(F.col("value"))
    rows = fx.table(spark, sf, "events").withColumn("value", noisy)
    done = metrics.finite_mean(rows, "value", ["event_type"])
    return done.withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 6))
