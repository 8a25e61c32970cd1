"""Evaluation of predicted tags.

Sentences hold their gold and predicted tags as arrays, so counting needs no shuffle: every measure
is a sum of per-sentence counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from ..functions.arrays import computed_once
from ..sources.ship import ship
from .numbering import drop_halo, moving_frame
from .runs import Merger, Packer, SegCounter, TagCounter

B = 1


def aligned(
    gold: DataFrame, pred: DataFrame, sid: Sequence[str], position: str = "position", tag: str = "tag",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Gold and predicted tags of the same (sentence, position), one row each: sid, position, gold, pred, in_gold,
    in_pred and the columns ``keep`` of the gold side. A position that only one side has stays, with a null tag for
    the other; one that a side names twice is an error, as no pair of tags would be right.

    Positions of a sentence that follow each other travel as one row of lists; both sides are dealt once, by sentence. The
    rows carry the sentences that they were cut from, so that :func:`aligned_sentences` gathers nothing again.
    """

    def side(df: DataFrame, is_gold: bool) -> DataFrame:
        kept = [F.col(c) if is_gold else F.lit(None).cast(gold.schema[c].dataType).alias(c) for c in keep]
        return df.select(*sid, F.lit(is_gold).alias("__gold"), position, F.col(tag).alias("__tag"), *kept)

    ship(gold.sparkSession)
    both = side(gold, True).unionByName(side(pred, False))
    kinds = {f.name: f.dataType for f in both.schema.fields}
    named = [StructField(c, kinds[c]) for c in sid]
    lists = [StructField(n, ArrayType(kinds[c])) for n, c in [("__at", position), ("__tag", "__tag"), *zip(keep, keep)]]
    packed = both.mapInArrow(
        Packer([*sid, "__gold"], position, ["__tag", *keep]),
        StructType([*named, StructField("__gold", BooleanType()), StructField("__raw", BooleanType()), *lists]))
    cell = [(position, kinds[position]), *[(c, kinds[c]) for c in keep], ("gold", kinds["__tag"]), ("pred", kinds["__tag"]),
            ("__g", LongType()), ("__p", LongType())]
    cells = StructField("__cells", ArrayType(StructType([StructField(n, t) for n, t in cell])))
    held = packed.repartition(*sid).sortWithinPartitions(*sid).mapInArrow(
        Merger(sid, position, keep), StructType([*named, cells]))
    rows = held.select(*sid, F.inline("__cells")).select(
        *sid, position, *keep, "gold", "pred", _in_gold(lambda c: F.col(c), sid, position).alias("in_gold"),
        (F.col("__p") == 1).alias("in_pred"))
    rows.sentences = held
    return rows


def _in_gold(of: Callable[[str], Column], sid: Sequence[str], position: str) -> Column:
    """Whether the gold side names a position; an error where a side names it twice."""
    place = [*[F.col(c) for c in sid], of(position)]
    twice = F.raise_error(F.concat(F.lit("a position is named twice: "), F.concat_ws(", ", *[c.cast("string") for c in place])))
    return F.coalesce(F.when((of("__g") > 1) | (of("__p") > 1), twice.cast("boolean")), of("__g") == 1)


def aligned_sentences(rows: DataFrame, sid: Sequence[str], position: str = "position", keep: Sequence[str] = ()) -> DataFrame:
    """The gold positions of :func:`aligned` as arrays ``gold`` and ``pred`` of one sentence; a missed position is 0."""
    whole = vars(rows).get("sentences")
    if whole is not None and whole.columns == [*sid, "__cells"] and position in rows.columns:
        named = computed_once(whole, __named=F.filter("__cells", lambda c: _in_gold(lambda n: c[n], sid, position)))
        held = named.filter(F.size("__named") > 0)
        tags = [F.transform(F.col(f"__named.{c}"), lambda t: F.coalesce(t, F.lit(0))).alias(c) for c in ("gold", "pred")]
        return held.select(*sid, *[F.array_max(F.col(f"__named.{c}")).alias(c) for c in keep], *tags)
    cell = F.struct(position, F.coalesce("gold", F.lit(0)).alias("g"), F.coalesce("pred", F.lit(0)).alias("p"))
    held = rows.filter("in_gold").groupBy(*sid).agg(
        *[F.max(c).alias(c) for c in keep], F.sort_array(F.collect_list(cell)).alias("__cells"))
    return held.select(*sid, *keep, F.col("__cells.g").alias("gold"), F.col("__cells.p").alias("pred"))


def seg_counts(df: DataFrame, gold: str = "gold", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """One row (for each ``by``): sentences, shared, gold_only, pred_only, matched, aligned."""
    ship(df.sparkSession)
    rows = df.select(*by, F.col(gold).alias("__gold"), F.col(pred).alias("__pred"))
    counts = [StructField(c, LongType()) for c in SegCounter.COUNTS]
    per_row = rows.mapInArrow(SegCounter(by, B), StructType([*[rows.schema[c] for c in by], *counts]))
    return per_row.groupBy(*by).agg(
        F.count("*").alias("sentences"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SegCounter.COUNTS])


def prf(df: DataFrame, tp: Column, fp: Column, fn: Column, penalty: Column | int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """tp (after the penalty), fp, fn, precision, recall, f1, beside the columns ``keep``."""
    pen = F.lit(penalty) if isinstance(penalty, int) else penalty
    counts = df.select(*keep, (tp - pen).alias("tp"), fp.alias("fp"), fn.alias("fn"))
    hit = F.greatest(F.col("tp"), F.lit(0)).cast("double")
    rated = counts.withColumn("precision", hit / F.greatest(hit + F.col("fp"), F.lit(1.0))).withColumn(
        "recall", hit / F.greatest(hit + F.col("fn"), F.lit(1.0))
    )
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", 2 * p * r / F.greatest(p + r, F.lit(1e-9)))


def prf_den(
    df: DataFrame, tp: Column, prec_den: Column, rec_den: Column, penalty: Column | int = 0, keep: Sequence[str] = ()
) -> DataFrame:
    """the same from the numbers of predicted and of gold items."""
    pen = F.lit(penalty) if isinstance(penalty, int) else penalty
    real = tp - pen
    return prf(df, real, prec_den - real, rec_den - real, keep=keep)


def seg_boundary_prf(counts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """the first B of every sentence is free and does not count."""
    return prf(counts, F.col("shared"), F.col("pred_only"), F.col("gold_only"), F.col("sentences"), keep)


def seg_token_prf(counts: DataFrame, strict: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """a token counts if both of its ends do. The last token of a sentence has no following B;
    by default one is added per sentence, with ``strict`` only where the last B's coincide."""
    bonus = F.col("aligned") if strict else F.col("sentences")
    return prf_den(
        counts, F.col("matched"), F.col("shared") + F.col("pred_only"), F.col("shared") + F.col("gold_only"), -bonus, keep,
    )


def batch_seg_prf(counts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """F16: the training-time variant with floors instead of guards in the quotients."""
    tp = F.greatest(F.col("shared") - F.col("sentences"), F.lit(0))
    fp, fn = F.greatest(F.col("pred_only"), F.lit(1)), F.greatest(F.col("gold_only"), F.lit(1))
    rated = counts.select(*keep, tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).withColumn(
        "precision", F.col("tp") / (F.col("tp") + F.col("fp"))
    ).withColumn("recall", F.col("tp") / (F.col("tp") + F.col("fn")))
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", 2 * p * r / F.greatest(p + r, F.lit(1e-6)))


def accuracy(df: DataFrame, gold: Column, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    """F11 + B18 on one row per position: labels, hits, accuracy; gold 0 is masked out."""
    mask = gold != 0
    return df.groupBy(*by).agg(
        F.coalesce(F.sum(mask.cast("bigint")), F.lit(0)).alias("labels"),
        F.coalesce(F.sum((mask & (pred == gold)).cast("bigint")), F.lit(0)).alias("hits"),
    ).withColumn("accuracy", F.col("hits") / F.greatest(F.col("labels"), F.lit(1)))


def tag_accuracy(df: DataFrame, gold: str, pred: str, kinds: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """F11 on flat ``(n x kinds)`` arrays: one row per kind (and ``by``)."""
    ship(df.sparkSession)
    rows = df.select(*by, F.col(gold).alias("__gold"), F.col(pred).alias("__pred"))
    added = [StructField("kind", StringType()), StructField("labels", LongType()), StructField("hits", LongType())]
    marked = rows.mapInArrow(TagCounter(by, kinds), StructType([*[rows.schema[c] for c in by], *added]))
    sums = marked.groupBy(*by, "kind").agg(F.sum("labels").alias("labels"), F.sum("hits").alias("hits"))
    return sums.withColumn("accuracy", F.col("hits") / F.greatest(F.col("labels"), F.lit(1)))


def finite_mean(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """sum of the finite values over their number plus one."""
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return df.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(finite, v)), F.lit(0.0)).alias("total"),
        F.count(F.when(finite, 1)).alias("finite"),
    ).withColumn("mean", F.col("total") / (F.col("finite") + 1))


def tag_coverage(df: DataFrame, tags: str, length: str, num_tags: int) -> DataFrame:
    """share of set tags among the positions of all tag rows; the BOS row is always empty."""
    return df.agg(
        F.sum(F.size(F.filter(tags, lambda t: t != 0)).cast("bigint")).alias("set_tags"),
        F.sum(F.col(length).cast("bigint")).alias("positions"),
        F.count("*").alias("sentences"),
    ).withColumn(
        "coverage",
        F.col("set_tags") / F.greatest((F.col("positions") - F.col("sentences")) * num_tags, F.lit(1)),
    )


def weighted_loss(df: DataFrame, loss: Column, gold: Column, weight: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """sum of loss x weight over the number of positions with a weight."""
    w = F.when(gold != 0, F.lit(weight)).otherwise(0.0)
    return df.groupBy(*by).agg(
        F.sum(loss * w).alias("loss_sum"), F.count(F.when(w != 0, 1)).alias("weighted")
    ).withColumn("loss", F.coalesce(F.try_divide("loss_sum", "weighted"), F.lit(0.0)))


def moving_mean(
    df: DataFrame, value: str, order: Sequence[Column], groups: Sequence[str], width: int, name: str = "mean",
    chunk_rows: int = 100_000,
) -> DataFrame:
    """Mean over the last ``width`` rows; short histories still divide by ``width``."""
    rows, window = moving_frame(df, order, groups, width, chunk_rows)
    total = F.sum(value).over(window.rowsBetween(-(width - 1), 0))
    return drop_halo(rows.withColumn(name, total / width))


def moving_rate(
    df: DataFrame, value: str, seconds: str, order: Sequence[Column], groups: Sequence[str], width: int,
    name: str = "rate", chunk_rows: int = 100_000,
) -> DataFrame:
    """Sum of values over elapsed time in the last ``width`` rows, 0 if no time passed. The first
    row of a group has no elapsed time. One more row is carried over for the oldest difference."""
    rows, window = moving_frame(df, order, groups, width + 1, chunk_rows)
    step = F.coalesce(F.col(seconds) - F.lag(seconds).over(window), F.lit(0.0))
    frame = window.rowsBetween(-(width - 1), 0)
    sums = rows.withColumn("__step", step).withColumn("__v", F.sum(value).over(frame)).withColumn(
        "__t", F.sum("__step").over(frame)
    )
    rated = sums.withColumn(name, F.coalesce(F.try_divide(F.col("__v").cast("double"), F.nullif(F.col("__t"), F.lit(0.0))), F.lit(0.0)))
    return drop_halo(rated).drop("__step", "__v", "__t")
