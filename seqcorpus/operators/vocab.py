"""Counts and dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import codept_repr
from ..sources.scratch import is_stored, materialise
from ..sources.ship import ship
from .lookup import FIRST_CHAR_ID, FIRST_TAG_ID, lookup_join
from .node_lines import mask_of, parts_of
from .numbering import positions

CHAR_KIND = "cpt"
# Name of a tag kind in the counts -> field of a node.
COUNTED = {"pos": "pos", "subpos": "subpos", "conjtype": "ctype", "conjform": "cform"}
SEED_FIRST, SEED_LAST = 0x21, 0x7F
RESERVED_CHARS = ["NUL", "UNK", "BOS", "EOS"]
RESERVED_TAG = "NUL"
SUBSAMPLE_RATE = 1e-5


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, value, cnt) of each batch: characters of rank-1 nodes, tags of every node."""
    for batch in batches:
        rows, flat = pc.list_parent_indices(batch.column(0)).to_numpy(), pc.list_flatten(batch.column(0))
        surface, ranks = (pc.struct_field(flat, n) for n in ("surface", "ranks"))
        top = np.zeros(len(flat), bool)
        top[pc.list_parent_indices(ranks).to_numpy()[mask_of(pc.equal(pc.list_flatten(ranks), 1))]] = True
        lost = top & pc.is_null(surface).to_numpy(zero_copy_only=False)
        if lost.any():  # a best node without a surface: nothing of its sentence counts
            kept = ~np.isin(rows, rows[lost])
            flat, surface, top = flat.filter(pa.array(kept)), surface.filter(pa.array(kept)), top[kept]
        data, _ = parts_of(surface.filter(pa.array(top)).cast(pa.string()))
        times = np.bincount(np.frombuffer(bytes(data).decode(errors="replace").encode("utf-32-le"), np.uint32))
        seen = np.flatnonzero(times)
        found = [(CHAR_KIND, pa.array([chr(c) for c in seen], pa.string()), pa.array(times[seen], pa.int64()))]
        for kind, field in COUNTED.items():
            counts = pc.value_counts(pc.struct_field(flat, field))
            found.append((kind, counts.field("values").cast(pa.string()), counts.field("counts").cast(pa.int64())))
        kinds = pa.array(np.repeat([k for k, _, _ in found], [len(v) for _, v, _ in found]), pa.string())
        columns = [kinds, *[pa.concat_arrays([f[i] for f in found]) for i in (1, 2)]]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "value", "cnt"])


def feature_counts(df: DataFrame, nodes: str = "nodes") -> DataFrame:
    """(kind, value, cnt). Counts are combined before the shuffle, so hot values cost nothing: by vector operations over
    each Arrow batch, then by task."""
    ship(df.sparkSession)
    needed = ["surface", *COUNTED.values(), "ranks"]
    own = F.col(nodes)
    if set(df.schema[nodes].dataType.elementType.names) != set(needed):
        own = F.transform(own, lambda n: F.struct(*[n[f].alias(f) for f in needed]))
    counts = df.select(own.alias(nodes)).mapInArrow(_counted, "kind string, value string, cnt bigint")
    return counts.groupBy("kind", "value").agg(F.sum("cnt").alias("cnt"))


def ascii_seed(df: DataFrame) -> DataFrame:
    seed = df.sparkSession.range(SEED_FIRST, SEED_LAST + 1)
    return seed.select(F.char(F.col("id")).alias("ch"), F.lit(0).cast("bigint").alias("cnt"))


def with_seed(counts: DataFrame) -> DataFrame:
    """H1: (ch, cnt) of the counted characters plus the ASCII seed with count 0."""
    seen = counts.filter(F.col("kind") == CHAR_KIND).select(F.col("value").alias("ch"), "cnt")
    return seen.unionByName(ascii_seed(counts)).groupBy("ch").agg(F.max("cnt").alias("cnt"))


def build_char_dict(counts: DataFrame, order: str = "code", limit: int | None = None) -> DataFrame:
    """(ch, cnt, id, label), ids from 4 ``by_code`` or ``by_freq`` order.

    At most one row per codepoint, so the ordering windows are bounded by Unicode.
    """
    chars = with_seed(counts)
    by_freq = [F.col("cnt").desc(), F.col("ch")]
    if limit is not None:
        chars = chars.withColumn("__r", F.row_number().over(W.orderBy(*by_freq))).filter(F.col("__r") <= limit)
    keys = [F.col("ch")] if order == "code" else by_freq
    number = F.row_number().over(W.orderBy(*keys)) - 1 + FIRST_CHAR_ID
    return chars.select("ch", "cnt", number.alias("id"), codept_repr(F.col("ch")).alias("label"))


def top_per_kind(counts: DataFrame, n: int) -> DataFrame:
    """D3: the n most frequent values of each kind. Every task keeps n per kind before the shuffle."""
    best = W.partitionBy("kind").orderBy(F.col("cnt").desc(), F.col("value"))
    return counts.withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= n).drop("__r")


def build_tag_dict(counts: DataFrame, limit: int | None = None) -> DataFrame:
    """(kind, tag, cnt, id), ids from 1 per kind by falling frequency; kinds are named as in
    the examples. ``limit`` keeps the most frequent only. No task holds a kind: places come from sorted ranges."""
    tags = counts.filter(F.col("kind") != CHAR_KIND)
    if limit is not None:
        tags = top_per_kind(tags, limit)
    numbered = positions(tags.select("kind", "value", "cnt"), [F.col("cnt").desc(), F.col("value")], ["kind"], "__r")
    kind = F.col("kind")
    for counted, field in COUNTED.items():
        kind = F.when(F.col("kind") == counted, field).otherwise(kind)
    return numbered.select(
        kind.alias("kind"), F.col("value").alias("tag"), "cnt",
        (F.col("__r") - 1 + FIRST_TAG_ID).cast("int").alias("id"),
    )


def count_classes(counts: DataFrame, num_top: int, count: str = "cnt") -> DataFrame:
    """Tokens of equal count as one row: (``__c``, ``__n`` tokens, tokens and mass of the more frequent classes, mass
    of the ``num_top`` first tokens, mass of all).

    ``d`` different positive counts need a mass of ``d * (d + 1) / 2``, so there are at most ``sqrt(2 * mass)`` classes
    (4.5 million of 10^13 tokens); the window runs over them, never over tokens.
    """
    classes = counts.groupBy(F.coalesce(F.col(count).cast("bigint"), F.lit(0)).alias("__c")).agg(F.count("*").alias("__n"))
    earlier = W.orderBy(F.col("__c").desc()).rowsBetween(W.unboundedPreceding, -1)
    placed = classes.select(
        "__c", "__n", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__tokens"),
        F.coalesce(F.sum(F.col("__c") * F.col("__n")).over(earlier), F.lit(0)).alias("__mass"),
    )
    inside = F.greatest(F.least(F.col("__n"), F.lit(num_top) - F.col("__tokens")), F.lit(0))
    return placed.select(
        "*", F.sum(F.col("__c") * inside).over(W.partitionBy()).alias("__top"),
        F.sum(F.col("__c") * F.col("__n")).over(W.partitionBy()).alias("__all"),
    )


def _rank_at(place: Column, num_top: int, num_buckets: int) -> Column:
    """Rank of the ``place``-th token (from 1) of a class."""
    parts = num_buckets - 1
    bucket = F.lit(0).cast("bigint")
    if parts > 0:
        shares = (F.col("__mass") + F.col("__c") * place - F.col("__top")) * parts
        total = F.nullif(F.col("__all") - F.col("__top"), F.lit(0).cast("bigint"))
        cut = F.call_function("div", shares, total)
        bucket = F.greatest(F.least(F.coalesce(cut, F.lit(parts - 1)), F.lit(parts - 1)), F.lit(0))
    return F.when(F.col("__tokens") + place <= num_top, 0).otherwise(bucket + 1).cast("int")


def freq_ranks(
    df: DataFrame, num_top: int, num_buckets: int, key: str = "token", count: str = "cnt", position: bool = True
) -> DataFrame:
    """Difficulty rank of every token by cumulated frequency mass.

    Tokens run from frequent to rare (ties by key). The first ``num_top`` get rank 0; the mass of the
    rest is cut into ``num_buckets - 1`` equal parts, numbered from 1. Null counts are 0 and come last.

    Ranks grow along the classes of equal count, so a class whose first and last token share a rank gives it to all of
    its tokens. At most ``num_buckets`` classes are cut by a border; only their tokens are put in order. ``position``
    adds every token's place, which needs the order of all.
    """
    counts = df if is_stored(df) else materialise(df, "counted")
    classes = materialise(count_classes(counts, num_top, count), "classes")
    keyed = counts.withColumn("__c", F.coalesce(F.col(count).cast("bigint"), F.lit(0)))
    order = [F.col(count).desc(), F.col(key)]
    if position:
        placed = lookup_join(positions(keyed, order), classes, ["__c"], {})
        rank = _rank_at(F.col("position") - F.col("__tokens"), num_top, num_buckets)
        return placed.select(*df.columns, "position", rank.alias("rank"))
    first, last = (_rank_at(p, num_top, num_buckets) for p in (F.lit(1), F.col("__n")))
    ranked = materialise(classes.select("*", first.alias("rank"), (first != last).alias("__cut")), "class-ranks")
    whole = lookup_join(keyed, ranked.select("__c", "rank", "__cut"), ["__c"], {})
    cut = ranked.filter("__cut").drop("rank", "__cut")  # at most num_buckets rows
    ordered = positions(keyed.join(F.broadcast(cut), "__c"), order, ["__c"], "__place")
    inside = ordered.select(*df.columns, _rank_at(F.col("__place"), num_top, num_buckets).alias("rank"))
    return whole.filter(~F.col("__cut")).select(*df.columns, "rank").unionByName(inside)


def subsample_prob(count: Column, total: Column) -> Column:
    """Probability to keep a word of this corpus frequency."""
    f = count.cast("double") / total
    keep = (F.sqrt(f / SUBSAMPLE_RATE) + 1) * (F.lit(SUBSAMPLE_RATE) / F.nullif(f, F.lit(0.0)))
    return F.coalesce(F.least(F.lit(1.0), keep), F.lit(1.0))
