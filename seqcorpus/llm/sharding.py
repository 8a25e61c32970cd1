"""Sharding by sampled splitters: shards of near-equal bytes, equal texts in one shard.

Records are drawn by size (a record of k steps is drawn about k times) and the draws' quantiles split the
space of keys (a hash of the text) into many small ranges. Exact bytes and rows of each range are counted;
overfull ranges, which a poor draw makes, are subdivided by a second hash of the key. Ranges
are ordered, so running totals (over ranges, then over the rows within each) give every record's exact byte
position, and that its shard. Records of equal text keep the shard of the first of them.

Groups of equal texts (or single records) above a small part of a shard are not put into ranges. Those that a shard can hold
are dealt first, the largest first, each to the shard that holds least; there are at most ``LARGE_PART`` of them for each shard. Only groups of
more bytes than a shard are parted: their records are spread over cells by a hash of the record and placed by their own
positions. The positions at which one shard ends and the next begins leave each shard just the bytes that it still lacks.
Slots count on over a shard's cells; a cell holds a bounded part of the rows, also of a large group.

All of it is DataFrame operations. What is collected is one row of splitters and one for each large group; what is broadcast has one
row for each cell or large group: at most ``MOST_RANGES`` ranges, as many subdivisions again, and the large groups.

Edge cases: null or empty text has size 8 and checksum 0; null ids sort first; repeated rows take places
one after another; an empty table gives no row; more shards than rows leaves shards empty.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import materialise, query, table

SHARDS = 24
LEAST_RANGES, MOST_RANGES, ROWS_IN_RANGE = 400, 4096, 250_000
DRAWS_IN_RANGE = 50
LARGE_PART = 256  # a group of equal texts above this part of a shard is dealt by itself
CELL_ROWS = 250_000  # of a large group


def _uniform(*columns: str) -> Column:
    """A repeatable draw from [0, 1) for each record."""
    return F.pmod(F.xxhash64(F.lit("draw"), *columns), F.lit(1 << 24)) / float(1 << 24)


def splitters(keyed: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantiles of size-weighted draws of ``key``."""
    step = max(1.0, total / (ranges * DRAWS_IN_RANGE))
    draws = F.floor(F.col("size") / step + _uniform("doc_id", "key")).cast("int")
    drawn = keyed.select("key", draws.alias("n")).filter("n > 0").select("key", F.explode(F.sequence(F.lit(1), "n")))
    quantiles = F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20 * ranges)
    found = drawn.agg(quantiles.alias("q")).first()["q"]
    return sorted(set(found or []))


def range_of(key: Column, splits: list[int]) -> Column:
    """How many splitters are at most ``key``: first among every w-th, then within that stretch."""
    if not splits:
        return F.lit(0)
    width = math.isqrt(len(splits)) + 1
    coarse = F.array(*[F.lit(s) for s in splits[width - 1::width]]) if len(splits) >= width else F.array().cast("array<bigint>")
    stretches = F.array(*[F.array(*[F.lit(s) for s in splits[i:i + width]]) for i in range(0, len(splits) + 1, width)] or [])
    stretch = F.size(F.filter(coarse, lambda s: s <= key))
    inner = F.coalesce(F.get(stretches, stretch), F.array().cast("array<bigint>"))
    return stretch * width + F.size(F.filter(inner, lambda s: s <= key))


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every record of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = materialise(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")), "shard-keys")
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, rows // ROWS_IN_RANGE))
    shard_bytes = total / shards
    groups = keyed.groupBy("key").agg(F.sum("size").alias("group_bytes"), F.count("*").alias("group_rows"))
    big = materialise(groups.filter(F.col("group_bytes") > shard_bytes / LARGE_PART), "large-groups")
    apart = F.col("group_bytes") > shard_bytes  # under ``shards`` groups
    met = keyed.join(F.broadcast(big), "key", "left")
    # units: whole groups, and the large records of groups that no shard can hold
    records = materialise(met.filter(apart & (F.col("size") > shard_bytes / LARGE_PART)).withColumn(
        "unit", F.row_number().over(W.orderBy("key", "doc_id"))), "large-records")
    units = big.filter(~apart).select("key", F.lit(0).alias("unit"), F.col("group_bytes").alias("bytes"), "group_rows").unionByName(
        records.select("key", "unit", F.col("size").alias("bytes"), F.lit(1).cast("long").alias("group_rows")))
    units = units.withColumn("parts", F.ceil(F.col("group_rows") / CELL_ROWS).cast("int"))
    held = [(0, i) for i in range(shards)]
    dealt = []
    for u in sorted(units.collect(), key=lambda u: (-u["bytes"], u["key"], u["unit"])):  # ``LARGE_PART`` a shard at most
        load, shard = heapq.heappop(held)
        heapq.heappush(held, (load + u["bytes"], shard))
        dealt.append((u["key"], u["unit"], u["parts"], -1 - len(dealt), shard))
    units = keyed.sparkSession.createDataFrame(dealt, "key long, unit int, parts int, range int, shard int")
    held = {shard: load for load, shard in held}

    def part_of(parts: Column, *by: str) -> Column:
        return F.pmod(F.xxhash64(F.lit("part"), *by), parts).cast("int")

    own = [*keyed.columns, "range", "part", "shard"]
    whole = met.filter(F.col("group_bytes").isNotNull() & ~apart).join(F.broadcast(units.filter("unit = 0")), "key")
    single = records.join(F.broadcast(units.filter("unit > 0")), ["key", "unit"])
    dealt = whole.unionByName(single, allowMissingColumns=True).withColumn("part", part_of(F.col("parts"), "doc_id")).select(*own)

    # the rest: by position, small groups as one
    rest = met.filter(F.col("group_bytes").isNull() | (apart & (F.col("size") <= shard_bytes / LARGE_PART))).select(
        *keyed.columns, F.coalesce(apart, F.lit(False)).alias("apart"))
    rest_bytes = total - sum(held.values())
    lacking = [max(0.0, shard_bytes - held.get(i, 0)) for i in range(shards)]
    scale = rest_bytes / max(sum(lacking), 1e-9)
    edges = [sum(lacking[:i]) * scale for i in range(1, shards)]
    ranged = rest.withColumn("range", range_of(F.col("key"), splitters(rest, rest_bytes, ranges)))
    # subdivide what holds more than twice its part of the bytes or of the rows: by key, records of parted groups by id
    load = F.greatest(F.sum("size") * F.lit(ranges / max(rest_bytes, 1)), F.count("*") * F.lit(ranges / max(rows, 1)))
    parts = ranged.groupBy("range").agg(F.greatest(F.lit(1), F.ceil(load / 2)).cast("int").alias("parts"))
    part = F.when(F.col("apart"), part_of(F.col("parts"), "doc_id", "key")).otherwise(part_of(F.col("parts"), "key"))
    celled = ranged.join(F.broadcast(parts), "range").withColumn("part", part)
    cells = celled.groupBy("range", "part").agg(F.sum("size").alias("bytes"))
    before = W.orderBy("range", "part").rowsBetween(W.unboundedPreceding, -1)
    based = cells.select("range", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    cell = W.partitionBy("range", "part").orderBy("key", "doc_id", "text_crc32").rowsBetween(W.unboundedPreceding, 0)
    start = F.sum("size").over(cell) - F.col("size")
    group_start = F.min("start").over(W.partitionBy("range", "part", "key"))
    placed = celled.withColumn("start", start).withColumn("group_start", group_start).join(F.broadcast(based), ["range", "part"])
    position = F.col("base") + F.when(F.col("apart"), F.col("start")).otherwise(F.col("group_start"))
    bounds = F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>")
    placed = placed.withColumn("shard", F.size(F.filter(bounds, lambda e: e <= position))).select(*own)

    # slots: a shard's cells one after another
    placed = materialise(placed.unionByName(dealt).select("doc_id", "size", "text_crc32", "key", "shard", "range", "part"), "shards")
    counts = placed.groupBy("shard", "range", "part").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("shard").orderBy("range", "part").rowsBetween(W.unboundedPreceding, -1)
    firsts = materialise(counts.select("shard", "range", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")), "cells")
    row = F.row_number().over(W.partitionBy("shard", "range", "part").orderBy("key", "doc_id", "text_crc32")) - 1
    return placed.withColumn("row", row).join(F.broadcast(firsts), ["shard", "range", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("row")).alias("slot"))


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_by_bytes(table(spark, sf_dir, "documents"))
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
