"""Hashes, ranks, sampling, masks, positions, metrics against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from seqcorpus.functions import hashing
from seqcorpus.functions.arrays import offsets
from seqcorpus.operators import layout, lookup, masking, metrics, numbering, sampling, vocab


def plain_hash(values, seed=0xDEADBEEF):
    def rot(x, r):
        return ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF

    def item(k):
        return rot((k * 0xCC9E2D51) & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF

    h = seed
    for v in values:
        for k in ((v >> 32) & 0xFFFFFFFF, v & 0xFFFFFFFF):
            h = (rot(h ^ item(k), 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= item(len(values))
    return h - (1 << 32) if h >= 1 << 31 else h


def test_seq_hash(spark):
    rng = random.Random(7)
    rows = [[2, 5, 17, 3], []] + [[rng.randrange(1 << 31) for _ in range(rng.randrange(40))] for _ in range(50)]
    wide = [[rng.randrange(-(1 << 63), 1 << 63) for _ in range(rng.randrange(9))] for _ in range(50)]
    df = spark.createDataFrame([(r,) for r in rows], "a array<bigint>")
    got = df.select("a", hashing.seq_hash(F.col("a"), narrow=True).alias("n"), hashing.seq_hash(F.col("a"), narrow=False).alias("w"))
    for r in got.collect():
        assert r["n"] == r["w"] == plain_hash(r["a"])
    assert plain_hash([2, 5, 17, 3]) & 0xFFFFFFFF == 3335405373
    df = spark.createDataFrame([(r,) for r in wide], "a array<bigint>")
    for r in df.select("a", hashing.seq_hash(F.col("a"), narrow=False).alias("w")).collect():
        assert r["w"] == plain_hash(r["a"])


def test_offsets(spark):
    for n in (0, 1, 63, 64, 65, 300):
        values = [(i * 7) % 5 for i in range(n)]
        row = spark.createDataFrame([(values,)], "a array<int>").select(offsets(F.col("a")).alias("o")).first()
        assert row["o"] == [sum(values[:i]) for i in range(n)]


def loop_ranks(counts, num_top, num_buckets):
    rest = counts[num_top:]
    total, parts = sum(rest), num_buckets - 1
    out, cum = [0] * min(num_top, len(counts)), 0
    for c in rest:
        cum += c
        out.append(1 if parts == 0 else max(min(cum * parts // total, parts - 1), 0) + 1)
    return out


@pytest.mark.parametrize("num_top,num_buckets", [(0, 5), (3, 10), (3, 1), (3, 2), (500, 4)])
def test_freq_ranks(spark, num_top, num_buckets):
    counts = sorted((1 + (i * i) % 91 for i in range(120)), reverse=True)
    df = spark.createDataFrame([(f"t{i:03d}", c) for i, c in enumerate(counts)], "token string, cnt bigint")
    rows = vocab.freq_ranks(df, num_top, num_buckets).orderBy("position").collect()
    assert [r["rank"] for r in rows] == loop_ranks(counts, num_top, num_buckets)


def test_positions_with_a_hot_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(99).alias("g"))
    got = numbering.positions(df, [F.col("id").desc()], ["g"], pieces=16)
    want = df.withColumn("p", F.row_number().over(W.partitionBy("g").orderBy(F.col("id").desc())).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and got.count() == 3000
    hot = numbering._placed(numbering._sorted_ranges(df, [F.col("id")], ["g"], 16)).filter("g = 99").select("__part").distinct().count()
    assert hot > 4


def test_prefix_sums(spark):
    df = spark.range(1000).select("id", (F.col("id") % 13).alias("v"))
    got = {r["id"]: (r["running"], r["running_total"]) for r in numbering.prefix_sums(df, [F.col("id")], "v", pieces=7).collect()}
    total = sum(i % 13 for i in range(1000))
    assert all(got[i] == (sum(j % 13 for j in range(i + 1)), total) for i in range(0, 1000, 37))


def test_moving_windows_across_chunks(spark):
    df = spark.range(500).select(
        "id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("g"), (F.col("id") % 17).cast("double").alias("v"),
        (F.col("id") * F.col("id")).cast("double").alias("s"))
    w = W.partitionBy("g").orderBy("id")
    frame = w.rowsBetween(-4, 0)
    want = df.withColumn("d", F.coalesce(F.col("s") - F.lag("s").over(w), F.lit(0.0))).select(
        "id", (F.sum("v").over(frame) / 5).alias("m"),
        F.coalesce(F.sum("v").over(frame) / F.nullif(F.sum("d").over(frame), F.lit(0.0)), F.lit(0.0)).alias("r"))
    mean = metrics.moving_mean(df, "v", [F.col("id")], ["g"], 5, "m", chunk_rows=8).select("id", "m")
    rate = metrics.moving_rate(df, "v", "s", [F.col("id")], ["g"], 5, "r", chunk_rows=8).select("id", "r")
    both = {r["id"]: (round(r["m"], 9), round(r["r"], 9)) for r in mean.join(rate, "id").collect()}
    assert len(both) == 500
    assert both == {r["id"]: (round(r["m"], 9), round(r["r"], 9)) for r in want.collect()}


def test_sampling_plan(spark):
    hist = spark.createDataFrame([(1, 60), (2, 30), (3, 10)], "rank int, cnt bigint")
    rows = sampling.sampling_plan(hist, 4, 0.5, 0.1).orderBy("rank").collect()
    assert [r["cnt"] for r in rows] == [0, 60, 30, 10, 0]
    assert [round(r["weight"], 4) for r in (rows[0], rows[4])] == [0.1, 0.1]
    assert all(0 < r["weight"] <= 1 for r in rows)
    rich = sampling.sampling_plan(hist, 3, 0.99, 0.1).orderBy("rank").collect()
    assert [round(r["weight"], 4) for r in rich] == [0.9, 1.0, 1.0, 0.9]


def test_smooth_weight_has_the_asked_mean(spark):
    xs = spark.range(2001).select((F.col("id") / 2000).alias("x"))
    for ratio in (0.1, 0.5, 0.8, 0.95):
        row = xs.select(sampling.smooth_weight(F.col("x"), F.lit(ratio)).alias("w")).agg(F.avg("w"), F.max("w")).first()
        assert abs(row[0] - ratio) < 1e-3 and row[1] <= 1 + 1e-9


def test_sentence_difficulty_default_and_empty(spark):
    node = "struct<surface:string,reading:string,dicform:string,pos:string,subpos:string,ctype:string,cform:string,ranks:array<int>>"
    known, other = ["a"] * 7, ["b"] * 7
    df = spark.createDataFrame(
        [(1, [(*known, [1])]), (2, [(*known, [1]), (*other, [1])]), (3, [(*other, [2])]), (4, [])],
        f"sid int, nodes array<{node}>")
    dic = spark.createDataFrame([(*known, 2)], "surface string, reading string, dicform string, pos string, subpos string, ctype string, cform string, rank int")
    got = {r["sid"]: r["rank"] for r in sampling.sentence_difficulty(df, dic, ["sid"], sampling.default_rank(dic)).collect()}
    assert got == {1: 2, 2: 3, 3: 0, 4: 0}


def test_join_with_hot_keys_equals_broadcast(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 60).alias("k"))
    dic = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    small = lookup.lookup_join(df, dic, ["k"], {"v": -1})
    large = lookup.lookup_join(df, dic, ["k"], {"v": -1}, broadcast_bytes=5, hot_share=4)
    assert small.exceptAll(large).count() == 0 and large.count() == 500
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_random_char_table(spark):
    chars = spark.createDataFrame([(chr(97 + i), (i * 37) % 900, i + 4) for i in range(26)], "ch string, cnt bigint, id int")
    table = masking.random_char_table(chars, 20)
    draws = [i / 997 for i in range(997)]
    df = spark.createDataFrame([(u,) for u in draws], "u double")
    got = {r["u"]: r["c"] for r in df.select("u", masking.random_char(table, F.col("u")).alias("c")).collect()}
    best = sorted(chars.collect(), key=lambda r: (-r["cnt"], r["ch"]))[:20]
    upto = np.cumsum(np.sqrt(np.array([r["cnt"] for r in best]) + 100.0))
    upto /= upto[-1]
    for u in draws:
        assert got[u] == best[min(int(np.searchsorted(upto, u, side="right")), 19)]["id"]


def test_boundaries():
    assert layout.bucket_boundaries() == [
        8, 9, 10, 12, 14, 16, 19, 22, 26, 31, 37, 44, 52, 62, 74, 88, 105, 126, 151, 181, 217]
    assert layout.batch_sizes(100, [8, 10]) == [13, 11, 1]
    with pytest.raises(ValueError):
        layout.bucket_boundaries(4, 200, 1.2)


def test_zigzag_and_jitter(spark):
    row = spark.range(1).select(
        hashing.zigzag_key(F.lit(10), F.lit(-5), 100).alias("a"), hashing.zigzag_key(F.lit(10), F.lit(5), 100).alias("b"),
        hashing.jitter_len(F.lit(5), F.lit(0.0)).alias("c"), hashing.jitter_len(F.lit(20), F.lit(0.999)).alias("d")).first()
    assert tuple(row) == (90, -90, 4, 23)


def test_last_token_wrong(spark):
    df = spark.createDataFrame([([1, 3, 1, 2, 1], [1, 3, 1, 2, 2])], "gold array<int>, pred array<int>")
    counts = metrics.seg_counts(df)
    row = counts.first()
    assert (row["shared"], row["gold_only"], row["pred_only"], row["matched"], row["aligned"]) == (2, 1, 0, 1, 0)
    assert metrics.seg_token_prf(counts).first()["tp"] == 2
    assert metrics.seg_token_prf(counts, strict=True).first()["tp"] == 1
    boundary = metrics.seg_boundary_prf(counts).first()
    assert (boundary["tp"], boundary["fp"], boundary["fn"]) == (1, 0, 1)


def test_span_matches_by_brute_force(spark):
    rng = random.Random(3)
    rows = [([rng.choice([0, 1, 2, 3]) for _ in range(n)], [rng.choice([1, 2]) for _ in range(n)]) for n in range(1, 60)]
    df = spark.createDataFrame(rows, "gold array<int>, pred array<int>")
    want = 0
    for gold, pred in rows:
        g = [i for i, x in enumerate(gold) if x == 1]
        p = [i for i, x in enumerate(pred) if x == 1 and gold[i] != 0]
        spans = set(zip(g, g[1:]))
        want += len(spans & set(zip(p, p[1:])))
    assert metrics.seg_counts(df).first()["matched"] == want
