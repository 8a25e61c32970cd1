"""Resampling against plain Python: checksums, buckets, weights, scores and ranks."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqcorpus.llm import resampling
from seqcorpus.llm.queries import QUERIES

DOCS = "doc_id long, text string, score string, rank int, weight double"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text, width):
    found = words(text)
    return [zlib.crc32(" ".join(found[i:i + n]).encode()) for n in range(1, width + 1) for i in range(len(found) - n + 1)]


def brute(docs, target, share, seed, width, buckets, least):
    s = Counter(f % buckets for _, t in docs for f in features(t, width))
    t = Counter(f % buckets for x in target for f in features(x, width))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for doc_id, text in docs:
        own = features(text, width)
        weight = sum(math.floor(1000 * math.log((t[f % buckets] + 1) * all_s / ((s[f % buckets] + 1) * all_t))) for f in own)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([doc_id, len(words(text)), len(own), weight, score, None])
    eligible = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for i, r in enumerate(eligible[:share * len(eligible) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, rows), key=str)


def corpus(n=200):
    draw = random.Random(4)
    vocabulary = ["a", "the", "Wort", "ÉTÉ", "été", "文字", "x1", "9", "b" * 63, "c" * 64, "d" * 65, "e" * 1000, "ﬁ"]
    texts = [draw.choice([" ", "-", "\n"]).join(draw.choices(vocabulary, k=draw.randint(0, 60))) for _ in range(n)]
    texts += [None, "", "--", "one", "word " * 3000, "f" * 50_000, "a-b_c"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "no id " * 30), (None, None), (3, texts[3]), (3, "other " * 25)]


def test_span_checksums():
    draw = np.random.default_rng(1)
    data = draw.integers(0, 256, 40_000).astype(np.uint8)
    starts = draw.integers(0, 30_000, 400)
    ends = starts + draw.choice([1, 2, 63, 64, 65, 127, 128, 129, 640, 5000, 9999], 400)
    for block in (1, 7, 64):
        found = resampling.SpanChecksums(block)(data, starts, ends)
        assert found.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert len(resampling.SpanChecksums()(data, starts[:0], ends[:0])) == 0


@pytest.mark.parametrize("width", [1, 3])
def test_buckets_of_each_text(width, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 100)
    texts = [t or "" for _, t in corpus(40)]
    found = [[] for _ in texts]
    for buckets, owners in resampling.buckets_of(pa.array(["cut off", *texts]).slice(1), width, 977):
        for b, o in zip(buckets.tolist(), owners.tolist()):
            found[o].append(b)
    assert found == [[f % 977 for f in features(t, width)] for t in texts]


@pytest.mark.parametrize("width,share", [(1, 10), (2, 37)])
def test_resample(spark, width, share):
    docs, target = corpus(), ["the Wort été été", None, "", "x1 9 unseen"]
    table = spark.createDataFrame([(i, t, "s", 1, 2.0) for i, t in docs], DOCS).repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(table, wanted, share, 7, width, 500, 10)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, target, share, 7, width, 500, 10)


def test_empty_tables(spark):
    none, text = spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")
    assert resampling.resample(none, text).count() == 0
    few = spark.createDataFrame([(1, "a " * 30, "", 1, 1.0), (2, None, "", 1, 1.0)], DOCS)
    assert sorted(r["rank"] or 0 for r in resampling.resample(few, text).collect()) == [0, 0]
    assert sorted(r["rank"] or 0 for r in resampling.resample(few, text, share=100).collect()) == [0, 1]


def test_query(spark, tmp_path):
    docs, target = corpus(120), ["the été", "a a a"]
    spark.createDataFrame([(i, t, "s", 1, 2.0) for i, t in docs], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(t,) for t in target], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = QUERIES["op11_resampling"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=str) == brute(docs, target, 10, 2024, 1, 10_000, 20)
