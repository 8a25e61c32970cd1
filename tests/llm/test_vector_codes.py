"""Dual-tree assignment and the whole fit against plain rounds in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from seqcorpus.llm import vector_codes
from seqcorpus.llm.queries import QUERIES

ROWS = "vec_id long, embedding array<float>, label int, code string, error int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096.0):
    kept = [(i, [math.floor(scale * float(x)) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = -(-len(kept[0][1]) // parts)
    cut = [[(v + [0] * parts)[p * size:(p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        away = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        for p in range(parts):
            found = [nearest(c[p], books[p])[0] for c in cut]
            books[p] = [
                [sum(x) // len(own) for x in zip(*own)] if (own := [c[p] for c, f in zip(cut, found) if f == e]) else old
                for e, old in enumerate(books[p])]
    coded = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for _, d in c) for c in coded]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for e, _ in c), err, by_label[label], digest)
                   for (i, _, label), c, err in zip(kept, coded, errors)), key=str)


def vectors(n, dims=16, seed=1, labels=(0, 1, 2, None)):
    draw = np.random.default_rng(seed)
    x = draw.normal(0, 1, (n, dims)).astype(np.float32) * draw.choice([0.01, 1.0], (n, 1)).astype(np.float32)
    x[n // 2:n // 2 + n // 4] = x[0]  # many equal vectors
    rows = [(i, v.tolist(), labels[i % len(labels)]) for i, v in enumerate(x)]
    return rows


ODD = [(900, None, 1), (901, [None] * 16, 1), (902, [float("nan")] * 16, 2), (903, [float("inf")] + [0.0] * 15, None),
       (None, [0.25] * 16, None), (5, [0.5] * 16, 1), (5, [0.5] * 16, 1)]


def test_assignment_is_exact():
    draw = np.random.default_rng(3)
    for n in (1, 2, 23, 25, 49, 500):
        for k in (1, 2, 5, 16, 40):
            for reach in (2, 9000):  # many ties, few ties
                points, entries = draw.integers(-reach, reach, (n, 4)), draw.integers(-reach, reach, (k, 4))
                order, tree = vector_codes.build(points)
                done = vector_codes.assign(tree, vector_codes.Codebook(entries))
                labels = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
                assert (done.labels == labels[order]).all()
                sums = np.zeros_like(entries)
                np.add.at(sums, labels, points)
                assert (done.sums == sums).all() and (done.counts == np.bincount(labels, minlength=k)).all()


def test_nodes_far_apart_are_assigned_whole():
    draw = np.random.default_rng(4)
    centres = draw.integers(-10**6, 10**6, (8, 4))
    points = (centres[:, None] + draw.integers(-50, 50, (8, 200, 4))).reshape(-1, 4)
    _, tree = vector_codes.build(points)
    assert vector_codes.assign(tree, vector_codes.Codebook(centres)).measured < 0.1 * len(points) * 8


@pytest.mark.parametrize("block_rows", [8192, 30])
def test_codes(spark, tmp_path, monkeypatch, block_rows):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", block_rows)
    rows = vectors(150) + ODD
    spark.createDataFrame([(*r, "c", 1) for r in rows], ROWS).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["op13_vector_codes"](spark, str(tmp_path))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_few_rows_odd_lengths_and_none(spark):
    def rows(found):
        return sorted(map(tuple, found.select("vec_id", "code", "error").collect()))

    few = vectors(5, 11)
    table = spark.createDataFrame([(*r, "c", 1) for r in few + [(99, [1.0, 2.0], 1), (98, [1e30] * 11, 1)]], ROWS)
    codes, books = vector_codes.encode(table, parts=4, entries=16, rounds=2)
    assert rows(codes) == sorted(r[:3] for r in brute(few, 4, 16, 2)) and [b.shape for b in books] == [(5, 3)] * 4
    codes, _ = vector_codes.encode(spark.createDataFrame([], ROWS))
    assert codes.count() == 0
