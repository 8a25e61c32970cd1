"""Cells of sentences by Arrow batch: packed alignment and counts, beside plain loops."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from seqcorpus import fixtures as fx
from seqcorpus.operators import metrics, runs


def test_alignment_travels_in_lists(spark):
    rng = random.Random(5)
    gold = [(s, p, rng.choice([0, 1, 2])) for s in (1, 2, None) for p in (None, -3, 1, 2, 7, 1 << 40) if rng.random() < 0.8]
    pred = [(s, p, rng.choice([1, 2])) for s in (1, 2, 3, None) for p in (None, 1, 2, 9, 1 << 40) if rng.random() < 0.8]
    rng.shuffle(gold)
    kinds = "sid int, position long, tag int"
    rows = metrics.aligned(spark.createDataFrame(gold, kinds), spark.createDataFrame(pred, kinds), ["sid"])
    g, p = {r[:2]: r[2] for r in gold}, {r[:2]: r[2] for r in pred}
    want = {(*k, g.get(k), p.get(k), k in g, k in p) for k in g | p}
    assert {tuple(r) for r in rows.collect()} == want and rows.count() == len(want)
    held = {r["sid"]: (r["gold"], r["pred"]) for r in metrics.aligned_sentences(rows, ["sid"]).collect()}
    again = {r["sid"]: (r["gold"], r["pred"]) for r in metrics.aligned_sentences(rows.select("*"), ["sid"]).collect()}
    assert held == again and set(held) == {k[0] for k in g}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.index("MapInArrow") < plan.index("Exchange hashpartitioning") < plan.rindex("MapInArrow")


def test_sentences_go_on_over_batches():
    packed = runs.Packer(["s", "__gold"], "at", ["__tag"])
    rows = [(s, gold, at, at % 3) for s in range(40) for gold in (True, False) for at in range(1, 30) if gold or at % 2]
    names = ["s", "__gold", "at", "__tag"]
    cut = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i:i + 7])], names=names) for i in range(0, len(rows), 7)]
    merged = [r for b in runs.Merger(["s"], "at", [])(packed(cut)) for r in b.to_pylist()]
    assert [r["s"] for r in merged] == list(range(40))
    for r in merged:
        assert [(c["at"], c["gold"], c["pred"], c["__g"], c["__p"]) for c in r["__cells"]] == [
            (at, at % 3, at % 3 if at % 2 else None, 1, at % 2) for at in range(1, 30)]


def test_counts_of_odd_sentences(spark):
    rows = [("a", [1, None, 1, 3], [1, 1]), ("a", None, [1]), ("a", [], []), ("b", [1, 2, 1], [1, 2, 1, 1]), (None, [0, 1], None)]
    df = spark.createDataFrame(rows, "name string, gold array<int>, pred array<int>")
    counts = {r["name"]: tuple(r)[1:] for r in metrics.seg_counts(df, by=["name"]).collect()}
    assert counts == {"a": (3, 1, 1, 0, 0, 0), "b": (1, 2, 0, 0, 1, 1), None: (1, 0, 0, 0, 0, 0)}
    rated = {(r["name"], r["kind"]): (r["labels"], r["hits"]) for r in metrics.tag_accuracy(df, "gold", "pred", ["x", "y"], ["name"]).collect()}
    assert rated == {("a", "x"): (2, 1), ("a", "y"): (2, 0), ("b", "x"): (2, 2), ("b", "y"): (2, 1), (None, "x"): (None, None), (None, "y"): (None, None)}
    assert "aggregate(" not in metrics.seg_counts(df)._jdf.queryExecution().executedPlan().toString()


def test_tags_of_large_and_null_ids(spark, tmp_path):
    docs = [(1 << 62, "é𠮷b c\n\nab"), (None, "ab c"), (-5, "  xyz ")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["line_no"]): (r["gold"], r["pred"]) for r in fx.gold_pred(spark, str(tmp_path)).collect()}

    def flipped(doc, line, gold):
        return [t if doc is not None and (doc * 31 + line * 17 + p * 7) % 13 else 2 if t == 1 else 1 for p, t in enumerate(gold, 1)]

    want = {(1 << 62, 1): [1, 2, 3, 1], (1 << 62, 3): [1, 3], (None, 1): [1, 3, 1], (-5, 1): [1, 2, 3]}
    assert got == {k: (g, flipped(*k, g)) for k, g in want.items()}
    cells = fx.tagged_chars(spark, str(tmp_path)).filter(F.col("line_no") == 1).collect()
    assert [tuple(r)[2:] for r in cells if r["doc_id"] == 1 << 62] == [(1, "é", 1), (2, "𠮷", 2), (3, "b", 3), (4, "c", 1)]


def test_keys_are_made_of_counted_surfaces(spark, tmp_path):
    spark.createDataFrame([(1, "Ab x Ab,\nAb Ab,"), (1, "x 12"), (2, None)], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    rows = fx.token_counts(spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == [
        ("Ab", "ab", "ab", "word", "plain", "cap", "short", 2), ("Ab,", "ab,", "ab,", "mixed", "punct", "cap", "short", 2),
        ("x", "x", "x", "word", "plain", "low", "short", 2)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().index("RLIKE") < plan.index("Aggregate")
