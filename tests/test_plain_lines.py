"""Plain lattice lines by Arrow batch, and distinct structs without comparing all pairs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqcorpus import fixtures as fx
from seqcorpus.functions.arrays import distinct_structs
from seqcorpus.operators import lattice, node_lines
from seqcorpus.sources import scratch


def line(**changed):
    fields = ["-", "1", "0", "0", "1", "su", "su/x", "re", "di", "pos", "1", "sub", "2", "ct", "3", "cf", "4",
              "特徴量スコア:1.5|形態素解析スコア:-2.25|x:y:z|flag|ランク:1;2"]
    for place, value in changed.items():
        fields[int(place[1:])] = value
    return "\t".join(fields)


def test_only_plain_sentences_are_built_by_batch(spark):
    texts = [f"# a\n{line()}\n{line(f2='0;;1', f17='ランク:1|ランク:2')}\nEOS", f"{line()}\r\nEOS", f"{line(f1=' 1')}\nEOS",
             "-\t1\nEOS", f"{line(f17='特徴量スコア:1e3')}\nEOS\nrest", None, "EOS", f"{line(f17='a:|:b||c')}\n#z\n", "\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string").coalesce(1)
    parser, schema = lattice._plain_parser(df, "raw", None)
    assert {r["i"] for r in df.mapInArrow(parser, schema).filter("__done").collect()} == {0, 6, 7}
    rows = {r["i"]: r for r in lattice.parse_lattice(df).collect()}
    assert [rows[i]["reason"] for i in range(9)] == [None, None, "bad_number", "short_line", None, None, None, None, "short_line"]
    first, second = rows[0]["nodes"]
    assert rows[0]["comment"] == "# a" and rows[7]["comment"] == "#z"
    assert (first["node_id"], first["prev"], first["end"], first["ranks"]) == (1, [0], 2, [1, 2])
    assert (first["feature_score"], first["analysis_score"], first["lm_score"] != first["lm_score"]) == (1.5, -2.25, True)
    assert [tuple(f) for f in first["features"]] == [("x", "y:z"), ("flag", None)]
    assert (second["prev"], second["ranks"], second["features"]) == ([0, 1], [2], [])
    assert [tuple(f) for f in rows[7]["nodes"][0]["features"]] == [("a", ""), ("", "b"), ("c", None)]
    assert rows[1]["nodes"][0]["surface"] == "su"
    assert rows[4]["nodes"][0]["feature_score"] == 1000.0 and rows[5]["nodes"] == rows[6]["nodes"] == []


def test_lines_and_fields_are_places_in_the_bytes():
    texts = pa.array(["skipped", "a\tÄb\n", "", "12;-3\n\n語"]).slice(1)
    data, offsets = node_lines.parts_of(texts)
    assert bytes(data).decode() == "a\tÄb\n12;-3\n\n語" and offsets[0] == 0
    newlines, tabs = node_lines.marks_of(data, "\n", "\t")
    begin, end, owner = node_lines.cut(offsets[:-1], offsets[1:], newlines)
    assert node_lines.texts_at(data, begin, end).to_pylist() == ["a\tÄb", "", "", "12;-3", "", "語"] and owner.tolist() == [0, 0, 1, 2, 2, 2]
    words = node_lines.words_of(data)
    assert node_lines.begins(words, begin, end, "語").tolist() == [5] and node_lines.begins(words, begin, end, "a\tÄbc").tolist() == []
    data = np.frombuffer("7-12-1234567890x1".encode(), np.uint8)
    value, good = node_lines.numbers(data, np.array([0, 1, 4, 5, 15, 17, 1]), np.array([1, 4, 5, 15, 17, 17, 2]))
    assert good.tolist() == [True, True, False, False, False, False, False] and value[:2].tolist() == [7, -12]


def test_odd_sentences_between_plain_ones(spark):
    odd = ["特徴量スコア:1x|ランク:1", "特徴量スコア:1.5|特徴量スコア:2.5|ランク:1", "ランク:1;x", "ランク:1234567890", "ランク:", "x\tmore"]
    texts = [None if i % 5 == 4 else f"# {i}\n{line(f1=str(i))}\n{line(f17=odd[i % 6])}\nEOS" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string").coalesce(1)
    rows = lattice.parse_lattice(df).orderBy("i").collect()
    for i, r in enumerate(rows):
        if i % 5 == 4:
            assert (r["comment"], r["nodes"], r["reason"]) == (None, [], None)
            continue
        assert (r["comment"], r["reason"]) == (f"# {i}", "bad_number" if i % 6 in (0, 2) else None)
        if not r["reason"]:
            assert r["nodes"][0]["node_id"] == i and r["nodes"][0]["ranks"] == [1, 2] and r["nodes"][1]["ranks"] == {1: [1], 3: [1234567890]}.get(i % 6, [])
            assert i % 6 != 1 or r["nodes"][1]["feature_score"] == 2.5


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_pydict({"i": pa.array(range(6)), "raw": pa.array(["aaaa", None, "bbbbbbbbbbbb", "", "c", "dddd"])})
    parts = list(node_lines.slices(batch, "raw", 8))
    assert len(parts) > 1 and [i for p in parts for i in p.column("i").to_pylist()] == list(range(6))


def test_node_texts_lower_and_place():
    text, other = fx.node_texts(pa.array([" AbC  12\r İstanbulΣ x|y.", "a"])).to_pylist()
    rows = [r.split("\t") for r in text.split("\n")[:-1]]
    assert [(r[1], r[2], r[3], r[4], r[9]) for r in rows] == [
        ("1", "0", "0", "2", "word"), ("3", "1", "3", "5", "num"), ("5", "3", "6", "14", "mixed"), ("6", "3", "6", "14", "alt"),
        ("7", "5", "15", "18", "mixed")]
    assert rows[2][7] == "i̇stanbulς" and rows[4][11] == "punct" and rows[4][17].endswith("正規化代表表記:x/y./x/y.|ランク:1")
    assert other.startswith("-\t1\t0\t0\t0\ta\ta/a\ta\ta\tword\t2\t")


def test_distinct_keys_without_all_pairs(spark):
    df = spark.sql("""SELECT from_json('[{"x":"b"},{"x":"a","y":"1"},{"x":"b"},{"x":"a"},{"x":"a","y":"1"}]', 'array<struct<x:string,y:string>>') AS k""")
    assert [tuple(r) for r in df.select(distinct_structs(F.col("k")).alias("d")).first()["d"]] == [("a", None), ("a", "1"), ("b", None)]


def test_pieces_of_a_scan_grow_with_it(spark, tmp_path, monkeypatch):
    spark.range(5000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert scratch.spread(docs, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(scratch, "SPREAD_ROWS", 100)
    pieces = scratch.spread(docs, "doc_id")
    assert pieces.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism and pieces.count() == 5000


def test_tokens_compute_only_the_kinds_that_are_named(spark, tmp_path):
    spark.createDataFrame([(1, " Ab  12,\n\nx"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = fx.tokens(spark, str(tmp_path))
    assert sorted(tuple(r) for r in rows.collect()) == [
        (1, 1, 1, "Ab", 2, "word", "plain", "cap", "short"), (1, 1, 2, "12,", 3, "mixed", "punct", "low", "short"),
        (1, 3, 1, "x", 1, "word", "plain", "low", "short")]
    plan = rows.select("surface", "cform")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper() and "aggregate(" not in plan
