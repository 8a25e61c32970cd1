"""Sources in name order, written records and the jobs over files."""

import pytest
from pyspark.sql import functions as F

from seqcorpus.plans import analysis, decoding, evaluation
from seqcorpus.sources import examples, records

CHARS = [("a", 4), ("b", 5), ("c", 6)]
TAGS = "kind string, tag string, id bigint"


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.txt").write_text(text)
    return str(folder)


def test_sources_follow_names_and_pass_over_empty_files(spark, tmp_path):
    path = write(tmp_path / "in", b="3\n4\n", a="1\n2\n", c="", d="5\n", e="6")
    files = records.source_files(spark, f"{path}/*.txt").collect()
    assert [(f["source"], f["path"].rsplit("/", 1)[1], f["bytes"]) for f in sorted(files)] == [
        (0, "a.txt", 4), (1, "b.txt", 4), (2, "d.txt", 2), (3, "e.txt", 1)]
    one = records.read_sources(spark, f"{path}/*.txt").orderBy("turn", "line_no", "source")
    assert [r["value"] for r in one.collect()] == ["1", "2", "3", "4", "5", "6"]
    two = records.read_sources(spark, f"{path}/*.txt", 2).orderBy("turn", "line_no", "source")
    assert [r["value"] for r in two.collect()] == ["1", "3", "2", "4", "5", "6"]
    with pytest.raises(ValueError):
        records.read_sources(spark, path, 0)


def test_records_come_back_and_nulls_are_left_out(spark, tmp_path):
    rows = spark.createDataFrame([("# c\na\tB\t50.0\nEOS",), (None,), ("b\tI\t25.0\nEOS",)], "value string")
    records.write_records(rows.coalesce(1), str(tmp_path / "out"))
    back = records.read_debug_table(spark, str(tmp_path / "out")).collect()
    assert [(r["comment"], [(c["ch"], c["tags"][0]["tag"], c["tags"][0]["prob"]) for c in r["chars"]]) for r in back] == [
        ("# c", [("a", "B", 50.0)]), ("", [("b", "I", 25.0)])]


def test_written_records_are_computed_once(spark, tmp_path):
    rows = spark.range(3).select(F.concat(F.col("id").cast("string"), F.lit("\nEOS")).alias("value"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    records.write_records(rows.select(counted("value").alias("value")), str(tmp_path / "out"))
    assert seen.value == 3


def test_analysis_takes_a_list_and_both_ways_agree(spark, tmp_path):
    path = write(tmp_path / "in", a="x y\n\nz\n", b="w\n")
    listed = tmp_path / "list"
    listed.write_text(f"# comment line\nabc\n{path}/a.txt\n{path}/b.txt\n")
    for by_file in (True, False):
        analysis.run(spark, f"@{listed}", "tr a-z A-Z", str(tmp_path / f"out{by_file}"), by_file)
        assert sorted(r[0] for r in spark.read.text(str(tmp_path / f"out{by_file}")).collect()) == ["", "W", "X Y", "Z"]
    (tmp_path / "none").write_text("# only a comment\n")
    with pytest.raises(ValueError):
        analysis.run(spark, f"@{tmp_path}/none", "cat", str(tmp_path / "no"))


def test_requests_are_batched_in_the_order_of_the_input(spark, tmp_path):
    path = write(tmp_path / "in", a="# one\nab\nabcd\n", b="c\n\n# two\nbb\n")
    chars = spark.createDataFrame(CHARS, "ch string, id int")
    got = decoding.requests(spark, path, chars, 2).orderBy("path", "line_no").collect()
    assert [(r["comment"], r["raw"], r["batch_no"], r["length"], r["width"]) for r in got] == [
        ("# one", "ab", 0, 4, 6), ("# one", "abcd", 0, 6, 6), ("", "c", 1, 3, 3), ("", "", 1, 2, 3), ("# two", "bb", 2, 4, 4)]
    assert list(got[1]["codes"]) == [2, 4, 5, 6, 1, 3]


def segmented(first_only: bool):
    """Every character its own token, or one token a line; lines with a ``d`` get no answer, those with ``bb`` a short one."""

    def predict(asked):
        n = F.length("raw")
        tags = F.transform(F.split("raw", ""), lambda _, i: F.when((i == 0) | F.lit(not first_only), 1).otherwise(2))
        tags = F.when(F.col("raw") == "bb", F.slice(tags, 1, 1)).when(n == 0, F.array().cast("array<int>")).otherwise(tags)
        flat = decoding.segment_only(tags)
        probs = F.transform(flat, lambda t: t.cast("double") / 4)
        return asked.filter(~F.col("raw").contains("d")).select(*decoding.KEY, flat.alias("tags"), probs.alias("probs"))

    return predict


def test_decode_job_in_three_formats(spark, tmp_path):
    path = write(tmp_path / "in", a="# one\nab\nabcd\n", b="bb\nc\n")
    chars = spark.createDataFrame(CHARS, "ch string, id int")
    tags = spark.createDataFrame([(k, "x", 1) for k in ("pos", "subpos", "ctype", "cform")], TAGS)
    out = {}
    for fmt in ("juman", "mrph", "debug"):
        target = str(tmp_path / fmt)
        decoding.run(spark, path, chars, tags, segmented(fmt == "mrph"), target, fmt, 2)
        out[fmt] = [r[0] for r in spark.read.text(target).collect()]
        bad = spark.read.parquet(f"{target}.rejected").collect()
        assert sorted((r["path"].rsplit("/", 1)[1], r["line_no"], r["reason"]) for r in bad) == [
            ("a.txt", 2, "no_answer"), ("b.txt", 0, "answer_too_short")]
    rest = " * * NUL 0 NUL 0 NUL 0 NUL 0 NIL"
    assert out["juman"] == ["# one", "a" + rest, "b" + rest, "EOS", "c" + rest, "EOS"]
    assert out["mrph"] == ["ab_NUL:NUL # one", "c_NUL:NUL"]
    none = "\tNUL\tNUL\tNUL\tNUL\t25.0\t0.0\t0.0\t0.0\t0.0"
    assert out["debug"] == ["# one", "a\tB" + none, "b\tB" + none, "EOS", "c\tB" + none, "EOS"]


def test_evaluation_of_sets_by_hand(spark, tmp_path):
    rows = spark.createDataFrame([
        ("x", [0, 0, 1, 5, 2, 5, 1, 6], [9, 9, 1, 5, 2, 4, 1, 6]),  # gold B I B, all found; a wrong second tag
        ("x", [1, 0, 1, 7], [1, 1, 2, 7]),  # gold B B, predicted B I
        ("y", [1, 3, 1, 3], None),  # no prediction at all
        ("y", [1, 3, 1, 3], [1, 3]),  # ends early
    ], "name string, gold array<bigint>, pred array<bigint>")
    got = {(r["name"], r["measure"]): r["value"] for r in evaluation.evaluate(rows, ["seg", "pos"]).collect()}
    assert len(got) == 2 * 12
    # x: shared 3, gold only 1, predicted only 0; one span between shared B's, one bonus a sentence
    assert [got["x", f"seg/{m}"] for m in ("tp", "fp", "fn", "gold")] == [3, 0, 1, 4]
    assert got["x", "seg/precision"] == 1 and got["x", "seg/recall"] == 0.75
    assert got["x", "seg_bnd/precision"] == 1 and got["x", "seg_bnd/recall"] == 0.5
    assert got["x", "seg/acc"] == 4 / 5 and got["x", "pos/acc"] == 3 / 4
    assert got["y", "seg/acc"] == 1 / 4 and got["y", "pos/acc"] == 1 / 4
    empty = evaluation.evaluate(rows.limit(0), ["seg", "pos"])
    assert empty.count() == 0


def test_evaluation_job_over_example_files(spark, tmp_path):
    rows = spark.createDataFrame([([2, 4, 5, 3], [0, 1, 3, 0], [0] * 4, [0] * 4)], examples.EXAMPLE_SCHEMA)
    for name in ("dev", "test"):
        examples.write_examples(rows, str(tmp_path / name))
    sets = {name: str(tmp_path / name) for name in ("dev", "test")}
    evaluation.run(spark, sets, ["seg"], lambda df: df.withColumn("pred", F.col("tags")), str(tmp_path / "report"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert len(lines) == 2 * 11 and "dev\tseg/f1\t1.0" in lines and "test\tseg/acc\t1.0" in lines
    with pytest.raises(ValueError):
        evaluation.run(spark, {}, ["seg"], lambda df: df, str(tmp_path / "no"))


def test_requests_are_numbered_without_their_codes(spark, tmp_path, monkeypatch):
    dealt = []
    positions = decoding.positions
    monkeypatch.setattr(decoding, "positions", lambda df, *a, **k: dealt.append(df.columns) or positions(df, *a, **k))
    path = write(tmp_path / "in", a="# one\nab\n𠮷abc\n")
    got = decoding.requests(spark, path, spark.createDataFrame(CHARS, "ch string, id int"), 2).orderBy("line_no").collect()
    assert dealt == [["path", "line_no", "comment", "raw", "length"]]
    assert [(r["length"], r["width"], len(r["codes"])) for r in got] == [(4, 6, 4), (6, 6, 6)]


def test_words_meet_a_large_vocabulary_without_their_other_columns(spark, monkeypatch):
    from seqcorpus.operators import lexeme

    words = spark.createDataFrame(
        [(1, 1, "b", "動詞", "*", 2, 1), (1, 2, "x", "名詞", "数詞", 0, 0), (2, 1, None, None, None, 0, 0)],
        "doc_id int, tok_no int, word string, pos string, subpos string, category int, conjugation int")
    vocab = spark.createDataFrame([("b", 0)], "word string, id bigint")
    conjugations = spark.createDataFrame([(2 << 16 | 1, 0)], "pos_key int, id int")
    seen, lookup_join = [], lexeme.lookup_join
    monkeypatch.setattr(lexeme, "lookup_join", lambda df, entries, on, *rest: (seen.append((on[0], df.columns)), lookup_join(df, entries, on, *rest, broadcast_bytes=0))[1])
    rows = lexeme.lexeme_ids(words, vocab, conjugations, 1, ["doc_id"])
    assert {r["doc_id"]: r["ids"] for r in rows.collect()} == {1: [2, 14, 13, 6, 3], 2: [2, 4, 3]}
    assert dict(seen)["__word"] == ["doc_id", "tok_no", "__word", "__rule", "conj_id"]
