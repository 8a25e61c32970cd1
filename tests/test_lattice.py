"""Hand-worked lattices."""

from pyspark.sql import functions as F

from seqcorpus.functions import text
from seqcorpus.operators import encode, lattice, vocab
from seqcorpus.operators.encode import encode_sentences
from seqcorpus.sources.records import read_records


def node(i, prev, start, end, surface, pos="n", ranks="1", pos_num="2", extra=""):
    fields = ["-", str(i), prev, str(start), str(end - 1), surface, surface, surface, surface,
              pos, pos_num, "s", "1", "c", "1", "f", "1", f"ランク:{ranks}{extra}"]
    return "\t".join(fields)


def dump(*lines):
    return "\n".join(lines) + "\nEOS"


def frame(spark, *raws):
    return spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "sid bigint, raw string")


def dictionaries(spark, chars="abcdefgh", pos=("n", "v")):
    c = spark.createDataFrame([(ch, i + 4) for i, ch in enumerate(chars)], "ch string, id int")
    rows = [("pos", p, i + 1) for i, p in enumerate(pos)] + [("subpos", "s", 1), ("ctype", "c", 1), ("cform", "f", 1)]
    return c, spark.createDataFrame(rows, "kind string, tag string, id int")


def encoded(spark, raw, **options):
    parsed = lattice.parse_lattice(frame(spark, raw))
    return encode_sentences(lattice.best_path(parsed.drop("reason")), *dictionaries(spark), ["sid"], **options).first()


def test_two_readings_of_one_span(spark):
    row = encoded(spark, dump(node(1, "0", 0, 2, "ab"), node(2, "0", 0, 2, "ab", "v", "2")))
    assert row["chars"] == [2, 4, 5, 3]
    assert row["tags"] == [0] * 5 + [1, 0, 1, 1, 1] + [3, 0, 1, 1, 1] + [0] * 5
    assert row["unks"] == [0, 0, 0, 0, 0, 0]


def test_overlapping_spans_disagree_on_segmentation(spark):
    row = encoded(spark, dump(
        node(1, "0", 0, 1, "a"), node(2, "1", 1, 3, "bc"), node(3, "0", 0, 3, "abc", ranks="2")))
    assert row["chars"] == [2, 4, 5, 6, 3]
    assert [row["tags"][i] for i in (5, 10, 15)] == [1, 0, 3]


def test_best_path_with_dead_end(spark):
    raw = dump(node(1, "0", 0, 1, "a"), node(2, "0", 0, 1, "a", ranks="2"), node(3, "1;2", 1, 2, "b", ranks="1;2"))
    row = lattice.best_path(lattice.parse_lattice(frame(spark, raw))).first()
    assert [n["node_id"] for n in row["path"]] == [1, 3]


def test_best_path_skips_unchained_top_nodes(spark):
    raw = dump(node(1, "0", 0, 1, "a"), node(2, "7", 0, 1, "a"), node(3, "1", 1, 2, "b"), node(4, "2", 1, 2, "b"))
    row = lattice.best_path(lattice.parse_lattice(frame(spark, raw))).first()
    assert [n["node_id"] for n in row["path"]] == [1, 3]


def test_length_mismatch_is_kept_apart(spark):
    assert encoded(spark, dump(node(1, "0", 0, 3, "ab")))["reason"] == "length_mismatch"


def test_empty_sentence_and_max_length(spark):
    row = encoded(spark, "EOS")
    assert (row["chars"], row["tags"], row["unks"]) == ([2, 3], [0] * 10, [0, 0])
    long = encoded(spark, dump(node(1, "0", 0, 2, "ab")), max_length=3)
    assert (long["reason"], long["chars"], long["tags"]) == ("too_long", None, None)
    assert encoded(spark, dump(node(1, "0", 0, 2, "ab")), max_length=4)["reason"] is None


def test_quarantine(spark):
    good = dump("# one", node(1, "0", 0, 1, "a"))
    short = dump("# two", "-\t1\t0")
    number = dump("# three", node("x", "0", 0, 1, "a"))
    score = dump(node(1, "0", 0, 1, "a", extra="|形態素解析スコア:abc"))
    ok, bad = lattice.quarantine(lattice.parse_lattice(frame(spark, good, short, number, score)))
    assert [r["comment"] for r in ok.collect()] == ["# one"]
    got = {r["sid"]: (r["comment"], r["reason"]) for r in bad.collect()}
    assert got == {1: ("# two", "short_line"), 2: ("# three", "bad_number"), 3: (None, "bad_number")}


def test_features(spark):
    raw = dump(node(1, "0;;4", 0, 1, "a", ranks="1;3", extra="|特徴量スコア:1.5|形態素解析スコア:-2|x|k:v:w||未知語"))
    n = lattice.parse_lattice(frame(spark, raw)).first()["nodes"][0]
    assert n["prev"] == [0, 4] and n["ranks"] == [1, 3] and n["end"] == 1
    assert n["feature_score"] == 1.5 and n["analysis_score"] == -2 and n["lm_score"] != n["lm_score"]
    assert [(f["key"], f["value"]) for f in n["features"]] == [("x", None), ("k", "v:w"), ("未知語", None)]


def test_records_without_final_newline_and_long_ones(spark, tmp_path):
    long = "# " + "é" * 140_000
    body = dump(long, node(1, "0", 0, 1, "a")) + "\n" + dump(node(1, "0", 0, 1, "b"))
    (tmp_path / "d.txt").write_text(body, encoding="utf-8")
    ok, bad = lattice.quarantine(lattice.parse_lattice(read_records(spark, str(tmp_path))))
    rows = ok.collect()
    assert bad.count() == 0 and len(rows) == 2
    assert {len(r["comment"] or "") for r in rows} == {0, len(long)}


def test_malformed_utf8(spark, tmp_path):
    (tmp_path / "d.txt").write_bytes(b"# \xff\nEOS\n# ok\nEOS\n")
    rows = read_records(spark, str(tmp_path), strict=False).collect()
    assert sorted(r["valid"] for r in rows) == [False, True]
    try:
        read_records(spark, str(tmp_path)).collect()
    except Exception as e:
        assert "UTF8" in str(e).upper().replace("-", "")
    else:
        raise AssertionError("malformed text was accepted")


def test_text_functions(spark):
    row = spark.range(1).select(
        text.codepoints(F.lit("𠮷a")).alias("c"), text.codept_repr(F.lit("𠮷")).alias("r"),
        text.zen2han(F.lit("ＡＢ")).alias("z"), text.is_full_width(F.lit("ＡＢ")).alias("f"),
        text.is_full_width(F.lit("ＡB")).alias("g"), text.norm_variants(F.lit("b?a")).alias("n"),
        text.norm_variants(F.lit("?b?a")).alias("m"),
        *[text.is_viable(F.lit(x)).alias(f"v{i}") for i, x in enumerate(["a/a", "a/b", "か/か", "a", "a?/a?"])],
    ).first()
    assert row["c"] == ["𠮷", "a"] and row["r"] == "𠮷:20bb7" and row["z"] == "AB"
    assert row["f"] and not row["g"] and row["n"] == "a?b" and row["m"] == "?b?a"
    assert [row[f"v{i}"] for i in range(5)] == [False, True, True, True, True]


def test_counts_and_dictionary(spark):
    raw = dump(node(1, "0", 0, 2, "ab"), node(2, "0", 0, 2, "ab", "v", "2"))
    counts = vocab.feature_counts(lattice.parse_lattice(frame(spark, raw)))
    got = {(r["kind"], r["value"]): r["cnt"] for r in counts.collect()}
    assert got[("cpt", "a")] == 1 and got[("pos", "v")] == 1 and got[("subpos", "s")] == 2
    chars = vocab.build_char_dict(counts, "code").orderBy("id").collect()
    assert len(chars) == 95 and chars[0]["ch"] == "!" and chars[0]["id"] == 4 and chars[0]["label"] == "!:21"


def test_augmentation(spark):
    raw = dump(node(1, "0", 0, 1, "a", pos_num="1"), node(2, "1", 1, 3, "ＢＣ"))
    parsed = lattice.parse_lattice(frame(spark, raw)).drop("reason")
    chars, tags = dictionaries(spark, "aBC")
    sure = encode.Augment(unk_prob=1.0, zen2han_prob=1.0)
    row = encode_sentences(lattice.best_path(parsed), chars, tags, ["sid"], augment=sure).first()
    assert row["codes"] == [2, 4, 1, 1, 3] and row["chars"] == [2, 1, 5, 6, 3]


def test_counts_of_a_batch_without_a_row_per_character(spark):
    kind = "nodes array<struct<surface:string,pos:string,subpos:string,ctype:string,cform:string,ranks:array<int>,node_id:int>>"
    rows = [
        ([("aé𠮷a", "p", "s", "c", None, [1], 1), ("zz", "p", "s", "c", "f", [2], 2), None],),
        ([(None, "q", "s", "c", "f", [2, 1], 1), ("b", "q", "s", "c", "f", [1], 2)],), (None,), ([],),
        ([("", "p", "s", "c", "f", [1], 1), (None, "p", "s", "c", "f", None, 1), ("ab", "p", "s", "c", "f", [None], 1)],),
    ]
    counts = vocab.feature_counts(spark.createDataFrame(rows, kind).coalesce(1))
    assert {(r["kind"], r["value"]): r["cnt"] for r in counts.collect()} == {
        ("cpt", "a"): 2, ("cpt", "é"): 1, ("cpt", "𠮷"): 1, ("pos", "p"): 5, ("pos", None): 1, ("subpos", "s"): 5, ("subpos", None): 1,
        ("conjtype", "c"): 5, ("conjtype", None): 1, ("conjform", "f"): 4, ("conjform", None): 2}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and counts.schema.simpleString() == "struct<kind:string,value:string,cnt:bigint>"
