"""What a query does not name is not made: tags of an encoded path, fields of a node, rows of a count."""

import pytest
from pyspark.sql import functions as F

from seqcorpus import fixtures as fx
from seqcorpus.functions.hashing import draw_bits, drawn_below, unit_of
from seqcorpus.functions.text import codepoints
from seqcorpus.operators import encode, lattice, lookup
from seqcorpus.queries import QUERIES

TEXTS = [(1, "Ab cde fghijklm 12.\n\nzz Quux"), (2, "one"), (3, None), (4, "xあy abcdefg")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_unread_tags_are_not_resolved(spark, folder):
    mark = "sort_array"  # only the sweep over spans orders nodes
    assert mark not in plan_of(QUERIES["encoded_paths"](spark, folder))
    assert mark in plan_of(QUERIES["resolved_tags"](spark, folder))


@pytest.mark.parametrize("name", ["lattice_scores", "records_roundtrip"])
def test_unread_fields_are_not_parsed(spark, folder, monkeypatch, name):
    asked = []
    monkeypatch.setattr(lattice, "_plain_parser", lambda df, raw, fields, own=lattice._plain_parser: asked.append(fields) or own(df, raw, fields))
    QUERIES[name](spark, folder)
    assert asked and not any(f is None or "canonical" in f for f in asked)


def test_dictionary_files_parse_counted_fields(spark, folder, monkeypatch):
    asked = []
    monkeypatch.setattr(fx, "sentences", lambda s, sf, fields=None, own=fx.sentences: asked.append(fields) or own(s, sf, fields))
    assert QUERIES["chardic_file"](spark, folder).count() > 90
    assert asked and None not in asked


def test_char_tags_counts_before_kinds(spark, folder):
    rows = QUERIES["char_tags"](spark, folder)
    assert plan_of(rows).count("Aggregate") == 2  # of equal characters, then of kinds
    found = {(r["seg"], r["kind"], r["tag"]): r["cnt"] for r in rows.collect()}
    begun = {k: sum(n for (seg, kind, _), n in found.items() if (seg, kind) == (1, k)) for k in encode.TAG_KINDS}
    assert begun == dict.fromkeys(encode.TAG_KINDS, 9 + 2)  # a token each, and the rivals of the two long ones


def test_rivals_on_one_span(spark):
    tags = [(k, t, i) for k in encode.TAG_KINDS for i, t in enumerate("xy", 1)]
    df = spark.createDataFrame(
        [(1, [(0, 3, "x", "y", "x", "x"), (0, 3, "y", "y", "x", "z"), (3, 4, "x", "x", "x", "x"), (3, 4, "x", "y", "x", "x")])],
        "sid long, nodes array<struct<start int, end int, pos string, subpos string, ctype string, cform string>>")
    df, tables = lookup.tag_ids(df, spark.createDataFrame(tags, "kind string, tag string, id int"), encode.TAG_KINDS, ["sid"])
    found = df.select(encode.resolve_tags(F.col("nodes"), F.lit(4), tables).alias("t"))
    assert found.schema["t"].dataType.simpleString() == "array<bigint>"
    assert found.first()["t"] == [0] * 5 + [1, 0, 2, 1, 0] + [2, 0, 2, 1, 0] + [3, 0, 2, 1, 0] + [1, 1, 0, 1, 1] + [0] * 5


@pytest.mark.parametrize("share", [0.07, 0.0744, 0.5, 1 / 3])
def test_draws_by_digits(spark, share):
    edge = int(share * 2**32)
    bits = spark.createDataFrame([(f"{edge + i:08x}" + "f0" * 12,) for i in (-1, 0, 1)], "b string")
    rows = bits.union(spark.range(2000).select(draw_bits(1, [F.col("id")], "t")))
    assert rows.filter(drawn_below(F.col("b"), share) != (unit_of(F.col("b")) < share)).isEmpty()


def test_codepoints(spark):
    rows = spark.createDataFrame([("aあ\U0001F600b",), ("",), (None,)], "t string").select(codepoints(F.col("t")).alias("c"))
    assert [r["c"] for r in rows.collect()] == [["a", "あ", "\U0001F600", "b"], [], None]
