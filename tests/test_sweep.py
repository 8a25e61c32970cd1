"""Tag resolution, tag lookup and field-wise parsing against plain versions, and what their plans hold."""

import random

import pytest
from pyspark.sql import functions as F

from seqcorpus.functions.arrays import running_max
from seqcorpus.operators import encode, lattice, lookup, vocab

KINDS = encode.TAG_KINDS
NODES = "sid long, length int, nodes array<struct<start int, end int, pos string, subpos string, ctype string, cform string>>"


def some_nodes(draw, length):
    """A lattice with chains, rivals on one span, crossing spans, gaps and empty nodes."""
    out, at = [], 0
    while at < length:
        end = min(length, at + draw.choice([1, 1, 2, 3, 6]))
        if draw.random() < 0.95:
            for _ in range(draw.choice([1, 1, 1, 2, 3])):
                a, b = (at, end) if draw.random() < 0.7 else sorted(draw.choices(range(max(0, at - 3), min(length, end + 3) + 1), k=2))
                out.append((a, b, *(draw.choice("xyz") for _ in KINDS)))
        at = end
    draw.shuffle(out)
    return out


def brute(nodes, length, ids):
    rows = [[0] * 5]
    for c in range(length):
        cover = []
        for start, end, *tags in nodes:
            if start <= c < end:
                seg = 1 if c == start else 3 if c == end - 1 else 2
                cover.append([seg, *(ids[k].get(t, 0) for k, t in zip(KINDS, tags))])
        rows.append([col[0] if len(set(col)) == 1 else 0 for col in zip(*cover)] if cover else [0] * 5)
    return [x for r in [*rows, [0] * 5] for x in r]


@pytest.mark.parametrize("table_bytes", [1 << 20, 0])  # constant table, then the join
def test_resolved_tags(spark, table_bytes):
    draw = random.Random(2)
    ids = {k: {t: i + 1 for i, t in enumerate(draw.sample("xyz", 2 if k == "pos" else 3))} for k in KINDS}
    tags = spark.createDataFrame([(k, t, i) for k in KINDS for t, i in ids[k].items()], "kind string, tag string, id int")
    rows = [(i, n, some_nodes(draw, n)) for i, n in enumerate([0, 1, 2, 5, 9, 30, 200] * 12)]
    df, tables = lookup.tag_ids(spark.createDataFrame(rows, NODES), tags, KINDS, ["sid"], table_bytes=table_bytes)
    found = {r["sid"]: r["t"] for r in df.select("sid", encode.resolve_tags(F.col("nodes"), F.col("length"), tables).alias("t")).collect()}
    for sid, length, nodes in rows:
        assert found[sid] == brute(nodes, length, ids), nodes


def test_running_max(spark):
    draw = random.Random(1)
    rows = [([draw.randint(0, 99) for _ in range(n)],) for n in (0, 1, 3, 64, 65, 200)]
    for values, found in spark.createDataFrame(rows, "v array<int>").select("v", running_max(F.col("v"), 8)).collect():
        assert found == [max(values[:i + 1]) for i in range(len(values))]


@pytest.mark.parametrize("n", [40, 5_000, 200_000])  # one probe, several, beyond the constant table
def test_hash_table_of_many_tags(spark, n):
    tags = spark.range(n).select(F.lit("pos").alias("kind"), F.concat(F.lit("tag-"), "id").alias("tag"), (F.col("id") + 1).cast("int").alias("id"))
    asked = spark.range(0, n + 50, 1 + n // 20_000).select(F.col("id").alias("sid"), F.array(F.struct(F.concat(F.lit("tag-"), "id").alias("pos"))).alias("nodes"))
    df, tables = lookup.tag_ids(asked, tags, ["pos"], ["sid"])
    ids = df.select("sid", F.get(F.transform("nodes", lambda x: tables["pos"](x["pos"])), F.lit(0)).alias("id"))
    assert "array_position" not in ids._jdf.queryExecution().toString()
    assert ids.filter(F.col("id") != F.when(F.col("sid") < n, F.col("sid") + 1).otherwise(0)).count() == 0 and ids.count() == asked.count()


def lines(*bad):
    good = "-\t{}\t{}\t{}\t{}\tab\tab/ab\tab\tab\tp\t1\ts\t2\tt\t3\tf\t4\t" + "|".join(
        [f"{lattice.KEY_FEATURE_SCORE}:1.5", f"{lattice.KEY_RANKS}:1;2", "flag", "k:v"])
    rows = [good.format(1, 0, 0, 1), good.format(2, "1;", 2, 3)]
    return "# c\n" + "\n".join([*rows, *bad]) + "\nEOS"


def test_fields_do_not_change_what_is_bad(spark):
    line = lines().split("\n")[1]
    odd = [
        line.replace("\t1\t0\t", "\t1 \t0\t"), line.replace("1.5", "1.5e3"), line.replace("1.5", "x"), line.replace(":1;2", ":1;x"),
        line.replace(":1;2", ":1;;2;"), line.replace("\t4\t", "\t\t"), line.replace("\t4\t", "\t99999999999\t"), line + "\tmore:x",
        line.replace("\t4\t", "\t1234567890\t"), line.replace("k:v", f"{lattice.KEY_LM_SCORE}:"), line.replace("|flag", "||"), "short\tline",
        line.replace("k:v", f"{lattice.KEY_RANKS}:bad"), line.replace("1.5", "NaN"), line.replace("ab/ab", "a　b|c"),
    ]
    df = spark.createDataFrame([(i, lines(o)) for i, o in enumerate(odd)] + [(99, lines())], "sid int, raw string")
    whole = {r["sid"]: r for r in lattice.parse_lattice(df).collect()}
    for fields in (lattice.COUNT_FIELDS, lattice.PATH_FIELDS):
        for r in lattice.parse_lattice(df, fields=fields).collect():
            full = whole[r["sid"]]
            assert r["reason"] == full["reason"] and r["comment"] == full["comment"]
            if full["nodes"]:
                assert [n.asDict() for n in r["nodes"]] == [{k: n[k] for k in n.asDict() if k in fields} for n in full["nodes"]]
    reasons = [whole[i]["reason"] for i in range(len(odd))]
    assert reasons == ["bad_number", None, "bad_number", "bad_number", None, "bad_number", "bad_number", None, None, "bad_number", None,
                       "short_line", "bad_number", None, None]


def test_plans_build_only_what_is_asked_for(spark):
    df = spark.createDataFrame([(1, lines())], "sid int, raw string")
    counts = vocab.feature_counts(lattice.parse_lattice(df, fields=lattice.COUNT_FIELDS))
    nodes = lattice.parse_lattice(df, fields=lattice.COUNT_FIELDS).schema["nodes"].dataType.elementType.names
    assert nodes == ["surface", "pos", "subpos", "ctype", "cform", "ranks"] and counts.count() > 0
    chars = spark.createDataFrame([("a", 4), ("b", 5)], "ch string, id int")
    parsed = lattice.parse_lattice(df, fields=lattice.PATH_FIELDS)
    hashed = encode.path_hash(lattice.best_path(parsed), chars, ["sid"])
    plan = hashed._jdf.queryExecution().optimizedPlan().toString()
    assert hashed.count() == 1 and "subpos" not in plan.split("bad_number")[-1]
