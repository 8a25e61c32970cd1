"""Layouts, mixes, batches, ranks and alignment against plain Python, with hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from seqcorpus.operators import encode, lattice, layout, lookup, metrics, sampling, vocab
from seqcorpus.plans import dictionary, examples
from seqcorpus.sources import pipe, records
from seqcorpus.streaming import counts


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def hot_rows(spark, n=6_000):
    """A third of the rows share one key."""
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") * 7919 % 997).alias("k"))


@pytest.mark.parametrize("n,files", [(6_000, 7), (5, 8), (0, 3), (9, 3)])
def test_files_in_one_order(spark, n, files):
    laid = layout.ordered_files(hot_rows(spark, n), files, [F.col("k"), F.col("id")])
    found = laid.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()).collect()
    rows = sorted(found, key=lambda r: r["at"])
    assert [(r["k"], r["id"]) for r in rows] == sorted((r["k"], r["id"]) for r in rows) and len(rows) == n
    sizes = [sum(r["part"] == f for r in rows) for f in range(files)]
    assert max(sizes) - min(sizes) <= 1
    assert all(r["part"] == r["file"] and r["at"] & ((1 << 33) - 1) == r["place"] for r in rows)


def test_a_hot_key_is_dealt_over_files(spark):
    laid = layout.hashed_files(hot_rows(spark), 8, ["k"], ["id"]).withColumn("part", F.spark_partition_id())
    rows = laid.collect()
    assert len(rows) == 6_000 and all(r["part"] == r["file"] for r in rows)
    assert {r["k"] for r in rows if r["heavy"]} == {-1}
    files_of = {}
    for r in rows:
        files_of.setdefault(r["k"], set()).add(r["file"])
    assert len(files_of.pop(-1)) == 8 and all(len(f) == 1 for f in files_of.values())
    assert max(sum(r["file"] == f for r in rows) for f in range(8)) < 1_500
    held = {r["file"]: r for r in layout.manifest(laid, ["k", "id"]).collect()}
    for f, entry in held.items():
        keys = [(r["k"], r["id"]) for r in rows if r["file"] == f]
        assert (entry["rows"], tuple(entry["first"]), tuple(entry["last"])) == (len(keys), min(keys), max(keys))


def test_null_keys_share_a_file(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(10)], "id int, k string")
    rows = layout.hashed_files(df, 1_000, ["k"], ["id"]).collect()
    assert len(rows) == 10 and all(r["heavy"] for r in rows)
    assert layout.hashed_files(df.limit(0), 4, ["k"], ["id"]).count() == 0


@pytest.mark.parametrize("max_rows", [0, 1, 4, 7, 23, 40, 1_000])
def test_the_last_cycle_is_cut_by_a_formula(spark, max_rows):
    sizes, windows = [11, 3, 20], [3, 1, 4]
    sources = [spark.range(n).select("id") for n in sizes]
    want, at = [], [0, 0, 0]
    while any(a < n for a, n in zip(at, sizes)):
        for i, w in enumerate(windows):
            take = min(w, sizes[i] - at[i])
            want += [(i, at[i] + j) for j in range(take)]
            at[i] += take
    mixed = layout.mix_sources(sources, windows, [F.col("id")], max_rows, place="place", ordered=False)
    plan = plan_of(mixed)
    assert "Limit" not in plan and "rangepartitioning" not in plan
    rows = sorted(mixed.collect(), key=lambda r: r["place"])
    assert [(r["source_no"], r["id"]) for r in rows] == want[:max_rows]
    assert [r["place"] for r in rows] == list(range(1, len(rows) + 1))
    ordered = layout.mix_sources(sources, windows, [F.col("id")], max_rows).collect()
    assert [(r["source_no"], r["id"]) for r in ordered] == want[:max_rows]


def plain_batches(rows, limits, sizes):
    """{(bucket, batch): [(id, length)]} of (id, length) in order."""
    out, count = {}, {}
    for i, length in sorted(rows):
        bucket = sum(b <= length for b in limits)
        place = count.get(bucket, 0)
        count[bucket] = place + 1
        out.setdefault((bucket, place // sizes[bucket]), []).append((i, length))
    return out


@pytest.mark.parametrize("pieces", [1, 5, 40])
def test_batches_equal_a_plain_count(spark, pieces):
    rng = random.Random(pieces)
    rows = [(i, 4 if i % 3 == 0 else rng.randrange(0, 40)) for i in range(900)]  # a hot bucket
    df = spark.createDataFrame(rows, "id int, n int").select("id", F.array_repeat(F.lit(1), F.col("n")).alias("chars"))
    limits, sizes = [8, 16, 30], [7, 3, 2, 1]
    want = plain_batches(rows, limits, sizes)
    made = layout.bucket_batches(df, [F.col("id")], boundaries=limits, sizes=sizes, keep=["id"], pieces=pieces)
    plan = plan_of(made)
    assert plan.count("Exchange") == 1 and "Python" not in plan
    got = {(r["bucket"], r["batch_no"]): r for r in made.collect()}
    assert {k: [(x["id"], x["length"]) for x in r["rows"]] for k, r in got.items()} == want
    assert all(len(x["chars"]) == r["width"] for r in got.values() for x in r["rows"])
    shapes = layout.batch_shapes(df, [F.col("id")], boundaries=limits, sizes=sizes)
    assert "chars" not in plan_of(shapes)
    assert {(r["bucket"], r["batch_no"]): (r["size"], r["width"], r["padding"]) for r in shapes.collect()} == {
        k: (len(v), max(n for _, n in v), sum(max(n for _, n in v) - n for _, n in v)) for k, v in want.items()}


def test_batches_of_nothing(spark):
    df = spark.createDataFrame([], "id int, chars array<int>")
    assert layout.bucket_batches(df, [F.col("id")]).count() == 0
    assert layout.batch_shapes(df, [F.col("id")]).count() == 0


@pytest.mark.parametrize("num_top,num_buckets", [(0, 5), (3, 10), (3, 1), (7, 2), (500, 4), (50, 30)])
def test_ranks_by_classes(spark, num_top, num_buckets):
    rows = [(f"t{i * 37 % 211:03d}", 1 + (i * i) % 7) for i in range(200)] + [("zero", 0), ("none", None)]
    df = spark.createDataFrame(rows, "token string, cnt bigint")
    whole = {r["token"]: r for r in vocab.freq_ranks(df, num_top, num_buckets).collect()}
    classes = {r["token"]: r["rank"] for r in vocab.freq_ranks(df, num_top, num_buckets, position=False).collect()}
    ordered = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    rest = [c or 0 for _, c in ordered[num_top:]]
    total, parts, mass, want = sum(rest), num_buckets - 1, 0, {}
    for place, (token, cnt) in enumerate(ordered):
        if place < num_top:
            want[token] = 0
            continue
        mass += cnt or 0
        want[token] = 1 if parts == 0 else min(mass * parts // total, parts - 1) + 1
    assert classes == want == {t: r["rank"] for t, r in whole.items()}
    assert [r["token"] for r in sorted(whole.values(), key=lambda r: r["position"])] == [t for t, _ in ordered]


def test_ranks_of_nothing(spark):
    df = spark.createDataFrame([], "token string, cnt bigint")
    assert vocab.freq_ranks(df, 2, 3).count() == vocab.freq_ranks(df, 2, 3, position=False).count() == 0


def test_alignment_by_position(spark):
    gold = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 1), (2, 1, 1)], "sid int, position int, tag int")
    pred = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (2, 1, 1), (2, 2, 1)], "sid int, position int, tag int")
    rows = metrics.aligned(gold, pred, ["sid"])
    assert {tuple(r) for r in rows.collect()} == {
        (1, 1, 1, 1, True, True), (1, 2, 2, None, True, False), (1, 3, 1, 2, True, True), (2, 1, 1, 1, True, True),
        (2, 2, None, 1, False, True)}
    held = metrics.aligned_sentences(rows, ["sid"])
    assert plan_of(held).count("Exchange") == 1
    assert {r["sid"]: (r["gold"], r["pred"]) for r in held.collect()} == {1: ([1, 2, 1], [1, 0, 2]), 2: ([1], [1])}
    with pytest.raises(Exception, match="named twice"):
        metrics.aligned(gold.union(gold.limit(1)), pred, ["sid"]).collect()
    counts = {r["sid"]: r for r in metrics.seg_counts(held, by=["sid"]).collect()}
    assert (counts[1]["shared"], counts[1]["gold_only"], counts[2]["shared"]) == (1, 1, 1)


def test_lengths_in_range(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (5,), (None,)], "n int")
    assert [r[0] for r in df.select(encode.in_range(F.col("n"), 2, 4)).collect()] == [False, True, True, False, False]


def test_a_null_line_is_an_empty_one(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "value string").coalesce(1)
    assert [r["value"] for r in pipe.pipe_lines(df, "cat").collect()] == ["a", "", "b"]


def test_comments_of_a_file_in_a_thousand_splits(spark, tmp_path):
    lines = [f"# c{i}" if i % 977 == 5 else f"line {i}" for i in range(12_000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        stored = records._split_lines(spark, str(tmp_path))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert stored.select("block").distinct().count() > 1_000
    rows = sorted(records.with_comments(stored).collect(), key=lambda r: r["line_no"])
    assert [r["value"] for r in rows] == lines
    current = ""
    for r, line in zip(rows, lines):
        current = line if line.startswith("#") else current
        assert (r["comment"], r["is_comment"]) == (current, line.startswith("#"))


def test_what_is_set_apart_is_written(spark, tmp_path):
    node = f"-\t1\t0\t0\t0\ta\ta/a\ta\ta\tn\t1\ts\t1\tc\t1\tf\t1\t{lattice.KEY_RANKS}:1"
    dump = f"# S-ID:1\n{node}\nEOS\n# S-ID:2\n-\t1\nEOS\n"
    (tmp_path / "dump.txt").write_text(dump)
    (tmp_path / "list").write_text(f"{tmp_path}/dump.txt\n")
    dictionary.run(spark, str(tmp_path / "list"), str(tmp_path / "out"))
    bad = spark.read.parquet(f"{tmp_path}/out.rejected").collect()
    assert [(r["comment"], r["reason"]) for r in bad] == [("# S-ID:2", "short_line")]


def test_examples_name_what_is_set_apart(spark, tmp_path):
    def node(i, surface):
        return f"-\t{i}\t{i - 1}\t{i - 1}\t{i - 1}\t{surface}\ta/a\ta\ta\tn\t1\ts\t1\tc\t1\tf\t1\t{lattice.KEY_RANKS}:1"

    raws = [(1, node(1, "a") + "\nEOS"), (2, "-\tx\nEOS"), (3, "\n".join(node(i, "b") for i in range(1, 9)) + "\nEOS")]
    parsed = lattice.parse_lattice(spark.createDataFrame(raws, "sid int, raw string"))
    _, chars, tags = dictionary.dictionaries(lattice.quarantine(parsed)[0])
    options = examples.Options(output_files=1, max_length=6)
    rows, reports = examples.build(parsed, chars, tags, ["sid"], options)
    assert [r["sid"] for r in rows.collect()] == [1]
    assert {tuple(r) for r in reports["rejected"].collect()} == {(2, "short_line"), (3, "too_long")}
    examples.run(parsed, chars, tags, ["sid"], str(tmp_path / "out"), options)
    assert spark.read.parquet(f"{tmp_path}/out.rejected").count() == 2


def test_a_proven_miss_sends_no_keys(spark):
    node = "struct<surface:string,ranks:array<int>>"
    rows = [(i, [(f"w{i % 50}", [1]), (f"w{i % 7}", [1]), (f"x{i}" if i % 2 else "w1", [1])]) for i in range(400)] + [(400, []), (401, None)]
    df = spark.createDataFrame(rows, f"sid int, nodes array<{node}>")
    ranks = spark.createDataFrame([(f"w{i}", i % 9) for i in range(50)], "surface string, rank int")
    keys = sampling.token_keys(F.col("nodes"), lambda n: F.struct(n["surface"].alias("surface")))
    found = {r["sid"]: r["rank"] for r in sampling.sentence_difficulty(df, ranks, ["sid"], 9, keys, ["surface"]).collect()}
    assert found == {i: 9 if i % 2 else max((i % 50) % 9, i % 7, 1) for i in range(400)} | {400: 0, 401: 0}
    table = lookup.bloom_filter(ranks, F.struct("surface"))
    tried = spark.range(2_000).select(F.concat(F.lit("w"), F.col("id")).alias("surface"))
    kept = {r[0] for r in tried.filter(lookup.might_hold(table, F.struct("surface"))).collect()}
    assert {f"w{i}" for i in range(50)} <= kept and len(kept) < 60


def test_a_trigger_adds_only_what_it_changed(spark, tmp_path):
    def dump(word):
        return f"-\t1\t0\t0\t0\t{word}\ta/a\ta\ta\t{word}\t1\ts\t1\tc\t1\tf\t1\t{lattice.KEY_RANKS}:1\nEOS\n"

    folder = tmp_path / "in"
    folder.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for i, words in enumerate((["a", "b"], ["a"], ["c", "a", "a"])):
        (folder / f"{i}.txt").write_text("".join(dump(w) for w in words))
        counts.write_versions(spark, str(folder), out, state, 1).awaitTermination()
    versions = spark.read.parquet(out).filter("kind = 'pos'").collect()
    assert {(r["version"], r["value"], r["cnt"]) for r in versions} == {
        (0, "a", 1), (0, "b", 1), (1, "a", 2), (2, "a", 4), (2, "c", 1)}
    now = {(r["kind"], r["value"]): r["cnt"] for r in counts.read_versions(spark, out).collect()}
    batch = vocab.feature_counts(lattice.parse_lattice(records.read_records(spark, str(folder))))
    assert now == {(r["kind"], r["value"]): r["cnt"] for r in batch.collect()}
    then = counts.read_versions(spark, out, 1).filter("kind = 'pos'").collect()
    assert {(r["value"], r["cnt"]) for r in then} == {("a", 2), ("b", 1)}


def test_lines_of_several_files_follow_each_other(spark, tmp_path):
    for name, lines in (("b", ["3", "4"]), ("a", ["0", "1", "2"])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    rows = records.numbered_lines(spark, str(tmp_path), across=True).collect()
    assert sorted((r["line_no"], r["value"]) for r in rows) == [(i, str(i)) for i in range(5)]


def test_tag_ids_need_no_task_per_kind(spark):
    rows = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, "pos").otherwise("subpos").alias("kind"),
                                     F.format_string("t%04d", "id").alias("value"), (F.col("id") % 10).alias("cnt"))
    got = vocab.build_tag_dict(rows)
    assert "Window" not in plan_of(got)
    for kind in ("pos", "subpos"):
        held = sorted(((r["id"], -r["cnt"], r["tag"]) for r in got.collect() if r["kind"] == kind))
        assert [h[0] for h in held] == list(range(1, len(held) + 1)) and [h[1:] for h in held] == sorted(h[1:] for h in held)
    assert {r["id"] for r in vocab.build_tag_dict(rows, 4).collect()} == {1, 2, 3, 4}
