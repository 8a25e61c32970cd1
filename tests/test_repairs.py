from pyspark.sql import functions as F

from seqcorpus.functions.hashing import seq_hash
from seqcorpus.operators.lexeme import restore_text
from seqcorpus.operators.layout import shuffle_rows, sort_by_length
from seqcorpus.operators.lookup import gold_pred_join, lookup_join
from seqcorpus.operators.numbering import positions, prefix_sums
from seqcorpus.operators.sampling import sentence_difficulty, token_keys
from seqcorpus.sources.records import read_records


def test_hash_mixes_high_halves_by_default(spark):
    df = spark.createDataFrame([([1 << 33, 5],), ([0, 5],)], "a array<long>")
    found = df.select(seq_hash(F.col("a")).alias("h"), seq_hash(F.col("a"), narrow=False).alias("w")).collect()
    assert [r["h"] for r in found] == [r["w"] for r in found] and found[0]["h"] == -1859851448


def test_sentences_without_ids_are_restored_as_empty(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, []), (3, None)], "sid int, ids array<long>")
    labels = spark.createDataFrame([(5, "a")], "id long, label string")
    found = {r["sid"]: list(r)[1] for r in restore_text(df, labels, ["sid"]).collect()}
    assert set(found) == {1, 2, 3} and found[1] == "a UNK" and not found[2] and not found[3]


def test_join_keeps_rows_of_one_side(spark):
    gold = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "sid int, pos int, gold string")
    pred = spark.createDataFrame([(1, 1, "y"), (1, 2, "z")], "sid int, pos int, pred string")
    found = sorted(map(tuple, gold_pred_join(gold, pred, ["sid", "pos"]).collect()), key=str)
    assert found == [(1, 0, "x", None), (1, 1, "y", "y"), (1, 2, None, "z")]


def test_only_a_whole_line_ends_a_record(spark, tmp_path):
    (tmp_path / "a.txt").write_text("EOS\nEOS\n# title VIDEOS\nx\nEOS\nEOS\ny\nEOS\n\nEOS\nz\nEOS")
    (tmp_path / "b.txt").write_text("# cut\nw\n")
    (tmp_path / "c.txt").write_text("v\nEOS\nEOS\n")
    (tmp_path / "d.txt").write_text("EOS")
    (tmp_path / "e.txt").write_text("")
    found = sorted(r["raw"] for r in read_records(spark, str(tmp_path)).collect())
    assert found == sorted(
        ["EOS", "# title VIDEOS\nx\nEOS", "EOS", "y\nEOS", "EOS", "z\nEOS", "# cut\nw\nEOS", "v\nEOS", "EOS", "EOS"])


def test_hot_keys_are_spread_and_keep_their_values(spark):
    hot = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 5 == 0, None).otherwise(F.col("id"))
    df = spark.range(20_000).select("id", hot.alias("k"))
    words = spark.range(5_000).select(F.col("id").alias("k"), F.concat(F.lit("w"), "id").alias("v"))
    found = lookup_join(df, words, ["k"], {"v": "none"}, broadcast_bytes=1)
    want = df.join(words, "k", "left").select("id", "k", F.coalesce("v", F.lit("none")).alias("v"))
    assert found.exceptAll(want).isEmpty() and found.count() == 20_000
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 10_000


def test_ranks_deal_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(5_000).select("id", (F.col("id") % 3).alias("g"))
        plan = positions(df, [F.col("id")])._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan
        found = prefix_sums(df, [F.col("id").desc()], "g")
        assert "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString()
        assert found.filter("id = 0").select("running", "running_total", "position").first() == (4999, 4999, 5000)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_prefix_sums_with_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 2)], "id int, v int")
    found = prefix_sums(df, [F.col("id")], "v", pieces=2).orderBy("id").collect()
    assert [(r["v"], r["position"], r["running"], r["running_total"]) for r in found] == [(5, 1, 5, 7), (None, 2, 5, 7), (2, 3, 7, 7)]
    assert prefix_sums(df.limit(0), [F.col("id")], "v").count() == 0


def test_layouts_are_in_order(spark):
    df = spark.range(3_000).select("id", (F.col("id") * 7919 % 101).alias("k1"), (F.col("id") * 31 % 17).alias("k2"))
    laid = sort_by_length(df, 5).select("k1", "k2", F.monotonically_increasing_id().alias("at")).collect()
    keys = [(r["k1"], r["k2"]) for r in sorted(laid, key=lambda r: r["at"])]
    assert keys == sorted(keys) and len({r["at"] >> 33 for r in laid}) == 5
    drawn = shuffle_rows(df, ["id"]).collect()
    draws = [r["draw"] for r in drawn]
    assert draws == sorted(draws) and [r["id"] for r in drawn] != sorted(r["id"] for r in drawn)
    assert [r["id"] for r in shuffle_rows(df.repartition(7), ["id"]).collect()] == [r["id"] for r in drawn]


def test_difficulty_by_another_key(spark):
    node = "struct<surface:string,pos:string,ranks:array<int>>"
    df = spark.createDataFrame([(1, [("a", "n", [1])]), (2, [("b", "v", [1]), ("a", "n", [2])])], f"sid int, nodes array<{node}>")
    ranks = spark.createDataFrame([("a", 3)], "surface string, rank int")
    keys = token_keys(F.col("nodes"), lambda n: F.struct(n["surface"].alias("surface")))
    found = sentence_difficulty(df, ranks, ["sid"], 9, keys, ["surface"])
    assert {tuple(r) for r in found.collect()} == {(1, 3), (2, 9)}
