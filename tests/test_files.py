"""File sources, sinks and pipes."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqcorpus.sources import dicts, pipe, records, tfrecord
from seqcorpus.sources.crc32c import crc32c


def test_crc_known_value():
    data = np.frombuffer(b"123456789" + bytes(1000), dtype=np.uint8)
    got = crc32c(data, np.array([0, 9]), np.array([9, 32]))
    assert [hex(x) for x in got] == ["0xe3069283", "0x8a9136aa"]


def test_varints():
    values = np.array([0, 1, 127, 128, 300, -1, 1 << 40, -(1 << 62)])
    packed, ends = tfrecord.pack_ints(values)
    assert packed[ends[4]:ends[5]] == b"\xac\x02" and ends[6] - ends[5] == 10
    back, counts = tfrecord.unpack_ints([packed, b"", packed])
    assert back.tolist() == values.tolist() * 2 and counts.tolist() == [8, 0, 8]


@pytest.fixture
def rows(spark):
    return spark.range(700).select(
        "id", F.sequence(F.lit(-2).cast("bigint"), F.col("id") % 9).alias("ints"),
        F.array((F.col("id") / 3).cast("float")).alias("floats"),
        F.array(F.concat(F.lit("é"), F.col("id").cast("string")).cast("binary")).alias("bytes"),
        F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("maybe"))


@pytest.mark.parametrize("codec", ["gzip", "none"])
def test_example_roundtrip(spark, rows, tmp_path, codec):
    path = str(tmp_path / "x")
    tfrecord.write_tfrecords(rows.repartition(3), path, codec)
    names = [n for n in os.listdir(path) if n.startswith("part-")]
    assert len(names) == 3 and not [n for n in os.listdir(path) if n.startswith("_temporary")]
    back = tfrecord.read_tfrecords(spark, path, rows.schema)
    assert back.exceptAll(rows).count() == 0 and back.count() == 700


def test_open_schema_and_overwrite(spark, rows, tmp_path):
    path = str(tmp_path / "x")
    tfrecord.write_tfrecords(rows, path)
    tfrecord.write_tfrecords(rows.limit(5).coalesce(1), path, mode="overwrite")
    got = tfrecord.read_tfrecords(spark, path).select(F.col("features")["id"]["ints"][0].alias("i")).collect()
    assert sorted(r["i"] for r in got) == [0, 1, 2, 3, 4]


def test_damage_is_noticed(spark, rows, tmp_path):
    path = str(tmp_path / "x")
    tfrecord.write_tfrecords(rows.coalesce(1), path, "none")
    name = next(os.path.join(path, n) for n in os.listdir(path) if n.startswith("part-"))
    data = bytearray(open(name, "rb").read())
    data[-10] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(Exception, match="checksum"):
        tfrecord.read_tfrecords(spark, path, rows.schema).count()
    assert tfrecord.read_tfrecords(spark, path, "id bigint", check_crc=False).count() == 700
    open(name, "wb").write(data[:-3])
    with pytest.raises(Exception, match="ends inside"):
        tfrecord.read_tfrecords(spark, path, "id bigint", check_crc=False).count()


def test_column_contract(spark, tmp_path):
    with pytest.raises(Exception, match="nested too deeply"):
        df = spark.range(1).select(F.array(F.array("id")).alias("x"))
        tfrecord.write_tfrecords(df, str(tmp_path / "x"))


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [f"# c{i}" if i % 400 == 0 else f"line {i} " + "x" * (i % 50) for i in range(1, 4000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = records.numbered_lines(spark, str(tmp_path)).collect()
        assert len({r["block"] for r in got}) > 5
        assert [r["value"] for r in sorted(got, key=lambda r: r["line_no"])] == lines
        carried = records.read_annotated_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    current, want = "", {}
    for i, line in enumerate(lines):
        if line.startswith("#"):
            current = line
        else:
            want[i] = (current, line)
    assert {r["line_no"]: (r["comment"], r["raw"]) for r in carried} == want


def test_resolve_inputs(spark, tmp_path):
    listing = tmp_path / "list"
    listing.write_text("# no\n/data/a\n/x\n/data/b\n")
    assert records.resolve_inputs(spark, f"@{listing}") == ["/data/a", "/data/b"]
    assert records.resolve_inputs(spark, str(listing), always_list=True) == ["/data/a", "/data/b"]
    assert records.resolve_inputs(spark, "/a,/b") == ["/a", "/b"]


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "d").write_text("b?a\t7\nx\n3\tc\nq\t9\n")
    got = {r["position"]: (r["key"], r["cnt"]) for r in dicts.read_dict_tsv(spark, str(tmp_path / "d")).collect()}
    assert got == {0: ("a?b", 7), 1: ("c", 3), 2: ("q", 9)}
    with pytest.raises(Exception, match="unparseable"):
        dicts.read_dict_tsv(spark, str(tmp_path / "d"), fixed=True).collect()


def test_pipes(spark, tmp_path):
    df = spark.range(20_000).select(F.concat(F.lit("row "), F.col("id").cast("string")).alias("value"))
    assert pipe.pipe_lines(df, "cat").exceptAll(df).count() == 0
    with pytest.raises(Exception, match="ended with code"):
        pipe.pipe_lines(df, "false").count()
    os.mkdir(tmp_path / "in")
    for i in range(2):
        with gzip.open(tmp_path / "in" / f"f{i}.gz", "wb") as f:
            f.write(f"file {i}\n".encode() * 30_000)
    out = str(tmp_path / "out")
    pipe.write_bytes(pipe.pipe_files(spark, str(tmp_path / "in"), "tr a-z A-Z"), out, ".gz")
    names = [n for n in os.listdir(out) if n.startswith("part-")]
    assert len(names) == 2 and all(n.endswith(".gz") and not n.endswith(".gz.gz") for n in names)
    got = {r["value"]: r["count"] for r in spark.read.text(out).groupBy("value").count().collect()}
    assert got == {"FILE 0": 30_000, "FILE 1": 30_000}
