"""Shape of the plans, and the queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import check_queries
from seqcorpus import fixtures as fx
from seqcorpus.operators import lattice, sampling
from seqcorpus.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver tables")

SAMPLE = [
    "feature_counts", "encoded_sentences", "seq_hash", "freq_ranks", "zigzag_layout", "length_batches", "mixed_sources",
    "seg_token_prf", "moving_rate", "lexeme_ids", "numbered_lines", "pipe_lines", "sequence_roundtrip", "tag_loss",
]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in check_queries.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, db, name):
    ours = QUERIES[name](spark, FOLDER).toPandas()
    theirs = db.sql(ORACLES[name]).df()
    assert check_queries.canonical(ours) == check_queries.canonical(theirs)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_parse_is_native_and_runs_once(spark):
    plan = plan_of(lattice.best_path(fx.sentences(spark, FOLDER)))
    assert "Python" not in plan and plan.count("Scan parquet") == 1
    assert plan.count("Exchange") <= 1  # only the spread of a small scan


def test_scan_reads_two_columns(spark):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in fx.lines(spark, FOLDER)._jdf.queryExecution().executedPlan().treeString()


def test_sample_joins_by_broadcast(spark):
    hist = spark.createDataFrame([(0, 5), (1, 5), (2, 5)], "rank int, cnt bigint")
    rows = spark.range(10).select("id", (F.col("id") % 3).cast("int").alias("rank"), F.col("id").cast("int").alias("hash"))
    plan = plan_of(sampling.hash_sample(rows, sampling.sampling_plan(hist, 2, 0.5, 0.5)))
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
