"""Block naming against grouping by the normalised text itself."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from seqcorpus.llm import block_names
from seqcorpus.llm.queries import QUERIES

DOCS = "doc_id long, text string, name string, level string, row int"


def rows_of(n=250):
    draw = random.Random(5)
    base = ["".join(draw.choices("ab \né", k=draw.choice([0, 1, 3, 7, 8, 9, 16, 17, 40, 200]))) for _ in range(60)]
    texts = [t[:2] + draw.choice(["", " ", "\t\x0b"]) + t[2:] for t in draw.choices(base, k=n)]
    texts += ["x" * 3000, "x" * 3001, "x" * 3000 + " ", " ", "y" * 4096]
    rows = list(enumerate(texts)) + [(None, None), (None, ""), (3, "ab"), (3, "ab"), (7, " a b"), (8, "ba")]
    return rows + [(1000 + i, "the hot text of a third of all") for i in range(n // 2)]


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub("[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for text, members in groups.items():
        members.sort()
        for i, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), i == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,hot", [(4, 1000), (7, 5), (1024, 20)])
def test_exact_copies(spark, tmp_path, monkeypatch, block, hot):
    monkeypatch.setattr(block_names, "HOT_SHARE", hot)
    rows = rows_of()
    spark.createDataFrame([(i, t, "n", "l", 1) for i, t in rows], DOCS).repartition(5).write.parquet(f"{tmp_path}/d")
    found = block_names.exact_copies(spark.read.parquet(f"{tmp_path}/d"), block=block)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert block_names.exact_copies(spark.createDataFrame([], DOCS)).count() == 0


def test_query(spark, tmp_path):
    rows = rows_of(80)
    spark.createDataFrame([(i, t, "n", "l", 1) for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op12_exact_copies"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_no_python_in_tasks(spark, monkeypatch):
    seen = []
    write = block_names.materialise

    def kept(df, label="table"):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(block_names, "materialise", kept)
    block_names.exact_copies(spark.createDataFrame([(1, "a" * 5000, "", "", 1)], DOCS)).collect()
    assert seen and not any("Python" in p or "InArrow" in p or "InPandas" in p for p in seen)
