"""Characters by Arrow batch against expressions and plain Python, and what their plans hold."""

import hashlib
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqcorpus.functions import hashing
from seqcorpus.operators import cells, decode, encode, lookup, masking
from seqcorpus.sources import records

KINDS = encode.TAG_KINDS
LABELS = {k: ["NUL", "x", "ü\U0001F600"] for k in KINDS}
SEG = ["NUL", "B", "I", "E"]
TEXTS = ["abc", "", "Äb\U0001F600あ" * 40, None, "q", "a\tb", "# x"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(autouse=True, params=[1 << 18, 3])
def slice_cells(request, monkeypatch):
    """Sentences share a slice or have one each."""
    monkeypatch.setattr(cells, "SLICE_CELLS", request.param)


def flat_rows(draw):
    """(id, comment, text, tags, probs), with lists that are null, too short or hold odd values."""
    out = []
    for i in range(120):
        text = TEXTS[i % len(TEXTS)]
        n = (len(text or "") + 2) * 5
        tags = [draw.choice([0, 1, 1, 2, 3, 9]) for _ in range(n)]
        probs = [draw.choice([0.0, 0.0625, 0.0005, 0.9995, 1.0, draw.random(), 12.34565]) for _ in range(n)]
        odd = i % 11
        if odd == 1:
            tags = tags[: n // 2]
        elif odd == 2:
            probs = probs[:3]
        elif odd == 3:
            tags[7 % n] = None
        elif odd == 4:
            probs[6 % n] = draw.choice([None, -1.0, float("nan"), float("inf"), 1e300, -0.0])
        elif odd == 5:
            tags = draw.choice([None, []])
        elif odd == 6:
            tags[5] = -4
        out.append((i, ["", "# c", None][i % 3], text, tags, probs))
    return out


SCHEMA = "id int, comment string, text string, tags array<bigint>, probs array<double>"


def plain_tokens(text, tags):
    """Tokens by the definition."""
    def at(place, k):
        i = (place + 1) * 5 + k
        return tags[i] if tags is not None and i < len(tags) else None

    if text is None:
        return None
    starts = [0] + [i for i in range(1, len(text)) if at(i, 0) == 1]
    out = []
    for s, e in zip(starts, [*starts[1:], len(text)]):
        shown = [at(s, k) for k in range(1, 5)]
        out.append((s, text[s:e], *[LABELS[k][t] if t is not None and 0 <= t < 3 else "UNK" for k, t in zip(KINDS, shown)]))
    return out


def test_decoded_tokens(spark):
    rows = flat_rows(random.Random(1))
    df = spark.createDataFrame(rows, SCHEMA).select("id", decode.decoded(F.col("text"), F.col("tags"), LABELS).alias("t"))
    found = {r["id"]: r["t"] for r in df.collect()}
    for i, _, text, tags, _ in rows:
        expected = plain_tokens(text, tags)
        assert (found[i] and [tuple(t) for t in found[i]]) == expected, (text, tags)
    assert "lambdafunction" not in plan_of(df)  # nothing is interpreted for a character


def test_debug_lines_as_the_expression(spark):
    df = spark.createDataFrame(flat_rows(random.Random(2)), SCHEMA)
    columns = [F.col(c) for c in ("comment", "text", "tags", "probs")]
    tables = [lookup.text_table(t) for t in (SEG, *LABELS.values())]
    both = df.select("id", decode.debug_lines(*columns, SEG, LABELS).alias("a"), decode._debug_lines(*columns, tables).alias("b"))
    assert both.filter(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()
    made = cells.by_batch(lambda *p: cells.debug_texts(*p, [SEG, *LABELS.values()]), "string", *columns)
    assert 40 < df.select(made.alias("a")).filter("a is not null").count() < 110  # plain ones never reach the expression


@pytest.mark.parametrize("fmt", ["juman", "mrph"])
def test_token_lines_as_the_expression(spark, fmt):
    token = "start int, surface string, pos string, subpos string, ctype string, cform string"
    token = ", ".join(f.replace(" ", ": ", 1) for f in token.split(", "))
    full, hole = (0, "a b", "p", "s", "t", "f"), (0, "a", "p", None, "t", "f")
    lists = [[full], [], None, [full, full], [full, hole], [hole, full], [None, full]]
    rows = [(c, t) for c in ("# c", "", None) for t in lists]
    df = spark.createDataFrame(rows, f"comment string, tokens array<struct<{token}>>")
    a, b = (f(F.col("comment"), F.col("tokens"), fmt) for f in (decode.token_lines, decode._token_lines))
    assert df.select(a.alias("a"), b.alias("b")).filter(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()


def test_debug_tables_as_the_expression(spark, monkeypatch):
    line = "a\tB\tx\t50.0\t33.3"
    raws = [
        f"# c\n{line}\nb\tI\ty\t100.0\t0.0\nEOS", "EOS", "", None, "# only\nEOS", f"{line}\n{line}", f"# a\n{line}\n# b\n{line}\nEOS\n",
        "a\tB\t50.0\nEOS", "a\tB\t\t50.0\nEOS", f"{line}\nEOS\n{line}", "a\tB\tx\t5e1\t33.3", "a\tB\tx\t50.0\t 33.3", "a\nEOS", "a\tB\nEOS",
        "あ\tü\t1.25\n#\tB\t.5\nEOS", "\tB\tx\t50.0\t33.3", f"{line}\r\nEOS",
    ]
    df = spark.createDataFrame(list(enumerate(raws * 3)), "id int, raw string")
    found = records.parse_debug_table(df).orderBy("id").collect()
    monkeypatch.setattr(records, "by_batch", lambda function, returns, *c: F.lit(None).cast(returns))
    assert found == records.parse_debug_table(df).orderBy("id").collect() and len(found) > 30


def reference_hash(values, narrow, seed=0xDEADBEEF):
    m = 0xFFFFFFFF
    rot = lambda x, n: ((x << n) | (x >> (32 - n))) & m
    item = lambda w: rot(w * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h = seed
    for v in values:
        v &= (1 << 64) - 1
        for w in (0 if narrow else v >> 32, v & m):
            h = (rot(h ^ item(w), 13) * 5 + 0xE6546B64) & m
    return struct.unpack("<i", struct.pack("<I", h ^ item(len(values))))[0]


@pytest.mark.parametrize("narrow", [True, False])
def test_hashes_of_many_lengths(spark, narrow):
    draw = random.Random(3)
    rows = [[draw.randint(0, 2**32 - 1) if narrow else draw.randint(-2**63, 2**63 - 1) for _ in range(n)] for n in [0, 1, 2, 40, 7, 3000] * 9]
    df = spark.createDataFrame([(i, r) for i, r in enumerate([*rows, None, [1, None]])], "id int, a array<bigint>").coalesce(1)
    found = {r["id"]: r["h"] for r in df.select("id", hashing.seq_hash(F.col("a"), narrow).alias("h")).collect()}
    assert [found[i] for i in range(len(rows))] == [reference_hash(r, narrow) for r in rows]
    assert found[len(rows)] is None and found[len(rows) + 1] is None


def test_codes_of_texts_and_paths(spark):
    table = lookup.char_table(spark.createDataFrame([("a", 4), ("Ä", 5)], "ch string, id int"))
    paths = [None if t is None else [{"surface": s} for s in (t, "a", "")] for t in TEXTS]
    df = spark.createDataFrame([*zip(range(99), TEXTS, paths), (99, "a", [{"surface": None}])],
                               "id int, text string, path array<struct<surface: string>>")
    ids = {"a": 4, "Ä": 5}
    rows = df.select("id", "text", encode.encode_chars(F.col("text"), table, False, 7).alias("t"),
                     encode.encode_path(F.col("path"), table, ["id"]).alias("p"))
    for r in rows.collect():
        text = r["text"]
        # the table itself has 1 for what it does not know; the default is for what lies behind its end
        assert r["t"] == (None if text is None else [ids.get(c, 7 if c > "Ä" else 1) for c in text])
        assert r["p"] == (None if text is None or r["id"] == 99 else [2, *[ids.get(c, 1) for c in text], 4, 3])
    assert "lambdafunction" not in plan_of(rows)


def test_digests(monkeypatch):
    texts = ["", "a", "ü" * 20, "x" * 55, "x" * 56, "y" * 200, *[f"1:{i}:{i * i}:char" for i in range(500)]]
    for most in (1 << 14, 7):
        monkeypatch.setattr(cells, "_MD5_TEXTS", most)
        first, second = cells.md5_words(pa.array(["skipped", *texts]).slice(1))
        assert [f"{a:08x}{b:08x}" for a, b in zip(first, second)] == [hashlib.md5(t.encode()).hexdigest()[:16] for t in texts]


def test_mask_plan(spark):
    draw = random.Random(4)
    rows = []
    for i in range(80):
        edges = sorted(draw.choices(range(60), k=i % 9 + 1))
        rows.append((None if i == 5 else i, f"k{i}" * (30 if i % 7 == 0 else 1), [{"start": a, "end": b} for a, b in zip(edges, edges[1:])]))
    df = spark.createDataFrame([*rows, (99, "none", None)], "a int, b string, path array<struct<start: int, end: int>>")
    plans = df.select("b", masking.mask_plan(F.col("path"), ["a", "b"], 3).alias("plan"))

    def digest(a, b, place, salt):
        bits = hashlib.md5(":".join(["3", *[str(k) for k in (a, b) if k is not None], str(place), salt]).encode()).hexdigest()
        return int(bits[:8], 16) / 2**32, int(bits[8:16], 16) / 2**32

    def op(u):
        return 1 if u < 0.1 else 2 if u < 0.2 else 3

    expected = {"none": None}
    for a, b, path in rows:
        plan = []
        for n in path:
            u, v = digest(a, b, n["start"], "token")
            chars = [digest(a, b, p, "char") for p in range(n["start"], n["end"])]
            plan += [op(v)] * len(chars) if u < masking.TOKEN_PROB else [op(y) if x < masking.CHAR_PROB else 0 for x, y in chars]
        expected[b] = [0, *plan, 0]
    assert {r["b"]: r["plan"] for r in plans.collect()} == expected
    assert "lambdafunction" not in plan_of(plans)


def test_heads_of_records_are_checked_one_by_one(monkeypatch):
    from seqcorpus.sources import crc32c, tfrecord
    import numpy as np

    draw = random.Random(5)
    for data in [b"", b"123456789", *[draw.randbytes(n) for n in (1, 3, 4, 8, 300)]]:
        of = np.frombuffer(data, np.uint8)
        assert crc32c.masked_crc32c_of(data) == int(crc32c.masked_crc32c(of, np.array([0]), np.array([len(data)]))[0])
    messages = [draw.randbytes(n) for n in (0, 5, 2000) * 30]
    whole = tfrecord.frame(messages)
    calls = []
    monkeypatch.setattr(tfrecord, "masked_crc32c", lambda *a, own=tfrecord.masked_crc32c: calls.append(1) or own(*a))
    assert [m for g in tfrecord.unframe(iter([whole]), True, "x") for m in g] == messages
    assert len(calls) == 1  # by vector for a group's messages, not for a record
    for at, what in ((2, "length"), (9, "length"), (len(whole) - 1, "a record"), (len(whole) - 30, "a record")):
        bad = bytearray(whole)
        bad[at] ^= 1
        with pytest.raises(OSError, match=what):
            list(tfrecord.unframe(iter([bytes(bad)]), True, "x"))


def test_records_are_checked_once(spark, tmp_path):
    texts = ["", "EOS", "EOS\nEOS\n# c\nx", "x", "x\nEOS", "x\n", "EOS\n", "# VIDEOS", "xEOS", "\n", "EOS\nEOS", "あ\ny"]
    found = spark.createDataFrame([(t,) for t in texts], "v string").select("v", records.marked_records(F.col("v")).alias("r"))
    assert {r["v"]: r["r"] for r in found.collect()} == {
        "": ["EOS"], "EOS": ["EOS"], "EOS\nEOS\n# c\nx": ["EOS", "EOS", "# c\nx\nEOS"], "x": ["x\nEOS"], "x\nEOS": ["x\nEOS"], "x\n": ["x\nEOS"],
        "EOS\n": ["EOS"], "# VIDEOS": ["# VIDEOS\nEOS"], "xEOS": ["xEOS\nEOS"], "\n": ["EOS"], "EOS\nEOS": ["EOS", "EOS"], "あ\ny": ["あ\ny\nEOS"]}
    (tmp_path / "a.txt").write_text("x\nEOS\ny\nEOS\n")
    rows = records.read_records(spark, str(tmp_path))
    assert sorted(r["raw"] for r in rows.collect()) == ["x\nEOS", "y\nEOS"]
    assert plan_of(rows).count("validateUTF8String") == 1


@pytest.mark.parametrize("table_bytes", [1 << 20, 0])  # constant table, then the join
def test_rows_of_characters(spark, table_bytes):
    nodes = [(0, 3, "x", "y", None, "z"), (3, 4, "y", "x", "x", "x"), (4, 4, "x", "x", "x", "x"), (2, 5, "q", "x", "x", "x")]
    df = spark.createDataFrame([(1, nodes), (2, []), (3, None)], "sid int, nodes array<struct<start: int, end: int, " + ", ".join(f"{k}: string" for k in KINDS) + ">>")
    tags = spark.createDataFrame([(k, t, i) for k in KINDS for i, t in enumerate("xy", 1)], "kind string, tag string, id int")
    df, tables = lookup.tag_ids(df, tags, KINDS, ["sid"], table_bytes=table_bytes)
    rows = df.select("sid", F.inline(encode.char_tag_rows(F.col("nodes"), tables)))
    assert rows.columns == ["sid", "at", "seg", *KINDS]
    assert sorted(tuple(r) for r in rows.collect()) == sorted([
        (1, 0, 1, 1, 2, 0, 0), (1, 1, 2, 1, 2, 0, 0), (1, 2, 3, 1, 2, 0, 0), (1, 3, 1, 2, 1, 1, 1),
        (1, 2, 1, 0, 1, 1, 1), (1, 3, 2, 0, 1, 1, 1), (1, 4, 3, 0, 1, 1, 1)])
    assert "namedlambdavariable" not in plan_of(rows).lower() and ("lambdafunction" not in plan_of(rows) or not table_bytes)
