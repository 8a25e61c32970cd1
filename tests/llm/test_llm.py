"""Each operator against a brute-force version, and its edge cases: nulls, empty and very long texts, repeated rows,
empty tables, extra columns with clashing names."""

import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqcorpus.llm import (
    byte_bpe, exact_search, extraction, graphs, near_copies, near_search, packing, personal, quality, sharding, token_files, tokens,
)
from seqcorpus.llm.common import scratch_path
from seqcorpus.llm.queries import QUERIES
from seqcorpus.llm.tokens import encoder, vocabulary_path

DOCS = "doc_id long, text string, size int, score string, shard string"
WORDS = "a the of and to in that it is was for on are with as his they at be this from have or by one had not but".split()


def some_texts(n=60, seed=3):
    draw = random.Random(seed)
    texts = [" ".join(draw.choices(WORDS, k=draw.randint(0, 80))) for _ in range(n)]
    texts += [None, "", " ", "\n\t ", "x", "word " * 5000, "é文😀 don't 'll  two  \n\n end ", "a" * 20_000]
    return texts + texts[:6] + [t + " more" for t in texts[:6] if t]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "s", "t") for i, t in enumerate(some_texts())] + [(None, "no id", 2, None, None), (3, some_texts()[3], 1, "s", "t")]
    return spark.createDataFrame(rows, DOCS).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def reference_ids(text):
    found = encoder(vocabulary_path()).tokenizer.encode(text or "", add_special_tokens=False)
    return [*found.ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_keep_the_ids(monkeypatch):
    draw = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "b", "é", "1", ".", "'s", "'", "　", "x y", "<|endoftext|>", "文"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(3000)]
    encode = encoder(vocabulary_path())
    for kept in (1_000_000, 50):  # all pieces kept, then forgotten with each batch
        monkeypatch.setattr(tokens, "KEPT_PIECES", kept)
        for at in range(0, len(texts), 100):
            for text, ids in zip(texts[at:at + 100], encode.encode(texts[at:at + 100])):
                assert [*ids.tolist(), 2] == reference_ids(text), text


def test_added_tokens_have_their_own_ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    draw = random.Random(9)
    parts = [" ", "\n", "a", "b c", " d", "<|endoftext|>", " <|endoftext|>", "<|endof", "text|>"]
    texts = ["a<|endoftext|>b"] + ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(500)]
    for text, ids in zip(texts, encoder(vocabulary_path()).encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert 50256 in encoder(vocabulary_path()).encode(texts[:1])[0]


def test_token_files(spark, docs, none):
    parts = token_files.write_tokens(docs, scratch_path(spark, "tokens"), vocabulary_path(), length=16)
    found = sorted(map(tuple, token_files.read_tokens(parts).collect()), key=lambda r: r[1])
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, expected = 0, []
    for doc_id, text in rows:
        ids = reference_ids(text)
        expected.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert found == expected
    part = token_files.PartReader(parts.orderBy("first_id").first()["path"])
    ids, mask = part.sequence(0)
    assert len(ids) == len(mask) == 16 and part.tokens(0, 16).tolist() == ids.tolist()
    empty = token_files.write_tokens(none, scratch_path(spark, "tokens"), vocabulary_path())
    assert token_files.read_tokens(empty).count() == 0


def test_packing(docs, none):
    found = packing.pack(packing.token_pieces(docs, vocabulary_path(), 64), 64, 8).collect()
    bins, by_doc = {}, {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
    for r in docs.filter("doc_id <> 3 and doc_id is not null").collect():
        ids = reference_ids(r["text"])
        own = sorted(by_doc[r["doc_id"]], key=lambda x: x["piece"])
        assert [x["piece"] for x in own] == list(range(len(own)))
        assert all(x["length"] == 64 for x in own[1:]) and sum(x["length"] for x in own) == len(ids)
        assert all(x["ids_crc32"] == crc(ids[x["start"]:x["start"] + x["length"]]) for x in own)
    least = -(-sum(r["length"] for r in found) // 64)
    assert len(bins) <= 1.05 * least + 4
    assert packing.pack(packing.token_pieces(none, vocabulary_path())).count() == 0


def test_bounded_packer_closes_the_fullest():
    packer = packing.Packer(10, 2)
    assert [packer.place(n) for n in (6, 7, 8, 4, 10)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]


def test_sharding(docs, none):
    found = sharding.shard_by_bytes(docs, 5).collect()
    assert len(found) == docs.count()
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    expected = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in found) == expected
    assert sharding.shard_by_bytes(none).count() == 0


def test_shards_are_near_equal(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    sizes = [r["n"] for r in sharding.shard_by_bytes(rows, 8).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.01 * min(sizes)


def test_equal_texts_share_a_shard(spark, tmp_path):
    rows, draw = [], random.Random(12)
    for g in range(900):  # groups of all sizes, some of them large, none that a shard could not hold
        n = draw.choice([1, 1, 1, 2, 3, 20, 100 if g % 50 == 0 else 5, 700 if g % 300 == 0 else 2])
        rows += [(len(rows) + i, f"text {g} " * draw.choice([1, 10])) for i in range(n)]
    hot = [(100_000 + i, "one text of a third of all bytes") for i in range(sum(len(t) + 8 for _, t in rows) // 80)]
    df = spark.createDataFrame(rows + hot, "doc_id long, text string").repartition(3)
    shards = 12
    found = sharding.shard_by_bytes(df, shards).join(df, "doc_id").collect()
    assert len(found) == len(rows) + len(hot)
    sizes, at, slots, size_of = [0] * shards, {}, {}, {}
    for r in found:
        sizes[r["shard"]] += r["size"]
        at.setdefault(r["text"], set()).add(r["shard"])
        size_of[r["text"]] = size_of.get(r["text"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(sizes) < 1.02 * min(sizes) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    fits = sum(sizes) / shards
    assert all(len(at[t]) == 1 for t, n in size_of.items() if n <= fits) and any(n > fits for n in size_of.values())


def test_sharding_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(some_texts())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op7_sharding"](spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in found) == [i for i, _ in rows]
    assert all(r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24 for r in found)
    shard = {}
    for r in found:
        shard.setdefault(rows[r["doc_id"]][1] or "", set()).add(r["shard"])
    assert all(len(s) == 1 for t, s in shard.items() if len(t) < 1000)


def test_byte_bpe(docs, none):
    import base64

    import public_tokenizers
    import tiktoken

    path = vocabulary_path(byte_bpe.RANKS)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.codec(path)
    draw = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "é", "1", ".", "'s", "'", "'re", "'ll", "'d", " '", "　", "\x00", "\x1c", "\x85", "😀", "s", "''"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(3000)] + [t or "" for t in some_texts()]
    for text, ids in zip(texts, bpe.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text), text
        assert bpe.decode(ids) == text.encode() and (not len(ids) or bpe.ends(ids)[-1] == len(text.encode()))
    assert byte_bpe.round_trip(docs, path).count() == docs.count() and byte_bpe.encoded(none, path).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def test_personal_spans(docs, none):
    draw = random.Random(4)
    parts = ["a", "b@", "@", ".", "1", "12", "255", "256", "1.2.3.4", "+1", "-", " ", "(", ")", "_", "4111111111111111", "a@b.c", "%", "é", "\n"]
    for _ in range(20_000):
        text = "".join(draw.choices(parts, k=draw.randint(0, 16)))
        expected = sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if holds(k, m[0]))
        assert personal.base_spans(text) == expected, text
    assert personal.spans("iban DE89 3704 0044 0532 0130 00")[0][:3] == ("iban", 5, 32)
    assert personal.spans("ssn 123-45-6789") and not personal.spans("no 123-45-6789")
    assert personal.redacted("mail a@b.co now") == "mail [EMAIL] now"
    for long in ("a" * 10**6, "1" * 10**6, "1." * 10**5, "+" * 10**5, "a@" * 10**5):
        personal.spans(long)
    assert personal.find_personal(docs).count() == docs.count() and personal.redact(docs).columns == docs.columns
    assert personal.find_personal(none).count() == 0


IBANS = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "BE68 5390 0754 7034", "NO9386011117947"]


def test_account_numbers_before_any_word():
    for number in IBANS:
        for after in ("", " Please pay", " BIC COBADEFFXXX", " I paid", " 12", ", AB12 CDEF", "@", " " + IBANS[0]):
            text = f"to {number}{after}"
            assert ("iban", 3, 3 + len(number)) in [s[:3] for s in personal.spans(text)], text
            assert number not in personal.redacted(text)
        assert not [s for s in personal.spans(f"{number}x {number}7 {number[:-1]}") if s[0] == "iban"]
    # digits that pass Luhn: the card stays, the longer account number with it
    digits = next(d for i in range(10**6) for d in [f"{i:012d}"] for full in [f"{98 - int(d + '111400') % 97:02d}{d}"] if personal.luhn(full) and len(full) == 14)
    full = f"BE{98 - int(digits + '111400') % 97:02d}{digits}"
    assert {s[0] for s in personal.spans(full)} == {"card", "iban"} and personal.redacted(full + " Thanks") == "[IBAN] Thanks"
    personal.spans("DE89 " * 10**5 + "DE89A" * 10**5)


PAGE = """<html><head><title>no</title></head><body class="has-sidebar"><header>Site</header><nav><ul><li><a href=x>menu</a></ul></nav>
<article><h1>T</h1><p>One &amp; two<b>x</b>y<p>Three<br>four <a href=q>link</a></p><div class="comments"><p>reader says {0}</p></div></article>
<aside>side</aside><form><p>formtext</p></form><div class="cookie-notice">we use</div><script>var t="</p>";</script><footer>f</footer></body>"""


def test_extraction(spark):
    assert extraction.main_text(PAGE.format("z " * 90)) == "T One & twoxy Three four link"
    assert [extraction.main_text(x) for x in (None, "", "plain", "<p>a<p>b", "a < b", "<!--x", "<script>x")] == ["", "", "plain", "a b", "a < b", "", ""]
    for odd in ("<b>" * 50_000, '<p class="' * 5000, "</p>" * 50_000, "<div>" * 50_000 + "x", "<!--" * 10_000):
        extraction.main_text(odd)
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 6), (2, None, None, 6)], "page_id long, url string, html string, n_chars int")
    found = [(r["page_id"], r["n_chars"]) for r in extraction.extract(pages).collect()]
    assert sorted(found) == [(1, 29), (2, 0), (2, 0)] and extraction.extract(pages.limit(0)).count() == 0


PARAGRAPHS = [f"<p>{'word%d ' % i * 50}</p>" for i in range(7)]


@pytest.mark.parametrize("parts", [
    ["<div id=content><section><h2>one</h2>", *PARAGRAPHS[:3], "</section><p>bridge</p>loose<section>", *PARAGRAPHS[3:], "</section></div>"],
    ["<h1>headline</h1><div class=body>", *PARAGRAPHS[:4], "</div>"],
    ["<form id=aspnet><main><h1>headline</h1>", *PARAGRAPHS[:2], "</main></form>"],
    ["<div class=widget><h1>headline</h1>", *PARAGRAPHS[:4], "</div>"],
])
def test_extraction_keeps_all_parts(parts):
    wanted = " ".join(re.sub("<[^>]*>", " ", " ".join(parts)).split())
    page = f"<html><body><nav><a href=x>menu</a></nav>{''.join(parts)}<div><h3>More</h3><a href=y>Another story</a></div></body></html>"
    assert extraction.main_text(page) == wanted


def test_extraction_is_linear_in_depth():
    for odd in ("<b>x" * 50_000, "<div>x" * 50_000, "<form>" * 50_000 + "x", "<article>" * 50_000 + "x", "<p>x<b>y" * 50_000):
        extraction.main_text(f"<body>{odd}")


def vectors(spark, n=700, seed=5):
    random_ = np.random.default_rng(seed)
    x = random_.normal(0, 0.125, (n, 16)).astype("float32")
    x[100:300] = x[100]  # a hot vector
    rows = [(i, v.tolist(), 0, 1.0) for i, v in enumerate(x)]
    bad = [(n, None, 0, 1.0), (n + 1, [None] * 16, 0, 1.0), (n + 2, [float("nan")] * 16, 0, 1.0), (n + 3, [float("inf")] * 16, 0, 1.0), (n + 4, [1.0], 0, 1.0)]
    return x.astype(float), spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int, score double")


def nearest(scores, own, k):
    ids = np.arange(scores.shape[1])
    return [i for i in np.lexsort((ids, -scores[own])) if i != own][:k]


def test_exact_search(spark):
    x, table = vectors(spark)
    rows = exact_search.whole_numbers(exact_search.finite(table, "vec_id", "embedding"))
    found = exact_search.search(rows, F.col("vec_id") % 20 == 0, 20).collect()
    whole = np.floor(64 * x).astype(int)
    scores = whole @ whole.T
    expected = sorted((q, r + 1, i, int(scores[q, i])) for q in range(0, len(x), 20) for r, i in enumerate(nearest(scores, q, 20)))
    assert sorted(map(tuple, found)) == expected
    assert exact_search.search(rows.limit(0), F.lit(True), 3).count() == 0
    assert exact_search.search(rows.filter("vec_id < 4"), F.lit(True), 20).count() == 12


def test_near_search(spark):
    x, table = vectors(spark, 3000)
    rows = near_search.finite(table, "vec_id", "embedding")
    found = near_search.search(rows, F.col("vec_id") % 50 == 0, 5).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = unit @ unit.T
    hits = sum(r["score"] >= scores[r["query_id"], nearest(scores, r["query_id"], 5)[-1]] - 1e-9 for r in found)
    assert len(found) == 300 and hits >= 0.9 * 300
    assert near_search.search(rows.limit(0), F.lit(True), 3).count() == 0


def test_near_search_of_many_lists(spark, monkeypatch):
    monkeypatch.setattr(near_search, "LIST_ROWS", 4)  # 2,000 lists
    x = np.random.default_rng(8).normal(0, 1, (8000, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = near_search.materialise(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<double>"), "many")
    found = near_search.search(rows, F.col("vec_id") % 80 == 0, 5).collect()
    scores = unit[::80] @ unit.T
    hits = sum(
        r["score"] >= np.sort(np.delete(scores[r["query_id"] // 80], r["query_id"]))[-5] - 1e-9 for r in found)
    assert len(found) == 500 and hits >= 0.97 * 500


def brute_components(texts, width, percent):
    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_near_copies(spark, width, percent):
    draw = random.Random(width)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = draw.choices(vocabulary, k=30)
    texts = []
    for _ in range(50):
        words = draw.choices(vocabulary, k=draw.choice([2, 12, 60, 300])) + (passage if draw.random() < 0.4 else [])
        for _ in range(draw.choice([1, 1, 4])):
            for _ in range(draw.randint(0, 4)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            texts.append(" ".join(words).upper() if draw.random() < 0.2 else " \t".join(words))
    texts += [None, "", " \n", "one", "one", "ONE two"]
    df = spark.createDataFrame([(i, t, 7, 8) for i, t in enumerate(texts)], "doc_id long, text string, n_shingles int, root int").repartition(3)
    found = sorted(map(tuple, near_copies.near_copies(df, width, percent).collect()))
    assert found == [(i, *x) for i, x in enumerate(brute_components(texts, width, percent))]
    if percent == 80:
        assert near_copies.near_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("bound, most", [("TILE_ROWS", 8), ("TILE_SHINGLES", 800)])
def test_large_groups_are_compared_in_parts(spark, monkeypatch, bound, most):
    monkeypatch.setattr(near_copies, bound, most)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base[:i] + ["x"] + base[i + 1:]) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(map(tuple, near_copies.near_copies(df, 3, 90).collect()))
    assert found == [(i, *x) for i, x in enumerate(brute_components(texts, 3, 90))]


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "TILE_ROWS", 2)
    monkeypatch.setattr(near_copies, "BROADCAST_BYTES", 8192)
    sent, broadcast = [], F.broadcast

    def measured(df):
        sent.append(sum(64 + 56 * len(r["tiles"] if "tiles" in df.columns else ()) for r in df.collect()))
        return broadcast(df)

    monkeypatch.setattr(near_copies.F, "broadcast", measured)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base[:i] + ["x"] + base[i + 1:]) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(map(tuple, near_copies.near_copies(df, 3, 90).collect()))
    assert sent and max(sent) <= 8192
    assert found == [(i, *x) for i, x in enumerate(brute_components(texts, 3, 90))]


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 99), (99, 100), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in graphs.components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {99: 99, 100: 99}


def test_quality(spark, docs, none):
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        good = draw.random() < 0.7
        words = draw.choices(WORDS, k=draw.randint(5, 60))
        rows.append((i, " ".join(words).capitalize() + "." if good else " ".join(w + "###" for w in words), 1, "s", "t"))
        labels.append((i, int(good)))
    table = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(table, marks)
    found = {r["doc_id"]: r["score"] for r in quality.scored(table, model).collect()}
    held = [(found[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.3) == (y == 1) for s, y in held) >= 0.97 * len(held) and all(0 <= s <= 1 for s, _ in held)
    assert quality.scored(docs, model).count() == docs.count() and quality.scored(none, model).count() == 0
    assert {r["score"] for r in quality.scored(docs, quality.fit(table, marks.limit(0))).collect()} == {0.5}
    assert quality.accepted(docs, model).columns == docs.columns


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(some_texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    found = corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()
    kept = {i for i, (_, root) in enumerate(brute_components([r[1] for r in rows], 5, 80)) if i == root}
    assert {r["doc_id"] for r in found} == kept
