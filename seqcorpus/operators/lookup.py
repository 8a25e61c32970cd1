"""Dictionary lookups.

Two forms. *In-row*: a dictionary with a proven bound (codepoints, tag kinds, sampling weights)
becomes one array that expressions index, so sentences are never exploded or shuffled. *Joins*: any
other dictionary; it is broadcast only after its bytes were summed against a bound. Beyond it, keys are
counted: those with more than a ``1 / HOT_SHARE`` of the rows (so at most ``HOT_SHARE`` keys) are looked up by
broadcast and never shuffled, and only the rest is joined by key.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import bind, distinct_structs
from ..sources.scratch import is_stored, materialise

NUL, UNK, BOS, EOS = 0, 1, 2, 3
FIRST_CHAR_ID, FIRST_TAG_ID = 4, 1
BROADCAST_BYTES = 64 << 20
HOT_SHARE = 1_000


def byte_size(df: DataFrame) -> int:
    """Bytes of a flat table: the text of its values and 16 for every value."""
    row = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(16 * len(df.columns)))
    return df.agg(F.coalesce(F.sum(row.cast("bigint")), F.lit(0))).first()[0]


def lookup_join(
    df: DataFrame,
    dictionary: DataFrame,
    on: Sequence[str],
    defaults: dict[str, object],
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """Left equi-join on ``on`` with a value for misses (``None`` keeps the NULL). Keys of ``dictionary`` are unique."""
    values = [c for c in dictionary.columns if c not in on]
    filled = [
        (F.col(v) if defaults.get(v) is None else F.coalesce(F.col(v), F.lit(defaults[v]))).alias(v)
        for v in values
    ]
    if byte_size(dictionary) <= broadcast_bytes:
        return df.join(F.broadcast(dictionary), list(on), "left").select(*df.columns, *filled)
    df = df if is_stored(df) else materialise(df, "looked-up")  # it is read three times below
    counts = materialise(df.groupBy(*on).agg(F.count("*").alias("__n")), "keys")
    rows = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    hot = counts.filter(F.col("__n") * hot_share > rows).select(*on)  # fewer than hot_share keys, null among them
    entries = materialise(F.broadcast(hot).join(dictionary, list(on), "left"), "hot")
    named = entries.select(*[F.col(k).alias(f"__hot_{k}") for k in on], *values)
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__hot_{k}")) for k in on])
    often = df.join(F.broadcast(named), same)
    seldom = df.join(F.broadcast(named.drop(*values)), same, "left_anti").join(dictionary, list(on), "left")
    return often.select(*df.columns, *filled).unionByName(seldom.select(*df.columns, *filled))


def char_join(df: DataFrame, chars: DataFrame, default: int = UNK) -> DataFrame:
    """E2 on one row per character: (ch) -> id."""
    return lookup_join(df, chars.select("ch", "id"), ["ch"], {"id": default})


def tag_join(df: DataFrame, tags: DataFrame) -> DataFrame:
    """E3 on one row per tag: (kind, tag) -> id, 0 if unknown."""
    return lookup_join(df, tags.select("kind", "tag", "id"), ["kind", "tag"], {"id": 0})


def label_join(df: DataFrame, labels: DataFrame, missing: str | None = "UNK") -> DataFrame:
    """(id) -> label."""
    return lookup_join(df, labels.select("id", "label"), ["id"], {"label": missing})


def gold_pred_join(gold: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gold and predicted rows aligned by sentence and position; rows of one side alone stay, with nulls."""
    return gold.join(pred, list(keys), "full_outer")


def number_table(values: Sequence[int | float], as_type: str = "int") -> Column:
    """A constant array; the optimizer folds it to one literal before any task starts."""
    if not values:
        return F.array().cast(f"array<{as_type}>")
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{as_type}>")


def text_table(values: Sequence[str]) -> Column:
    return F.split(F.lit("\x01".join(values)), "\x01") if values else F.array().cast("array<string>")


@dataclass(frozen=True)
class CharTable:
    """Ids by codepoint."""

    ids: Sequence[int]

    def id_of(self, ch: Column, default: int = UNK) -> Column:
        return F.coalesce(F.get(number_table(self.ids), F.ascii(ch)), F.lit(default))


def char_table(chars: DataFrame, default: int = UNK) -> CharTable:
    """The character dictionary ``(ch, id)`` as one constant table indexed by codepoint.

    The dictionary is fetched: a finished table of at most one small row per codepoint, which Unicode bounds.
    """
    known = {r[0]: r[1] for r in chars.select(F.ascii("ch"), F.col("id").cast("int")).collect()}
    return CharTable([known.get(c, default) for c in range(max(known, default=0) + 1)])


TAG_TABLE_BYTES = 1 << 20
PROBES = 8
_FREE = "\x02"


def tag_lists(tags: DataFrame) -> dict[str, list[str]]:
    """Tags of every kind in id order, of a dictionary whose size is checked first."""
    if byte_size(tags.select("kind", "tag", "id")) > TAG_TABLE_BYTES:
        raise ValueError("the tag dictionary is too large for a constant table; join its labels (label_join)")
    lists: dict[str, list[str]] = {}
    for kind, tag, _ in sorted(tags.select("kind", "tag", "id").collect(), key=lambda r: (r[0], r[2])):
        lists.setdefault(kind, []).append(tag)
    return lists


@dataclass(frozen=True)
class HashTable:
    """A constant table with open addressing: a key lies at its hash's slot or in one of the next ``probes - 1``."""

    keys: Column
    ids: Column
    slots: int
    probes: int

    def id_of(self, key: Column, default: int = 0) -> Column:
        """The key's id by one hash and at most ``probes`` comparisons."""

        def probe(slot: Column, keys: Column, ids: Column) -> Column:
            hits = [F.when(F.get(keys, slot + i) == key, F.get(ids, slot + i)) for i in range(self.probes)]
            return F.coalesce(*hits, F.lit(default))

        if not self.slots:
            return F.lit(default)
        slot = F.xxhash64(key).bitwiseAND(F.lit(self.slots - 1)).cast("int")
        if self.probes == 1:
            return bind(slot, lambda s: probe(s, self.keys, self.ids))
        # a lambda variable, so that the plan holds the table once
        return bind(self.keys, lambda keys: bind(self.ids, lambda ids: bind(slot, lambda s: probe(s, keys, ids))))


def hash_table(entries: Sequence[tuple[str, int, int]]) -> HashTable:
    """A table of (key, id, Spark's ``xxhash64`` of the key), doubled until no key is ``PROBES`` slots off (small ones: one)."""
    slots = 16
    while entries:
        most = 1 if slots <= 4096 else PROBES
        held: dict[int, tuple[str, int]] = {}
        far = 0
        for key, id_, hashed in entries:
            at = hashed & (slots - 1)
            step = next((i for i in range(PROBES + 1) if at + i not in held), PROBES + 1)
            held[at + step], far = (key, id_), max(far, step + 1)
        if far <= most and 2 * len(entries) <= slots:
            rows = [held.get(i, (_FREE, 0)) for i in range(slots + far)]
            return HashTable(text_table([k for k, _ in rows]), number_table([i for _, i in rows]), slots, far)
        slots *= 2
    return HashTable(text_table([]), number_table([]), 0, 0)


BLOOM_BITS = 22  # log2 of the filter's bits: half a megabyte, for about half a million keys
BLOOM_SHIFTS = (0, 21, 42)


def bloom_filter(df: DataFrame, key: Column) -> Column:
    """The keys of ``df`` as a constant Bloom filter of a fixed size, whatever their number: an array of 64-bit words."""
    places = F.array(*[F.shiftrightunsigned(F.col("__h"), s).bitwiseAND(F.lit((1 << BLOOM_BITS) - 1)) for s in BLOOM_SHIFTS])
    set_bits = df.select(F.xxhash64(key).alias("__h")).select(F.explode(places).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    words = set_bits.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    table = [0] * (1 << BLOOM_BITS - 6)  # as many words at most were collected
    for word, bits in words:
        table[word] = bits
    return number_table(table, "bigint")


def might_hold(table: Column, key: Column) -> Column:
    """Whether a key may be in a :func:`bloom_filter`; false is certain."""

    def probe(h: Column) -> Column:
        hit = F.lit(True)
        for s in BLOOM_SHIFTS:
            at = F.shiftrightunsigned(h, s).bitwiseAND(F.lit((1 << BLOOM_BITS) - 1))
            word = F.get(table, F.shiftright(at, 6).cast("int"))
            shifted = F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int"))
            hit = hit & (shifted.bitwiseAND(F.lit(1)) == 1)
        return hit

    return bind(F.xxhash64(key), probe)


@dataclass(frozen=True)
class TagTable:
    """What gives the id of a tag of one kind: a column function, and all ids by tag where they are a constant."""

    find: Callable[[Column], Column]
    known: dict[str, int] | None = None

    def __call__(self, tag: Column) -> Column:
        return self.find(tag)


TagIds = dict[str, TagTable]


def tag_ids(df: DataFrame, tags: DataFrame, kinds: Sequence[str], sid: Sequence[str], nodes: str = "nodes",
            table_bytes: int = TAG_TABLE_BYTES) -> tuple[DataFrame, TagIds]:
    """E3 in-row: ``df`` and, by kind, what gives the id of a tag (0 if unknown).

    A dictionary of at most ``table_bytes`` becomes a constant hash table. Beyond it, the distinct tags of each
    sentence are joined to the dictionary and come back with the sentence as a short array."""
    known = tags.filter(F.col("kind").isin(*kinds)).select("kind", "tag", "id")
    if byte_size(known) <= table_bytes:
        rows = known.select("kind", "tag", "id", F.xxhash64("tag")).collect()  # as many as the checked bytes allow
        tables = {k: [(r[1], r[2], r[3]) for r in rows if r[0] == k] for k in kinds}
        return df, {k: TagTable(hash_table(t).id_of, {tag: id_ for tag, id_, _ in t}) for k, t in tables.items()}
    df = materialise(df, "tagged-sentences")
    pairs = distinct_structs(F.flatten(F.transform(nodes, lambda n: F.array(
        *[F.struct(F.lit(k).alias("kind"), n[k].alias("tag")) for k in kinds]))))
    used = materialise(df.select(*sid, F.inline(pairs)), "used-tags")
    entries = F.struct("kind", "tag", F.col("id").cast("int").alias("id"))
    found = tag_join(used, known).groupBy(*sid).agg(F.collect_list(entries).alias("__tags"))  # of one sentence

    def within(kind: str) -> Callable[[Column], Column]:
        def id_of(tag: Column) -> Column:
            hits = F.filter("__tags", lambda e: (e["kind"] == kind) & (e["tag"] == tag))
            return F.coalesce(F.get(hits, F.lit(0))["id"], F.lit(0))

        return id_of

    return df.join(found, list(sid), "left"), {k: TagTable(within(k)) for k in kinds}
