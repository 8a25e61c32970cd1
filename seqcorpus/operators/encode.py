"""Sentences to training examples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import computed_once, span
from ..functions.text import codepoints, is_full_width, zen2han
from ..functions.hashing import seq_hash, uniform
from .lattice import KEY_UNKNOWN_WORD, PATH_FIELDS
from . import cells
from .lookup import BOS, EOS, UNK, CharTable, TagIds, char_table, tag_ids

# Segmentation tags and the order of the tag kinds in an example.
SEG_IDS = {"B": 1, "I": 2, "E": 3}
TAG_KINDS = ["pos", "subpos", "ctype", "cform"]
NUM_TAGS = 1 + len(TAG_KINDS)
SPECIAL_POS = 1
#: fields of a node that tags are made from, and that examples are made from
TAGGED_FIELDS = (*PATH_FIELDS, *TAG_KINDS)
EXAMPLE_FIELDS = (*TAGGED_FIELDS, "pos_num", "features")


@dataclass(frozen=True)
class Augment:
    """Random changes of the input characters; draws are keyed by sentence and node start."""

    unk_prob: float = 0.0
    zen2han_prob: float = 0.0
    seed: int = 1


def in_range(length: Column, low: int | Column, high: int | Column) -> Column:
    """Whether a length lies between two limits, both included; a null length does not."""
    return F.coalesce(length.between(low, high), F.lit(False))


def node_length(node: Column) -> Column:
    return node["end"] - node["start"]


def path_length(path: Column) -> Column:
    return F.aggregate(path, F.lit(0), lambda a, n: a + node_length(n))


def seg_tag(pos: Column, start: Column, end: Column) -> Column:
    """B at the start (also of a one-character node), E at the last character, else I."""
    return (
        F.when(pos == start, SEG_IDS["B"]).when(pos == end - 1, SEG_IDS["E"]).otherwise(SEG_IDS["I"])
    )


def unk_flags(nodes: Column) -> Column:
    """0/1 per (visited node, character), 0 at both ends."""
    flags = F.transform(
        nodes,
        lambda n: F.array_repeat(
            F.exists(n["features"], lambda f: f["key"] == KEY_UNKNOWN_WORD).cast("bigint"), node_length(n)
        ),
    )
    edge = F.array(F.lit(0).cast("bigint"))
    return F.concat(edge, F.flatten(flags), edge)


def random_zen2han(surface: Column, prob: float, draw: Column) -> Column:
    """A full-width token becomes half-width with probability ``prob``."""
    return F.when((draw < prob) & is_full_width(surface), zen2han(surface)).otherwise(surface)


def is_random_unk(node: Column, prob: float, draw: Column) -> Column:
    """A one-character token of the special part of speech is hidden with probability ``prob``."""
    return (node_length(node) == 1) & (node["pos_num"] == SPECIAL_POS) & (draw < prob)


def encode_chars(text: Column, table: CharTable, bos_eos: bool = True, default: int = UNK) -> Column:
    """Codepoint ids of a string, optionally between BOS and EOS; by Arrow batch."""
    ids, ends = np.array(table.ids, np.int64), (BOS, EOS) if bos_eos else None
    return cells.by_batch(lambda texts: cells.text_codes(texts, ids, default, ends), "array<bigint>", text)


def encode_path(path: Column, table: CharTable, sid: Sequence[str], augment: Augment = Augment()) -> Column:
    """C7 over the surfaces of a best path, by Arrow batch; with C5 and C6 when their probabilities are not 0."""
    if not augment.zen2han_prob > 0 and not augment.unk_prob > 0:
        known = np.array(table.ids, np.int64)
        return cells.by_batch(lambda s: cells.path_codes(s, known, UNK, (BOS, EOS)), "array<bigint>", path["surface"])
    keys = [F.col(c) for c in sid]

    def ids(n: Column) -> Column:
        surface = n["surface"]
        if augment.zen2han_prob > 0:
            draw = uniform(augment.seed, [*keys, n["start"]], "width")
            surface = random_zen2han(surface, augment.zen2han_prob, draw)
        codes = F.transform(codepoints(surface), lambda c: table.id_of(c).cast("bigint"))
        if augment.unk_prob > 0:
            draw = uniform(augment.seed, [*keys, n["start"]], "unk")
            hidden = F.array(F.lit(UNK).cast("bigint"))
            codes = F.when(is_random_unk(n, augment.unk_prob, draw), hidden).otherwise(codes)
        return codes

    bos, eos = (F.array(F.lit(x).cast("bigint")) for x in (BOS, EOS))
    return F.concat(bos, F.flatten(F.transform(path, ids)), eos)


def char_tag_rows(nodes: Column, tables: TagIds) -> Column:
    """B13 in-row: one struct (at, seg, pos, subpos, ctype, cform) of ids per node and character, by Arrow batch."""
    spans = F.arrays_zip(*[nodes[k].alias(k) for k in ("start", "end", *TAG_KINDS)])
    seg = SEG_IDS["B"], SEG_IDS["I"], SEG_IDS["E"]
    known = {k: tables[k].known for k in TAG_KINDS}
    joined = [F.col("__tags")] if None in known.values() else []
    row = ", ".join(f"{k}: int" for k in ("at", "seg", *TAG_KINDS))
    return cells.by_batch(lambda s, *tags: cells.tag_rows(s, seg, known, *tags), f"array<struct<{row}>>", spans, *joined)


def resolve_tags(nodes: Column, length: Column, tables: TagIds, where: Column | None = None) -> Column:
    """flat ``(length + 2) x 5`` ids; a tag stands only where all covering nodes agree. Null unless ``where``.

    Spans are ordered in the row; ids of tags are found and spans are swept by Arrow batch (:func:`cells.resolved`). A sentence
    never leaves its row.
    """
    spans = F.sort_array(F.arrays_zip(*[nodes[k].alias(k) for k in ("start", "end", *TAG_KINDS)]))
    chosen = spans if where is None else F.when(where, spans)  # a function by batch sees every row
    seg = SEG_IDS["B"], SEG_IDS["I"], SEG_IDS["E"]
    known = {k: tables[k].known for k in TAG_KINDS}
    joined = [F.col("__tags")] if None in known.values() else []
    return cells.by_batch(lambda s, n, *tags: cells.resolved(s, n, seg, known, *tags), "array<bigint>", chosen, length, *joined)


def encode_sentences(
    df: DataFrame,
    chars: DataFrame,
    tags: DataFrame,
    sid: Sequence[str],
    max_length: int | None = None,
    augment: Augment = Augment(),
    path_only_unks: bool = False,
) -> DataFrame:
    """``nodes`` and ``path`` to ``codes``, ``chars``, ``tags``, ``unks``.

    ``codes`` are the ids before augmentation; the content hash is taken from them. The cheap
    length tests run before any tag is resolved. ``reason`` is ``too_long`` for more than ``max_length``
    codes (no limit by default) and ``length_mismatch`` where the path's surfaces do not have the length
    its offsets say; those rows have no tags. ``tags`` and ``unks`` are plain columns: a reader that names neither has
    none resolved. There is no ``unks`` where nodes were parsed without their features.
    """
    table = char_table(chars)
    df, tables = tag_ids(df, tags, TAG_KINDS, sid)
    plain = encode_path(F.col("path"), table, sid)
    coded = computed_once(df, codes=plain, length=path_length(F.col("path")))
    long = F.lit(False) if max_length is None else F.size("codes") > max_length
    changed = augment.unk_prob > 0 or augment.zen2han_prob > 0
    final = encode_path(F.col("path"), table, sid, augment) if changed else F.col("codes")
    mismatch = F.size("codes") != F.col("length") + 2
    good = ~mismatch & ~long
    judged = computed_once(
        coded,
        chars=final if max_length is None else F.when(~long, final),
        reason=F.when(long, "too_long").when(mismatch, "length_mismatch"),
    )
    flagged = "path" if path_only_unks else "nodes"
    unks = [unk_flags(F.col(flagged)).alias("unks")] if "features" in df.schema[flagged].dataType.elementType.names else []
    return judged.select(
        *[c for c in coded.columns if c != "__tags"], "chars",
        resolve_tags(F.col("nodes"), F.col("length"), tables, good).alias("tags"), *unks, "reason")


def path_hash(df: DataFrame, chars: DataFrame, sid: Sequence[str]) -> DataFrame:
    """Content hashes (C9) of the sentences whose path has the length that its offsets say; no tag is looked up."""
    coded = computed_once(df, codes=encode_path(F.col("path"), char_table(chars), sid))
    fitting = coded.filter(F.size("codes") == path_length(F.col("path")) + 2)
    return fitting.select(*sid, seq_hash(F.col("codes"), narrow=True).alias("hash"))


def tag_view(tags: Column) -> Column:
    """The flat layout as one struct per position, for reading."""
    kinds = ["seg", *TAG_KINDS]
    rows = span((F.size(tags) / NUM_TAGS).cast("int"))
    return F.transform(
        rows, lambda i: F.struct(*[F.get(tags, i * NUM_TAGS + j).alias(k) for j, k in enumerate(kinds)])
    )
