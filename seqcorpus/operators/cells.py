"""Characters of sentences by Arrow batch: their codes, their tags, their tokens and the lines they are written as.

Column functions hand arrays over and take arrays back; what is odd in any way comes back as null where an expression decides it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession, functions as F

from ..sources.ship import ship
from .node_lines import begins, cut, last_of, list_offsets, marks_of, mask_of, parts_of, taken, texts_at, words_of

#: characters that are handled at once (a sentence is never cut)
SLICE_CELLS = 1 << 18
#: percentages from here on are written by the expression
LARGEST_SHARE = 1e6


def by_batch(function: Callable[..., pa.Array], returns: str, *columns: Column) -> Column:
    """``function`` of the columns' Arrow arrays as a column."""
    ship(SparkSession.active())

    def run(*arrays: pa.Array) -> pa.Array:
        return function(*arrays)

    return F.arrow_udf(run, returns)(*columns)


def sliced(sizes: np.ndarray, *arrays: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """Slices of rows that hold about :data:`SLICE_CELLS` by ``sizes``, or one row; one at least."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // SLICE_CELLS)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
        yield tuple(x.slice(a, b - a) for x in arrays)


def in_slices(function: Callable[..., pa.Array], sizes: np.ndarray, *arrays: pa.Array) -> pa.Array:
    return pa.concat_arrays([function(*part) for part in sliced(sizes, *arrays)])


def valid(array: pa.Array) -> np.ndarray:
    return pc.is_valid(array).to_numpy(zero_copy_only=False)


def list_sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def ends_of(sizes: np.ndarray) -> np.ndarray:
    """Where each of some lists begins, and behind the last."""
    return np.append(0, np.cumsum(sizes))


def list_array(sizes: np.ndarray, values: pa.Array, known: np.ndarray) -> pa.Array:
    """Lists of ``sizes`` (0 where not ``known``: null)."""
    mask = None if known.all() else pa.array(~known)
    return pa.ListArray.from_arrays(pa.array(ends_of(sizes), pa.int32()), values, mask=mask)


def readable(texts: pa.Array) -> pa.Array:
    """Texts without nulls whose bytes are all UTF-8; what is not is replaced."""
    texts = texts.cast(pa.string()) if texts.type != pa.string() else texts
    try:
        bytes(parts_of(texts)[0]).decode()
    except UnicodeDecodeError:
        return pa.array([t.decode(errors="replace") for t in texts.cast(pa.binary()).to_pylist()], pa.string())
    return texts


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first byte of every character, number of characters of each text) of :func:`readable` texts."""
    data, offsets = parts_of(texts)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    return data, at, np.diff(np.searchsorted(at, offsets))


def points_of(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(bytes(data).decode().encode("utf-32-le"), np.uint32)


def ids_of(points: np.ndarray, table: np.ndarray, default: int) -> np.ndarray:
    if not len(table):
        return np.full(len(points), default, np.int64)
    return np.where(points < len(table), table[np.minimum(points, len(table) - 1)], default)


def _framed(ids: np.ndarray, sizes: np.ndarray, known: np.ndarray, ends: tuple[int, int] | None) -> pa.Array:
    """Lists of ids, between two others if ``ends`` names them."""
    if ends is None:
        return list_array(sizes, pa.array(ids, pa.int64()), known)
    sizes = np.where(known, sizes + 2, 0)
    out = np.empty(int(sizes.sum()), np.int64)
    last = np.cumsum(sizes)[known] - 1
    first = last - sizes[known] + 1
    inner = np.ones(len(out), bool)
    inner[first] = inner[last] = False
    out[first], out[last], out[inner] = ends[0], ends[1], ids
    return list_array(sizes, pa.array(out, pa.int64()), known)


def text_codes(texts: pa.Array, table: np.ndarray, default: int, ends: tuple[int, int] | None) -> pa.Array:
    """Ids of the characters of each text; null for null."""
    known = valid(texts)
    data, _, sizes = characters(plain := readable(pc.fill_null(texts, "")))
    return _framed(ids_of(points_of(data), table, default), sizes, known, ends) if len(plain) else pa.array([], pa.list_(pa.int64()))


def path_codes(surfaces: pa.Array, table: np.ndarray, default: int, ends: tuple[int, int]) -> pa.Array:
    """Ids of the characters of the surfaces of each path; null for a null list and for one with a null in it."""
    flat, sizes = surfaces.flatten(), list_sizes(surfaces)
    known, row = valid(surfaces), np.repeat(np.arange(len(sizes)), sizes)
    known[row[~valid(flat)]] = False
    if not known.all():
        flat, row = flat.filter(pa.array(known[row])), row[known[row]]
    data, _, counts = characters(readable(flat))
    chars = np.bincount(row, counts, len(sizes)).astype(np.int64)
    return _framed(ids_of(points_of(data), table, default), chars, known, ends)


def agreed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The value of each run that begins at ``first``, 0 where it holds different ones."""
    if len(first) == len(values):
        return values
    low, high = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)
    return np.where(low == high, low, 0)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    new = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.append(True, new)[: len(columns[0])]


def tag_ids(tags: pa.Array, ids: dict[str, int]) -> np.ndarray:
    """Ids of tags, 0 for what has none."""
    place = pc.index_in(tags, pa.array(list(ids), pa.string()), skip_nulls=True)
    return pc.fill_null(pa.array(list(ids.values()), pa.int64()).take(place), 0).to_numpy()


def joined_ids(row: np.ndarray, tags: pa.Array, entries: pa.Array, kind: str) -> np.ndarray:
    """Ids of tags from the entries (kind, tag, id) that came with their row, 0 for what has none."""
    flat, owner = entries.flatten(), np.repeat(np.arange(len(entries)), list_sizes(entries))
    own = mask_of(pc.equal(pc.struct_field(flat, "kind"), kind)) & valid(pc.struct_field(flat, "tag"))
    flat, owner = flat.filter(pa.array(own)), owner[own]
    codes = pc.fill_null(pa.concat_arrays([tags, pc.struct_field(flat, "tag")]).dictionary_encode().indices, -1).to_numpy()
    size = int(codes.max(initial=0)) + 2
    wanted, there = row * size + codes[: len(row)], owner * size + codes[len(row):]
    order = np.argsort(there, kind="stable")
    there, ids = np.append(there[order], -2), np.append(pc.struct_field(flat, "id").to_numpy()[order], 0)
    place = np.searchsorted(there[:-1], wanted)
    return np.where((there[place] == wanted) & (codes[: len(row)] >= 0), ids[place], 0).astype(np.int64)


def _full_spans(flat: pa.Array, row: np.ndarray, sizes: np.ndarray, ids: dict[str, dict[str, int] | None], *entries: pa.Array) -> tuple:
    """Spans that are not empty, their rows and numbers by row, starts, ends and ids of tags by kind."""
    full = mask_of(pc.greater(pc.struct_field(flat, "end"), pc.struct_field(flat, "start")))
    if not full.all():
        flat, row = flat.filter(pa.array(full)), row[full]
        sizes = np.bincount(row, minlength=len(sizes))
    start, end = (pc.struct_field(flat, c).to_numpy().astype(np.int64) for c in ("start", "end"))
    tags = []
    for kind, own in ids.items():
        found = pc.struct_field(flat, kind)
        tags.append(joined_ids(row, found, entries[0], kind) if own is None else tag_ids(found, own))
    return flat, row, sizes, start, end, tags


def _spread(start: np.ndarray, end: np.ndarray, n: np.ndarray, seg: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Span, place and segmentation id of the first ``n`` characters of each span."""
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n - start, n)
    segments = np.full(len(of), seg[1], np.int64)
    segments[place == (end - 1)[of]] = seg[2]
    segments[place == start[of]] = seg[0]
    return of, place, segments


def _tag_rows(spans: pa.Array, seg: tuple[int, int, int], ids: dict[str, dict[str, int] | None], *entries: pa.Array) -> pa.Array:
    sizes = list_sizes(spans)
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, row, _, start, end, tags = _full_spans(spans.flatten(), row, sizes, ids, *entries)
    of, place, segments = _spread(start, end, end - start, seg)
    fields = {"at": place, "seg": segments, **{k: t[of] for k, t in zip(ids, tags)}}
    rows = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in fields.values()], names=list(fields))
    return list_array(np.bincount(row, end - start, len(sizes)).astype(np.int64), rows, valid(spans))


def tag_rows(spans: pa.Array, *options) -> pa.Array:
    """A struct (at, seg, an id of each kind) for each character of each span (start, end, a tag of each kind)."""
    return in_slices(lambda s, *e: _tag_rows(s, options[0], options[1], *e), list_sizes(spans) * 4, spans, *options[2:])


def _resolved(spans: pa.Array, length: pa.Array, seg: tuple[int, int, int], ids: dict[str, dict[str, int] | None], *entries: pa.Array) -> pa.Array:
    known = valid(spans) & valid(length)
    if not known.all():
        spans, length, *entries = (x.filter(pa.array(known)) for x in (spans, length, *entries))
    inner = np.maximum(length.to_numpy().astype(np.int64), 0)
    flat = spans.flatten()
    width = 1 + len(ids)
    sizes = list_sizes(spans)
    row = np.repeat(np.arange(len(sizes)), sizes)
    flat, row, sizes, start, end, tags = _full_spans(flat, row, sizes, ids, *entries)
    base = np.zeros(len(sizes), np.int64)
    full = sizes > 0
    base[full] = np.minimum(start[ends_of(sizes)[:-1][full]], 0)  # spans are in order
    first = np.flatnonzero(changes(row, start, end))
    tags = [agreed(t, first) for t in tags]
    row, start, end = row[first], (start - base[row])[first], (end - base[row])[first]
    # spans that begin before another one of their sentence has ended
    size = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(row * size + end) - row * size
    crossing = np.append(False, (row[1:] == row[:-1]) & (start[1:] < reach[:-1]))[: len(row)]
    crossed = np.zeros(len(sizes), bool)
    crossed[row[crossing]] = True
    n = np.maximum(np.minimum(end, inner[row]) - start, 0)
    of, place, segments = _spread(start, end, n, seg)
    upto = ends_of(inner + 2)
    at = np.repeat(upto[row] + 1, n) + place
    out = np.zeros((int(upto[-1]), width), np.int64)
    if crossed.any():
        odd = crossed[row][of]
        order = np.flatnonzero(odd)
        order = order[np.argsort(at[order], kind="stable")]
        cell = np.flatnonzero(changes(at[order]))
        for k, values in enumerate([segments, *[t[of] for t in tags]]):
            out[at[order][cell], k] = agreed(values[order], cell)
        of, at, segments = of[~odd], at[~odd], segments[~odd]
    out[at, 0] = segments
    for k, t in enumerate(tags, 1):
        out[at, k] = t[of]
    every = np.zeros(len(known), np.int64)
    every[known] = (inner + 2) * width
    return list_array(every, pa.array(out.reshape(-1)), known)


def resolved(spans: pa.Array, length: pa.Array, seg: tuple[int, int, int], ids: dict[str, dict[str, int] | None], *entries: pa.Array) -> pa.Array:
    """Flat ``(length + 2) x (1 + kinds)`` ids of ascending spans (start, end, a tag of each kind): a character has the ids
    on which all spans over it agree. ``seg`` holds the ids of a span's first, inner and last characters, ``ids`` those of
    tags by kind (none: those of the row's ``entries`` count).

    Equal spans are one; only cells of sentences whose spans still cross are sorted by place."""
    sizes = pc.fill_null(length, 0).to_numpy(zero_copy_only=False)
    return in_slices(lambda s, n, *e: _resolved(s, n, seg, ids, *e), np.maximum(sizes, 0) + 2, spans, length, *entries)


def label_places(tag: np.ndarray, labels: int) -> np.ndarray:
    """Place of each tag's label, behind the last one for what has none."""
    return np.where((tag >= 0) & (tag < labels), tag, labels)


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint32(bits)) | (x >> np.uint32(32 - bits))


class SequenceHash:
    """Murmur-like hashes of lists of integers, all lists of a batch a step at a time, the longest ones at last by themselves.

    ``narrow``: the high halves of all elements are zero."""

    FEW = 12  # lists from which on steps by vector pay

    def __init__(self, narrow: bool, seed: int, first: int, second: int, rotate: tuple[int, int], add: int):
        self.narrow, self.seed, self.first, self.second, (self.item, self.state), self.add = narrow, seed, first, second, rotate, add

    def items(self, words: np.ndarray) -> np.ndarray:
        return _rotated(words * np.uint32(self.first), self.item) * np.uint32(self.second)

    def stirred(self, h: np.ndarray) -> np.ndarray:
        return _rotated(h, self.state) * np.uint32(5) + np.uint32(self.add)

    def alone(self, h: int, high: list[int], low: list[int]) -> int:
        """The state of one list after more elements."""
        up, down, add = self.state, 32 - self.state, self.add
        for a, b in zip(high, low):
            h ^= a
            h = (((h << up & 0xFFFFFFFF) | h >> down) * 5 + add) & 0xFFFFFFFF
            h ^= b
            h = (((h << up & 0xFFFFFFFF) | h >> down) * 5 + add) & 0xFFFFFFFF
        return h

    def __call__(self, lists: pa.Array) -> pa.Array:
        flat, sizes = lists.flatten(), list_sizes(lists)
        known = valid(lists)
        if flat.null_count:
            known[np.repeat(np.arange(len(sizes)), sizes)[~valid(flat)]] = False
            flat = pc.fill_null(flat, 0)
        words = flat.to_numpy().view(np.uint64)
        low = self.items(words.astype(np.uint32))
        high = np.zeros(len(low), np.uint32) if self.narrow else self.items((words >> np.uint64(32)).astype(np.uint32))
        order = np.argsort(-sizes, kind="stable")
        first, ordered = ends_of(sizes)[:-1][order], sizes[order]
        h = np.full(len(sizes), self.seed, np.uint32)
        step, active = 0, int((ordered > 0).sum())
        while active > self.FEW:
            at = first[:active] + step
            h[:active] = self.stirred(self.stirred(h[:active] ^ high[at]) ^ low[at])
            step += 1
            active = int(np.searchsorted(-ordered[:active], -step, "left"))
        for i in range(active):
            a, b = first[i] + step, first[i] + ordered[i]
            h[i] = self.alone(int(h[i]), high[a:b].tolist(), low[a:b].tolist())
        out = np.empty(len(sizes), np.uint32)
        out[order] = h
        return pa.array((out ^ self.items(sizes.astype(np.uint32))).view(np.int32), mask=~known)


class FlatTags:
    """Values of flat lists by row, character and kind; row 0 of the layout is the begin code."""

    def __init__(self, lists: pa.Array, width: int, missing: float):
        self.sizes, self.width, self.missing = list_sizes(lists), width, missing
        self.first = ends_of(self.sizes)[:-1]
        self.flat = pc.fill_null(lists.flatten(), missing).to_numpy(zero_copy_only=False)

    def at(self, row: np.ndarray, place: np.ndarray, kind: int) -> np.ndarray:
        step = (place + 1) * self.width + kind
        inside = step < self.sizes[row]
        if inside.all():
            return self.flat[self.first[row] + step]
        out = np.full(len(row), self.missing, self.flat.dtype)
        out[inside] = self.flat[(self.first[row] + step)[inside]]
        return out


def _tokens(text: pa.Array, tags: pa.Array, labels: dict[str, list[str]], begin: int) -> pa.Array:
    known = valid(text)
    plain = readable(pc.fill_null(text, ""))
    data, at, counts = characters(plain)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(row)) - np.repeat(ends_of(counts)[:-1], counts)
    flat = FlatTags(tags, 1 + len(labels), -1)
    first = np.flatnonzero((place == 0) | (flat.at(row, place, 0) == begin))
    row, place, at = row[first], place[first], at[first]
    empty = np.flatnonzero(known & (counts == 0))
    if len(empty):  # an empty text is one empty token
        order = np.argsort(np.concatenate([row, empty]), kind="stable")
        nothing = np.zeros(len(empty), np.int64)
        row, place = (np.concatenate(x)[order] for x in ((row, empty), (place, nothing)))
        at = np.concatenate([at, parts_of(plain)[1][empty]])[order]
    surface = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data))
    shown = [pa.array([*own, "UNK"]).take(pa.array(label_places(flat.at(row, place, i), len(own))))
             for i, own in enumerate(labels.values(), 1)]
    tokens = pa.StructArray.from_arrays([pa.array(place, pa.int32()), surface, *shown], names=["start", "surface", *labels])
    return list_array(np.bincount(row, minlength=len(known)), tokens, known)


def tokens_of(text: pa.Array, tags: pa.Array, labels: dict[str, list[str]], begin: int) -> pa.Array:
    """Tokens (start, surface, a label of each kind): one begins at the first character and wherever the first tag is ``begin``."""
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    return in_slices(lambda t, f: _tokens(t, f, labels, begin), sizes, text, tags)


def glued(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(p) if isinstance(p, str) else p for p in parts], pa.scalar(""))


def headed(comment: pa.Array, mark: str) -> pa.Array:
    """Comments with the mark behind, nothing for empty and null ones."""
    full = pc.fill_null(pc.not_equal(comment, ""), False)
    return pc.if_else(full, glued(pc.fill_null(comment, ""), mark), "")


def token_texts(comment: pa.Array, tokens: pa.Array, fmt: str) -> pa.Array:
    """Sentences in the format ``juman`` or ``mrph``, null where a list or anything in it is null."""
    flat, sizes = tokens.flatten(), list_sizes(tokens)
    known, row = valid(tokens), np.repeat(np.arange(len(sizes)), sizes)
    names = ["surface", "pos", "subpos", "ctype", "cform"]
    fields = {n: pc.struct_field(flat, n) for n in names}
    for f in fields.values():
        if f.null_count:
            known[row[~valid(f)]] = False
            fields = {n: pc.fill_null(v, "") for n, v in fields.items()}
    surface, pos, subpos, ctype, cform = (fields[n] for n in names)
    if fmt == "juman":
        rows = glued(surface, " * * ", pos, " 0 ", subpos, " 0 ", ctype, " 0 ", cform, " 0 NIL")
    else:
        rows = glued(surface, "_", pos, ":", subpos)
    lines = pa.ListArray.from_arrays(pa.array(ends_of(sizes), pa.int32()), rows)
    if fmt == "juman":
        found = glued(headed(comment, "\n"), pc.binary_join(lines, "\n"), "\nEOS")
    else:
        full = pc.fill_null(pc.not_equal(comment, ""), False)
        found = glued(pc.binary_join(lines, " "), pc.if_else(full, glued(" ", pc.fill_null(comment, "")), ""))
    return pc.if_else(pa.array(known), found, pa.scalar(None, pa.string()))


def tenths(shares: np.ndarray) -> np.ndarray:
    """Finite shares from 0 in tenths of a percent, halves of the shortest decimal form rounded up."""
    percent = shares * 100
    scaled = percent * 10
    out = np.floor(scaled + 0.5)
    near = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)
    if len(near):
        values, place = np.unique(percent[near], return_inverse=True)
        exact = [int(Decimal(repr(v)).quantize(Decimal("0.1"), ROUND_HALF_UP).scaleb(1)) for v in values.tolist()]
        out[near] = np.array(exact, np.int64)[place]
    return out.astype(np.int64)


def _debug_texts(comment: pa.Array, text: pa.Array, tags: pa.Array, probs: pa.Array, labels: Sequence[Sequence[str]]) -> pa.Array:
    width = len(labels)
    plain = readable(pc.fill_null(text, ""))
    data, at, counts = characters(plain)
    tag, prob = FlatTags(tags, width, -1), FlatTags(probs, width, np.nan)
    known = valid(text) & valid(tags) & valid(probs) & (np.minimum(tag.sizes, prob.sizes) >= (counts + 1) * width)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(row)) - np.repeat(ends_of(counts)[:-1], counts)
    combined, columns = np.zeros(len(row), np.int64), []
    for k, own in enumerate(labels):
        combined = combined * (len(own) + 1) + label_places(tag.at(row, place, k), len(own))
        share = prob.at(row, place, k)
        fits = (share >= 0) & (share < LARGEST_SHARE) & ~np.signbit(share)  # false for what is no number
        if not fits.all():
            known[row[~fits]] = False
            share = np.where(fits, share, 0)
        columns.append(tenths(share))
    seen, which = np.unique(combined, return_inverse=True)
    names = []
    for code in seen.tolist():
        parts = []
        for own in reversed(labels):
            code, label = divmod(code, len(own) + 1)
            parts.append(own[label] if label < len(own) else "UNK")
        names.append("\t".join(reversed(parts)))

    def written(values: np.ndarray) -> pa.Array:
        if values.max(initial=0) <= 1000:
            return SHARES.take(pa.array(values))
        some, own = np.unique(values, return_inverse=True)
        return pa.array([f"{v // 10}.{v % 10}" for v in some.tolist()]).take(pa.array(own))

    ch = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data))
    shown = pa.array(names, pa.string()).take(pa.array(which))
    lines = glued(pc.binary_join_element_wise(ch, shown, *[written(c) for c in columns], pa.scalar("\t")), "\n")
    body = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends_of(counts), pa.int32()), lines), "")
    return pc.if_else(pa.array(known), glued(headed(comment, "\n"), body, "EOS"), pa.scalar(None, pa.string()))


SHARES = pa.array([f"{v // 10}.{v % 10}" for v in range(1001)])


def debug_texts(comment: pa.Array, text: pa.Array, tags: pa.Array, probs: pa.Array, labels: Sequence[Sequence[str]]) -> pa.Array:
    """A line for every character: its labels and their probabilities in percent; null for sentences whose flat lists are too
    short or hold odd numbers."""
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    return in_slices(lambda *part: _debug_texts(*part, labels), sizes, comment, text, tags, probs)


#: one line of a debug table as it is read back
DEBUG_CHARS = "array<struct<ch: string, tags: array<struct<tag: string, prob: float>>>>"


def _debug_rows(raw: pa.Array, end_mark: str) -> pa.Array:
    known, count = valid(raw), len(raw)
    data, offsets = parts_of(pc.fill_null(raw, "").cast(pa.string()))
    words = words_of(data)
    newlines, tabs = marks_of(data, "\n", "\t")
    begin, end, row = cut(offsets[:-1], offsets[1:], newlines)
    kept = end > begin
    marks = begins(words, begin, end, end_mark)
    kept[marks[(end - begin)[marks] == len(end_mark.encode())]] = False
    noted = np.zeros(len(row), bool)
    noted[begins(words, begin, end, "# ")] = True
    remarks = np.flatnonzero(kept & noted)
    latest = last_of(row[remarks], remarks, count)
    shown = np.flatnonzero(latest >= 0)
    notes = texts_at(data, begin[latest[shown]], end[latest[shown]])
    place = np.full(count, -1, np.int64)
    place[shown] = np.arange(len(shown))
    comments = pc.fill_null(taken(notes, place), "")
    lines = np.flatnonzero(kept & ~noted)
    begin, end, row = begin[lines], end[lines], row[lines]
    a, b, line = cut(begin, end, tabs)
    sizes = np.bincount(line, minlength=len(lines))
    # as many tags as probabilities, no field empty
    good = (sizes % 2 == 1) & (np.bincount(line, b > a, len(lines)).astype(np.int64) == sizes)
    known[row[~good]] = False
    first = ends_of(sizes)[:-1]
    step = np.arange(len(a)) - first[line]
    tags = sizes[line] // 2
    fits = known[row][line]
    probs = np.flatnonzero(fits & (step > tags))
    texts = texts_at(data, a[probs], b[probs])
    plain = mask_of(pc.match_substring_regex(texts, r"\A[0-9]{1,9}(?:\.[0-9]{1,9})?\z"))
    if not plain.all():
        known[row[line[probs[~plain]]]] = False
        fits = known[row][line]
        texts, probs = texts.filter(pa.array(fits[probs])), probs[fits[probs]]
    names = np.flatnonzero(fits & (step > 0) & (step <= tags))
    pairs = pa.StructArray.from_arrays([texts_at(data, a[names], b[names]), pc.cast(texts, pa.float32())], names=["tag", "prob"])
    own = known[row]
    heads = first[own]
    lists = pa.ListArray.from_arrays(pa.array(ends_of(sizes[own] // 2), pa.int32()), pairs)
    cells = pa.StructArray.from_arrays([texts_at(data, a[heads], b[heads]), lists], names=["ch", "tags"])
    chars = pa.ListArray.from_arrays(list_offsets(row[own], count), cells)
    return pa.StructArray.from_arrays([comments, chars], names=["comment", "chars"], mask=pa.array(~known))


def debug_rows(raw: pa.Array, end_mark: str) -> pa.Array:
    """(comment, chars) of the records of a debug table; null where a line is odd in any way: an empty field, an even number
    of them, no plain decimal."""
    sizes = pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False) // 16
    return in_slices(lambda part: _debug_rows(part, end_mark), sizes, raw)


#: constants of MD5 (RFC 1321)
_MD5_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_MD5_ADDED = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: texts of one block, and texts that are digested at once
_MD5_SHORT, _MD5_TEXTS = 55, 1 << 14


def _md5_block(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First two words of the digests of padded blocks (16 x texts)."""
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in _MD5_START)
    for i in range(64):
        if i < 16:
            f, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[at]
        f += np.uint32(_MD5_ADDED[i])
        a, d, c, b = d, c, b, b + _rotated(f, _MD5_SHIFTS[i])
    return a + np.uint32(_MD5_START[0]), b + np.uint32(_MD5_START[1])


def md5_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First and second eight hex digits of the MD5 digest of each text, as numbers; a block of each text at a time."""
    out = np.zeros((2, len(texts)), np.uint32)
    data, offsets = parts_of(texts)
    for low in range(0, len(texts), _MD5_TEXTS):
        own = offsets[low:low + _MD5_TEXTS + 1]
        sizes = np.diff(own)
        n = len(sizes)
        short = sizes <= _MD5_SHORT
        block = np.zeros((n, 64), np.uint8)
        used = np.where(short, sizes, 0)
        row = np.repeat(np.arange(n), used)
        step = np.arange(len(row)) - np.repeat(np.cumsum(used) - used, used)
        block[row, step] = data[own[:-1][row] + step]
        block[np.arange(n), used] = 0x80
        words = block.view("<u4")
        words[:, 14] = used * 8
        for i, x in enumerate(_md5_block(np.ascontiguousarray(words.T))):
            out[i, low:low + n] = x.byteswap()
        for i in np.flatnonzero(~short).tolist():
            digest = hashlib.md5(bytes(data[own[i]:own[i + 1]]), usedforsecurity=False).digest()
            out[:, low + i] = np.frombuffer(digest[:8], ">u4")
    return out[0], out[1]


def _masked(keys: pa.Array, starts: pa.Array, ends: pa.Array, shares: tuple[int, int], below: tuple[float, float], ops: tuple[int, int, int, int]) -> pa.Array:
    none, keep, random, mask = ops
    known = valid(starts)
    sizes = list_sizes(starts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.maximum(ends.flatten().to_numpy(zero_copy_only=False).astype(np.int64) - start, 0)

    def drawn(row: np.ndarray, place: np.ndarray, salt: str) -> tuple[np.ndarray, np.ndarray]:
        return md5_words(glued(keys.take(pa.array(row)), ":", pc.cast(pa.array(place), pa.string()), f":{salt}"))

    def op(word: np.ndarray) -> np.ndarray:
        unit = word / float(1 << 32)
        return np.where(unit < below[0], keep, np.where(unit < below[1], random, mask))

    first, second = drawn(row, start, "token")
    whole = first < shares[0]
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n - start, n)
    plan = np.where(whole, op(second), none)[of]
    single = np.flatnonzero(~whole[of])
    first, second = drawn(row[of[single]], place[single], "char")
    plan[single] = np.where(first < shares[1], op(second), none)
    return _framed(plan, np.bincount(row, n, len(sizes)).astype(np.int64), known, (none, none))


def mask_ops(keys: pa.Array, starts: pa.Array, ends: pa.Array, *options) -> pa.Array:
    """An op for each character of the tokens from ``starts`` to ``ends``, between two others; see ``masking.mask_plan``. A token or
    character is taken if the first word of its digest lies below its share; the second word says which op."""
    return in_slices(lambda *part: _masked(*part, *options), list_sizes(starts) * 4, keys, starts, ends)
