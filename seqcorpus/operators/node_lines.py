"""Lattice lines by Arrow batch: the regular ones, a few vector operations for all lines of a slice at a time.

Only sentences whose every node line is plain are built here; what is odd in any way is left, as text, to the expressions
in :mod:`lattice`, which decide it. Spark hands over the batches; a sentence never leaves its row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose texts hold about ``most`` bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    places = np.cumsum(sizes, dtype=np.int64) // most
    cuts = np.flatnonzero(np.diff(places)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def pieces(texts: pa.Array, separator: str) -> tuple[pa.Array, np.ndarray]:
    """(all pieces of non-null texts, row of each piece)."""
    cut = pc.split_pattern(texts, separator)
    return cut.flatten(), np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False))


def mask_of(found: pa.Array) -> np.ndarray:
    return pc.fill_null(found, False).to_numpy(zero_copy_only=False)


def list_offsets(rows: np.ndarray, count: int) -> pa.Array:
    """Offsets of ``count`` lists from the ascending row numbers of their elements."""
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=count))]), pa.int32())


def last_of(rows: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """The last of the places ``at`` of every row, -1 without any."""
    out = np.full(count, -1, np.int64)
    out[rows] = at  # later ones overwrite earlier ones
    return out


def taken(values: pa.Array, at: np.ndarray) -> pa.Array:
    """Values by place, null for place -1."""
    return values.take(pa.array(at, mask=at < 0))


def parts_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of an array without nulls; no text is copied."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(b"" if data is None else data, np.uint8)[at[0]:at[-1]], at - at[0]


def marks_of(data: np.ndarray, *marks: str) -> list[np.ndarray]:
    """Where each of some ASCII characters lies. No byte of a longer UTF-8 character equals one."""
    found = data == ord(marks[0])
    for mark in marks[1:]:
        found |= data == ord(mark)
    at = np.flatnonzero(found)
    own = data[at]
    return [at[own == ord(mark)] for mark in marks]


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number; behind the end there are zeros."""
    return np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))


def cut(starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, owner) of the pieces of ascending texts that are cut at the places ``at`` within them."""
    first = np.searchsorted(at, starts)
    counts = np.searchsorted(at, ends) - first
    owner = np.repeat(np.arange(len(starts)), counts + 1)
    firsts = np.cumsum(counts + 1) - counts - 1
    step = np.arange(len(owner)) - firsts[owner]
    inner = at[np.minimum(first[owner] + step, len(at) - 1)] if len(at) else np.zeros(len(owner), np.int64)
    last = step == counts[owner]
    stop = np.where(last, ends[owner], inner)
    begin = np.where(step == 0, starts[owner], np.append(0, stop[:-1] + 1))
    return begin, stop, owner


def texts_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts by their places in ``data``, which ascend: every second element of an array over the same bytes."""
    if not len(starts):
        return pa.array([], pa.string())
    both = np.stack([starts, ends], 1).reshape(-1).astype(np.int32)
    spread = pa.StringArray.from_buffers(len(both) - 1, pa.py_buffer(both), pa.py_buffer(data))
    return spread.take(pa.array(np.arange(0, len(both) - 1, 2)))


def begins(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: str, heads: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the texts that begin with ``key``; ``heads`` are the texts' first words where they are known."""
    wanted = key.encode()
    size = len(wanted)
    heads = words[starts] if heads is None else heads
    if size < 8:
        heads = heads & np.uint64((1 << 8 * size) - 1)
    found = np.flatnonzero(heads == np.uint64(int.from_bytes(wanted[:8], "little")))
    found = found[(ends[found] - starts[found]) >= size]
    for i in range(8, size, 8):
        at = min(i, size - 8)
        found = found[words[starts[found] + at] == np.uint64(int.from_bytes(wanted[at:at + 8], "little"))]
    return found


def numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, signed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(value, whether the text is a plain number): one to nine digits, behind a minus if ``signed``."""
    value, size = np.zeros(len(starts), np.int64), ends - starts
    minus = np.zeros(len(starts), bool)
    if signed and len(data):
        minus = (size > 1) & (data[np.minimum(starts, len(data) - 1)] == ord("-"))
        if minus.any():
            starts, size = starts + minus, size - minus
    good = (size > 0) & (size < 10)
    left = np.flatnonzero(good)
    for i in range(9):
        left = left[size[left] > i]
        if not len(left):
            break
        digit = data[starts[left] + i] - np.uint8(48)  # wraps for what lies before the digits
        good[left[digit > 9]] = False
        value[left] = value[left] * 10 + digit
    return np.where(minus, -value, value), good


class PlainParser:
    """``mapInArrow`` function: adds comment, nodes and ``done`` of plain sentences and takes their text away.

    Lines and fields are places in the batch's bytes; only the texts of wanted fields are copied."""

    def __init__(self, raw: str, schema: pa.Schema, names: Sequence[str], columns: dict[str, int], integers: Sequence[int],
                 lists: Sequence[int], mark: str, features: int, scores: dict[str, str], ranks: str):
        self.raw, self.schema, self.names, self.columns = raw, schema, list(names), columns
        self.integers, self.lists, self.mark, self.features = list(integers), list(lists), mark, features
        self.scores, self.ranks = scores, ranks

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, self.raw):
                yield self.parsed(part)

    def parsed(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, count = batch.column(self.raw).cast(pa.string()), batch.num_rows
        good = ~pc.is_null(raw).to_numpy(zero_copy_only=False)
        data, offsets = parts_of(pc.fill_null(raw, ""))
        words = words_of(data)
        returns, newlines, tabs, bars = marks_of(data, "\r", "\n", "\t", "|")
        good[np.searchsorted(offsets, returns, "right") - 1] = False
        begin, end, rows = cut(offsets[:-1], offsets[1:], newlines)
        at = np.arange(len(rows))
        # Lines up to the first end mark; without one, all but the empty piece that a final newline leaves.
        marks = begins(words, begin, end, self.mark)
        marks = marks[(end - begin)[marks] == len(self.mark.encode())]
        first_end = np.full(count, len(rows), np.int64)
        first_end[rows[marks[::-1]]] = marks[::-1]
        kept = at < first_end[rows]
        last = np.append(rows[1:] != rows[:-1], True)[: len(rows)]
        kept &= ~(last & (first_end[rows] == len(rows)) & (begin == end))
        noted = np.zeros(len(rows), bool)
        noted[begins(words, begin, end, "#")] = True
        remarks = np.flatnonzero(kept & noted)
        latest = last_of(rows[remarks], remarks, count)
        shown = np.flatnonzero(good & (latest >= 0))
        behind = np.full(count, -1, np.int64)
        nodes = np.flatnonzero(kept & ~noted)
        begin_of_note, end_of_note = begin[latest[shown]], end[latest[shown]]
        begin, end, rows = begin[nodes], end[nodes], rows[nodes]
        first = np.searchsorted(tabs, begin)
        tabs_in = np.searchsorted(tabs, end) - first
        good[rows[tabs_in < self.features]] = False
        begin, end, rows, first, tabs_in = self.of_good(good, rows, begin, end, rows, first, tabs_in)

        def bounds(i: int) -> tuple[np.ndarray, np.ndarray]:
            """Where field ``i`` of all lines begins and ends."""
            a = begin if i == 0 else tabs[first + i - 1] + 1
            if i < self.features:
                return a, tabs[first + i]
            return a, np.where(tabs_in > i, tabs[np.minimum(first + i, len(tabs) - 1)], end) if len(tabs) else end

        values = {}
        for i in self.integers:
            values[i], right = numbers(data, *bounds(i))
            good[rows[~right]] = False
        cut_lists = {i: self.int_pieces(data, *bounds(i), good, rows) for i in self.lists}
        left, right = bounds(self.features)
        part = cut(left, right, bars)
        heads = words[part[0]]
        special = np.zeros(len(part[0]), bool)
        scores = {}
        for name, key in self.scores.items():
            own = begins(words, part[0], part[1], key + ":", heads)
            special[own] = True
            texts = texts_at(data, part[0][own] + len(key.encode()) + 1, part[1][own])
            right = mask_of(pc.match_substring_regex(texts, r"\A-?[0-9]{1,9}(?:\.[0-9]{1,9})?\z"))
            good[rows[part[2][own[~right]]]] = False
            scores[name] = part[2][own], texts if right.all() else pc.if_else(pa.array(right), texts, pa.scalar(None, pa.string()))
        own = begins(words, part[0], part[1], self.ranks + ":", heads)
        special[own] = True
        ranked = part[2][own], *self.int_pieces(data, part[0][own] + len(self.ranks.encode()) + 1, part[1][own], good, rows[part[2][own]])
        found = good[rows]  # lines of sentences that are plain in every part
        kind = self.schema.field("__nodes").type.value_type
        made = [self.field(name, data, bounds, values, cut_lists, scores, ranked, part, special, len(rows)) for name in self.names]
        struct = pa.StructArray.from_arrays(made, fields=list(kind))
        if not found.all():
            struct = struct.filter(pa.array(found))
        rows_of = pa.ListArray.from_arrays(list_offsets(rows[found], count), struct)
        every = np.arange(count)
        shown_good = good[shown]
        notes = texts_at(data, begin_of_note[shown_good], end_of_note[shown_good])
        behind[shown[shown_good]] = np.arange(int(shown_good.sum()))
        columns = {
            **{n: batch.column(n) for n in batch.schema.names}, self.raw: taken(raw, np.where(good, -1, every)),
            "__comment": taken(notes, behind), "__nodes": rows_of, "__done": pa.array(good),
        }
        return pa.RecordBatch.from_arrays([columns[n] for n in self.schema.names], names=self.schema.names)

    @staticmethod
    def of_good(good: np.ndarray, rows: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
        right = good[rows]
        return columns if right.all() else tuple(c[right] for c in columns)

    @staticmethod
    def int_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, good: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, value) of the numbers of ``1;2;3``; rows whose text is not nine digits and semicolons at most are not good."""
        size = ends - starts
        long = size > 9
        good[rows[long]] = False
        ends = np.where(long, starts, ends)
        owner = np.repeat(np.arange(len(starts)), ends - starts)
        step = np.arange(len(owner)) - (np.cumsum(ends - starts) - (ends - starts))[owner]
        where = starts[owner] + step
        a, b, of = cut(starts, ends, where[data[where] == ord(";")])
        full = b > a
        a, b, of = a[full], b[full], of[full]
        value, right = numbers(data, a, b, signed=False)
        good[rows[of[~right]]] = False
        return of, value

    def field(self, name: str, data: np.ndarray, bounds, values: dict, lists: dict, scores: dict, ranked: tuple, part: tuple,
              special: np.ndarray, count: int) -> pa.Array:
        """One field of all nodes."""

        def list_of(owner: np.ndarray, value: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(list_offsets(owner, count), pa.array(value, pa.int32()))

        if name in self.scores:
            owner, texts = scores[name]
            return pc.fill_null(pc.cast(taken(texts, last_of(owner, np.arange(len(owner)), count)), pa.float32()), float("nan"))
        if name == "ranks":
            line, of, value = ranked
            last = last_of(line, np.arange(len(line)), count)  # of several only the last counts
            used = last[line[of]] == of
            return list_of(line[of[used]], value[used])
        if name == "features":
            rest = np.flatnonzero(~special & (part[1] > part[0]))
            pairs = pc.split_pattern(texts_at(data, part[0][rest], part[1][rest]), ":", max_splits=1)
            sizes = pc.list_value_length(pairs).to_numpy(zero_copy_only=False)
            first = (np.cumsum(np.append(0, sizes))[:-1]).astype(np.int64)
            flat = pairs.flatten()
            pair = pa.StructArray.from_arrays(
                [flat.take(pa.array(first)), taken(flat, np.where(sizes > 1, first + 1, -1))], names=["key", "value"])
            return pa.ListArray.from_arrays(list_offsets(part[2][rest], count), pair)
        at = self.columns[name]
        if at in lists:
            return list_of(*lists[at])
        if at in values:
            return pa.array(values[at] + (name == "end"), pa.int32())
        return texts_at(data, *bounds(at))
