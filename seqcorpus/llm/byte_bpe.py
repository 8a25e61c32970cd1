"""Byte-level BPE over whole columns: split points without regular expressions, then cached merging.

The texts of a batch stand one after another as codepoints. A table gives each codepoint its class;
what the split pattern looks ahead for (does a non-blank follow, does a short ending follow an
apostrophe) is folded into the class. Each class is a function from scanner states to scanner states.
Composing such functions is associative, and all compositions that can occur are numbered, so a scan
needs one table look-up a character: the text is laid out in rows, the functions of each row are
composed column by column for all rows at once, the rows' functions are composed in turn, and the
states of all characters follow. A token starts wherever class and state before say so.

The slices between starts are merged by rank (linked list and heap), short ones through a cache. Ids keep the
byte offset of their end, by which any range of ids can be decoded to its place in the text.

Edge cases: a null or empty text has no ids and decodes to no bytes; texts of any length and a run of
one letter of any length are merged in n log n; rows are independent, so ties and repeated rows are plain.
"""

from __future__ import annotations

import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batches_of, query, table, texts_of
from .tokens import vocabulary_path

RANKS = "byte_bpe_multi_50k.tiktoken"
CACHED_SLICES = 600_000
CACHED_LENGTH = 48
NEVER = 1 << 40

# character classes
LETTER, NUMBER, SIGN, BLANK, LAST_SPACE, LAST_BLANK, SHORT, LONG, STOP = range(9)
# scanner states: at a token's start, or inside one of the kinds; ONE and TWO letters of an ending to come
START, IN_LETTERS, IN_NUMBERS, IN_SIGNS, IN_BLANKS, AFTER_SPACE, ONE, TWO = range(8)


def step(state: int, kind: int) -> tuple[int, bool]:
    """State after a character of class ``kind``, and whether a token starts at it."""
    if kind == STOP:
        return START, True
    if kind == LETTER:
        if state in (ONE, TWO):
            return (START if state == ONE else ONE), False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if kind in (SHORT, LONG) and state not in (IN_SIGNS, AFTER_SPACE):
        return (ONE if kind == SHORT else TWO), True
    if kind in (SIGN, SHORT, LONG):
        return IN_SIGNS, state not in (IN_SIGNS, AFTER_SPACE)
    if kind == BLANK:
        return IN_BLANKS, state != IN_BLANKS
    return (AFTER_SPACE if kind == LAST_SPACE else START), True


@lru_cache(1)
def scanner() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Composition of numbered functions, the number of each class, values at START, token starts.

    Functions are numbered as they are found, the identity first: ``after[f, g]`` is f, then g."""
    classes = [tuple(step(s, k)[0] for s in range(8)) for k in range(9)]
    known = {tuple(range(8)): 0}
    queue = list(known)
    for f in queue:
        for g in classes:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    after = np.array([[known[tuple(g[x] for x in f)] for g in queue] for f in queue], np.uint16)
    starts = np.array([[step(s, k)[1] for k in range(9)] for s in range(8)])
    return after, np.array([known[c] for c in classes], np.uint16), np.array(queue, np.uint8), starts


# Blocks with letters or numbers that Unicode 16.0 added and the standard library's tables lack
ADDED = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D8F), (0x10EC2, 0x10EC4),
    (0x11380, 0x113FF), (0x116D0, 0x116E3), (0x11BC0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x16139),
    (0x16D40, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FA),
)


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of each codepoint by its Unicode category; blanks are those with the White_Space property."""
    import regex

    out = np.full(sys.maxunicode + 1, SIGN, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
        elif chr(c).isspace() and not 0x1C <= c <= 0x1F:  # separators that are no White_Space
            out[c] = BLANK
    for first, last in ADDED:
        for c in range(first, last + 1):
            if regex.match(r"[\p{L}\p{N}]", chr(c)):
                out[c] = LETTER if regex.match(r"\p{L}", chr(c)) else NUMBER
    return out


def classes_of(points: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Class of each codepoint of texts laid end to end, a stop after each."""
    kinds = class_table()[points]
    kinds[stops] = STOP
    following = np.append(kinds[1:], np.uint8(STOP))
    last = np.flatnonzero((kinds == BLANK) & (following != BLANK) & (following != STOP))
    kinds[last] = np.where(points[last] == 0x20, LAST_SPACE, LAST_BLANK)
    quotes = np.flatnonzero(points == ord("'"))
    if len(quotes):
        padded = np.append(points, np.zeros(2, points.dtype))
        a, b = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(a, [ord(c) for c in "stmd"])
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        kinds[quotes[short]], kinds[quotes[long]] = SHORT, LONG
    return kinds


def token_starts(kinds: np.ndarray, width: int = 256) -> np.ndarray:
    """Whether a token starts at each character: a scan over composed transition functions."""
    after, of_class, values, starts = scanner()
    n = len(kinds)
    rows = -(-n // width)
    padded = np.full(rows * width, STOP, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(of_class[padded].reshape(rows, width).T)
    size, flat = len(after), after.ravel()
    for j in range(1, width):  # composed within each row, all rows at once
        columns[j] = flat[columns[j - 1].astype(np.int32) * size + columns[j]]
    before, shift = columns[-1].copy(), 1
    while shift < rows:  # and over the rows, in doubling steps
        before[shift:] = flat[before[:-shift].astype(np.int32) * size + before[shift:]]
        shift *= 2
    entry = np.concatenate([[START], values[before[:-1], START]]).astype(np.uint8)
    states = np.empty((width, rows), np.uint8)
    states[0] = entry
    states[1:] = values[columns[:-1], entry]
    return starts[states.T.ravel()[:n], kinds]


class ByteBpe:
    """Encoding and decoding by a rank file."""

    def __init__(self, path: str):
        import base64

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        parts = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            parts[rank] = token
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.cache: dict[bytes, bytes] = {}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                if token[:i] in self.ranks and token[i:] in self.ranks:
                    pairs[self.ranks[token[:i]] * len(parts) + self.ranks[token[i:]]] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()] + [NEVER], np.int64)
        self.of_bytes = self.joined(*np.meshgrid(self.of_byte, self.of_byte, indexing="ij"))

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two ids make together; ``NEVER`` where they make none."""
        keys = left * len(self.sizes) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def merge_block(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of slices of similar length, merged side by side: in each round every slice merges its
        leftmost pair of lowest rank."""
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = self.of_byte[raw]
        ranks = self.of_bytes[raw[:, :-1], raw[:, 1:]]
        ranks[np.arange(width - 1) >= sizes[:, None] - 1] = NEVER
        done: list[np.ndarray] = [None] * len(pieces)
        names = np.arange(len(pieces))
        while True:
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
            lowest = ranks[np.arange(len(ids)), best] if ranks.shape[1] else np.full(len(ids), NEVER)
            live = lowest < NEVER
            for i in np.flatnonzero(~live).tolist():
                done[names[i]] = ids[i, :sizes[i]]
            if not live.any():
                return done
            if not live.all():
                ids, ranks, sizes, names, best, lowest = (x[live] for x in (ids, ranks, sizes, names, best, lowest))
            rows, columns = np.arange(len(ids)), np.arange(ids.shape[1] - 1)
            ids[rows, best] = lowest
            ids = np.take_along_axis(ids, columns + (columns > best[:, None]), 1)
            ranks = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= best[:, None]), 1)
            sizes = sizes - 1
            at = np.flatnonzero(best + 1 < sizes)
            ranks[at, best[at]] = self.joined(ids[at, best[at]], ids[at, best[at] + 1])
            at = np.flatnonzero((best + 1 >= sizes) & (best < ranks.shape[1]))
            ranks[at, best[at]] = NEVER
            at = np.flatnonzero(best > 0)
            ranks[at, best[at] - 1] = self.joined(ids[at, best[at] - 1], ids[at, best[at]])

    def merge_all(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of many different slices; long ones one by one."""
        out = {p: np.array([self.ranks[p]] if p in self.ranks else self.merge(p), "<u4").tobytes()
               for p in pieces if len(p) > CACHED_LENGTH or p in self.ranks}
        short = sorted((p for p in pieces if p not in out), key=len)
        for at in range(0, len(short), 2048):
            block = short[at:at + 2048]
            out.update((p, ids.astype("<u4").tobytes()) for p, ids in zip(block, self.merge_block(block)))
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the lowest rank among neighbours is merged first, the leftmost of equals."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        ends = list(range(1, n + 1))  # of the part that starts at each place
        prior = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i]:
                continue
            mid = ends[i]
            if mid >= end or mid >= n or ends[mid] != end:
                continue  # one of the two has been merged meanwhile
            alive[mid] = False
            ends[i] = end
            if end < n:
                prior[end] = i
                if (r := ranks.get(piece[i:ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (p := prior[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        return [ranks[piece[i:ends[i]]] for i in range(n) if alive[i]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (``uint32``) of each text."""
        joined = "\0".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = np.flatnonzero(token_starts(classes_of(points, stops)))
        widths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(widths)])[starts].tolist()
        raw, cache = joined.encode(), self.cache
        if len(cache) > CACHED_SLICES:
            cache.clear()
        slices = [raw[a:b] for a, b in zip(at, at[1:])]
        found = list(map(cache.get, slices))
        done = self.merge_all([*{s for s, ids in zip(slices, found) if ids is None}])
        cache.update((s, ids) for s, ids in done.items() if len(s) <= CACHED_LENGTH)
        if None in found:
            found = [ids if ids is not None else done[s] for s, ids in zip(slices, found)]
        # every stop is a slice of its own, and the last of all is no slice: it only ends the one before
        out, begin = [], 0
        for end in np.searchsorted(starts, stops).tolist():
            out.append(np.frombuffer(b"".join(found[begin:end]), "<u4"))
            begin = end + 1
        return out

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset in the text at which each id ends."""
        return np.cumsum(self.sizes[ids])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, gathered from the vocabulary by offset."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(self.offsets[ids] - ends + sizes, sizes) + np.arange(total)].tobytes()


_CODECS: dict[str, ByteBpe] = {}


def codec(path: str) -> ByteBpe:
    """One codec for each rank file and Python worker."""
    if path not in _CODECS:
        _CODECS[path] = ByteBpe(path)
    return _CODECS[path]


def encoded(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` and ``ends``: the byte offset in the text at which each id ends."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks)
        for doc_ids, texts in batches_of(batches, 1 << 20):
            ids = bpe.encode(texts)
            sizes = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32)
            ends = np.concatenate([bpe.ends(x) for x in ids]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(sizes, flat), pa.ListArray.from_arrays(sizes, ends)],
                ["doc_id", "ids", "ends"])

    return texts_of(docs, id_col, text_col).mapInArrow(encode, "doc_id long, ids array<int>, ends array<long>")


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids of each text and of the bytes that they decode to."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks)
        for doc_ids, texts in batches_of(batches, 1 << 20):
            ids = bpe.encode(texts)
            yield pa.RecordBatch.from_arrays([
                pa.array(doc_ids, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return texts_of(docs, id_col, text_col).mapInArrow(digest, schema)


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary_path(RANKS))
