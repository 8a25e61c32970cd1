"""Documents whose sets of word n-grams overlap (Jaccard), without comparing all with all.

Sets are hashed n-grams in ascending order. Sizes are cut into bands so that linked sets lie in the same band or in
neighbouring ones. Linked sets of a band (and the one above) differ in at most D n-grams; so if the hash space is cut
into D + 1 + 2E segments, at least 2E + 1 segments are the same in both. Each set gives a tile (band, segment, the
segment's content) for all its segments but the E weakest, those with the fewest rare n-grams: passages that many
documents share make no tile by themselves, and still no linked pair is lost.

Tiles are dealt by key as they are made, never written. A task joins equal tiles of some thousand documents before it sends one
of them, so a tile of very many sets is small when it arrives; there the sets of a tile are joined to its first one. Sets
joined in this way are candidates. The members of each connected group of candidates are compared: bitmaps of hashed n-grams
bound the overlap from above by counting bits, and what passes is decided on the sorted arrays. Sets already joined by
links are not compared again: links found span each component.

A group that fills more than one block is first cut by prefixes: with n-grams ordered by how many sets of a bounded
sample hold them, two linked sets share one among the first (1 - threshold) of each (in any order, so the sample decides no result). A passage that many short
documents share ties them to each other by tiles, but comes last in this order. What is still connected by shared
prefix n-grams is compared in two rounds: within blocks, dealt by two hashes; then the sets outside
the group's largest component so far (the guests) with every block of the first hash. Two sets of the largest component need
no comparison, any other pair meets in the first or the last round. So a group of n sets of which g do not link to
the rest costs about 3n + g * blocks sent sets instead of n * blocks.

Equal sets are one class from the start (their number needs no pairs). N-grams are 64-bit hashes. A row is named by a
hash of its id and text where its text is read again, and the set made from that text must be the one that was asked for.

Edge cases: null or empty texts and texts of blanks have no n-gram, are linked with nothing and form their own component;
a text with fewer words than n has one n-gram, the whole; texts of any length are read whole; repeated rows and ties fall
in one component, named by its smallest id; rows of one id with different texts have a set each; a null id is kept and names
no component; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqcorpus.operators.lookup import lookup_join
from seqcorpus.sources.scratch import release

from .common import frugal, materialise, query, table, texts_of
from .graphs import components

TILE_ROWS = 1024  # sets that are compared with each other at once
TILE_SHINGLES = 2 << 20  # of these sets together, unless a single set has more
WINDOW = 1 << 18  # tiles that a task joins before it sends one of each
SAMPLE_SETS, GRAMS = 65_536, 1 << 19  # sets whose n-grams are counted to order prefixes, and n-grams that are kept of them
BROADCAST_BYTES = 16 << 20
ROW_BYTES = 64  # of a row of ids
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over the whole range."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text (A-Z lower-cased, split at ASCII white space)."""
    from xxhash import xxh3_64_intdigest

    split = [t.encode().lower().split() for t in texts]
    sizes = [len(w) for w in split]
    words = np.fromiter((xxh3_64_intdigest(w) for ws in split for w in ws), np.uint64, sum(sizes))
    n = len(words) - width + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for i in range(width if n > 0 else 0):
        rolled = rolled * _FACTOR + words[i:i + n]
    rolled = mixed(rolled)
    out, at = [], 0
    for size in sizes:
        if size >= width:
            out.append(np.unique(rolled[at:at + size - width + 1]))
        elif size:
            whole = np.uint64(size)
            for w in words[at:at + size]:
                whole = np.uint64((int(whole) * int(_FACTOR) + int(w)) & (2**64 - 1))
            out.append(mixed(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


class Bands:
    """Size bands of a threshold, given as a whole percentage, and the segments of each."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lows = [1]

    def of(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(self.lows[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.lows, size, "right")) - 1

    @lru_cache(None)
    def level(self, band: int) -> tuple[int, np.ndarray] | None:
        """Number of weak segments and inner segment borders for sets of ``band`` with others of it or the next one."""
        self.of(self.lows[band] if band < len(self.lows) else 1)
        low, most = self.lows[band], self.lows[band + 1] - 1
        differ = (most + most * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
        if not differ:
            return None  # only equal sets are linked
        weak = 1
        for _ in range(3):
            segments = differ + 1 + 2 * weak
            empty = segments * math.exp(-low / segments)
            weak = 1 + math.ceil(empty + 3 * math.sqrt(empty))
        segments = differ + 1 + 2 * weak
        borders = np.array([(i << 64) // segments for i in range(1, segments)], np.uint64)
        return weak, borders


def tiles_of(found: np.ndarray, rare: np.ndarray, bands: Bands) -> np.ndarray:
    """Tiles of one set; ``rare`` says which of its n-grams few other documents seem to have."""
    band, out = bands.of(len(found)), []
    totals = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(found + _FACTOR), dtype=np.uint64)])
    rares = np.concatenate([[0], np.cumsum(rare)])
    for level in (band, band - 1):
        cut = bands.level(level) if level >= 0 else None
        if cut:
            weak, borders = cut
            edges = np.concatenate([[0], np.searchsorted(found, borders), [len(found)]])
            content = totals[edges[1:]] - totals[edges[:-1]]
            strength = rares[edges[1:]] - rares[edges[:-1]]
            kept = np.argsort(strength, kind="stable")[weak:]
            place = np.uint64((level + 1) << 40) + kept.astype(np.uint64)
            out.append(mixed(content[kept] + mixed(place)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def pieces(batches: Iterator[pa.RecordBatch], chars: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a bounded number of characters (one row at least) with the texts of their last column."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy()
        ends = np.cumsum(sizes)
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars, "right")))
            part = batch.slice(at, to - at)
            yield part, [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
            at = to


def set_ids(sets: list[np.ndarray]) -> list[int | None]:
    """Identity of each set as a signed number; none for an empty one."""
    from xxhash import xxh3_64_intdigest

    found = [xxh3_64_intdigest(s.tobytes()) if len(s) else None for s in sets]
    return [None if s is None else s - (s >> 63 << 64) for s in found]


def signatures(texts: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``row_key``, size and identity of every row's set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in pieces(batches, 1 << 20):
            sets = shingles(found, width)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array([len(s) for s in sets], pa.int64()), pa.array(set_ids(sets), pa.int64())],
                ["doc_id", "row_key", "n_shingles", "set_id"])

    return texts.select("doc_id", "row_key", "text").mapInArrow(frugal(sign), "doc_id long, row_key long, n_shingles long, set_id long")


def star_edges(texts: DataFrame, tiler: Callable[[], Callable[[list[np.ndarray]], list[np.ndarray]]], read_sets) -> DataFrame:
    """Edges (``a``, ``b``) from each set of a tile to one other of it, so that the sets of a tile are connected.

    ``tiler()`` gives what finds the tiles of sets, ``read_sets`` the sets and their identities of an Arrow stream. A task joins
    the sets of ``WINDOW`` tiles at a time: the sets of a tile meet its least one in a tile of that set's own,
    and only this one stands for the tile outside."""

    def joined(tiles: list[np.ndarray], owners: list[int]) -> pa.RecordBatch:
        tile = np.concatenate([np.zeros(0, np.uint64), *tiles])
        owner = np.repeat(np.array(owners, np.int64), [len(t) for t in tiles])
        order = np.lexsort((owner, tile))
        tile, owner = tile[order], owner[order]
        first = np.concatenate([[True], tile[1:] != tile[:-1]]) if len(tile) else np.zeros(0, bool)
        leader = np.repeat(owner[first], np.diff(np.append(np.flatnonzero(first), len(tile))))
        met = owner != leader
        own, head = np.unique(np.stack([owner[met], leader[met]]), axis=1)
        heads = np.unique(head)
        tile = np.concatenate([tile[first], *(mixed(x.view(np.uint64) + _FACTOR) for x in (head, heads))])
        return pa.RecordBatch.from_arrays([pa.array(tile.view(np.int64)), pa.array(np.concatenate([owner[first], own, heads]))], ["tile", "a"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known, tiles, owners, n = tiler(), set(), [], [], 0
        for ids, sets in read_sets(batches):
            for set_id, found in zip(ids, find(sets)):
                if set_id is None or set_id in known:
                    continue  # a task gives a set's tiles once
                if len(known) > 100_000:
                    known.clear()
                known.add(set_id)
                tiles.append(found)
                owners.append(set_id)
                n += len(found)
                if n >= WINDOW:
                    yield joined(tiles, owners)
                    tiles, owners, n = [], [], 0
        yield joined(tiles, owners)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_tile = last = None
        for batch in batches:
            tile, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(tile):
                continue
            starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            leader = own[starts].copy()
            if tile[0] == last_tile:
                leader[0] = last
            last_tile, last = tile[-1], leader[-1]
            leader = np.repeat(leader, np.diff(np.append(starts, len(tile))))
            pairs = np.unique(np.stack([own, leader])[:, own != leader], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    posted = texts.mapInArrow(frugal(post), "tile long, a long")
    return posted.repartition("tile").sortWithinPartitions("tile", "a").mapInArrow(frugal(read), "a long, b long")


def candidates(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges that connect the sets which share the content of a segment."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        for _, found in pieces(batches, 1 << 20):
            sets = shingles(found, width)
            yield set_ids(sets), sets

    def tiler():
        bands = Bands(percent)

        def find(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            common = values[counts > 3]
            for own in sets:
                place = np.minimum(np.searchsorted(common, own), max(len(common) - 1, 0))
                rare = common[place] != own if len(common) else np.ones(len(own), bool)
                yield tiles_of(own, rare, bands) if len(own) else np.zeros(0, np.uint64)

        return find

    return star_edges(texts.select("text"), tiler, sets_of)


def linked(sets: list[np.ndarray], percent: int, labels: list[int], home: list[bool | None]) -> list[tuple[int, int]]:
    """Pairs of places that, with the components named by ``labels``, span the components of all links among ``sets``.

    Where ``home`` is known, only sets at home are compared with guests."""
    n = len(sets)
    order = sorted(range(n), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    width = 64
    while width < min(16_384, 2 * int(np.median(sizes)) if n else 0):
        width *= 2
    bits = np.zeros((n, width // 64), np.uint64)
    for row, i in enumerate(order):
        at = sets[i] & np.uint64(width - 1)
        np.bitwise_or.at(bits[row], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    group = np.unique(np.array(labels)[order], return_inverse=True)[1]
    side = None if None in home else np.array(home)[order]
    out = []
    for a in range(n):
        end = int(np.searchsorted(sizes, sizes[a] * 100 // percent, "right"))
        others = np.arange(a + 1, end)
        others = others[group[others] != group[a]]
        if side is not None:
            others = others[side[others] != side[a]]
        for at in range(0, len(others), 4096):
            part = others[at:at + 4096]
            here, there = bits[a], bits[part]
            bound = np.minimum(sizes[a] - np.bitwise_count(here & ~there).sum(1, dtype=np.int64),
                               sizes[part] - np.bitwise_count(there & ~here).sum(1, dtype=np.int64))
            for b in part[100 * bound >= percent * (sizes[a] + sizes[part] - bound)].tolist():
                if group[a] == group[b]:
                    continue
                x, y = sets[order[a]], sets[order[b]]
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[place] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((order[a], order[b]))
                    group[group == group[b]] = group[a]
    return out


def asked_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows whose text (the last column) gives the set that is asked for (the first), and the sets; a task gives each once."""
    known: set = set()
    for part, found in pieces(batches, 1 << 19):
        sets, asked = shingles(found, width), part.column(0).to_pylist()
        rows = []
        for i, made in enumerate(set_ids(sets)):
            if made == asked[i] and made not in known:
                known.add(made)
                rows.append(i)
        if len(known) > 200_000:
            known.clear()
        yield part.take(pa.array(rows, pa.int64())), [sets[i] for i in rows]


def _texts_of(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` (``row_key`` and more) with the texts of its rows."""
    rows = chosen.count()
    small = rows * ROW_BYTES <= BROADCAST_BYTES  # else both sides are dealt by row
    return texts.join(F.broadcast(chosen) if small else chosen, "row_key").select(*chosen.columns, "text").drop("row_key")


def links(texts: DataFrame, chosen: DataFrame, tiles: Column, width: int, percent: int) -> DataFrame:
    """Links found among the sets of ``chosen`` (``row_key``, ``set_id``, ``label``, ``root`` and what ``tiles`` needs).

    ``tiles`` gives the blocks of a row as an array of (``part``, ``chunk``, ``home``); sets of one root, part and chunk meet."""
    extra = [f for f in chosen.schema.fields if f.name not in ("row_key", "set_id")]
    schema = ", ".join(["set_id long", *(f"{f.name} {f.dataType.simpleString()}" for f in extra), "shingles array<long>"])

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, sets in asked_sets(batches, width):
            edges = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*kept.columns[:-1], pa.ListArray.from_arrays(edges, pa.array(flat))], ["set_id", *(f.name for f in extra), "shingles"])

    def compare(rows: pa.Table) -> pa.Table:
        ids, first = np.unique(rows["set_id"].to_numpy(), return_index=True)
        rows = rows.take(pa.array(first))
        column = rows["shingles"].combine_chunks()
        flat, edges = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        found = linked([flat[i:j] for i, j in zip(edges, edges[1:])], percent, rows["label"].to_pylist(), rows["home"].to_pylist())
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ids[pairs[:, 0]]), "b": pa.array(ids[pairs[:, 1]])})

    met = _texts_of(texts, chosen.select("row_key", "set_id", *(f.name for f in extra)))
    sent = met.mapInArrow(frugal(arrays), schema).select("set_id", "label", "root", "shingles", F.explode(tiles).alias("tile"))
    dealt = sent.select("set_id", "label", "root", "shingles", "tile.part", "tile.chunk", "tile.home")
    return materialise(dealt.groupBy("root", "part", "chunk").applyInArrow(compare, "a long, b long"), "links")


def frequent_grams(texts: DataFrame, chosen: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that several of a bounded sample of the sets hold, ascending, and how many do; at most ``GRAMS``."""
    step = -(-chosen.count() // SAMPLE_SETS)
    some = chosen.select("row_key", "set_id").filter(F.pmod(F.xxhash64(F.lit("sample"), "set_id"), F.lit(max(step, 1))) == 0)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of this task so far
        for _, sets in asked_sets(batches, width):
            new, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            both, place = np.unique(np.concatenate([grams, new]), return_inverse=True)
            grams, held = both, np.bincount(place, np.concatenate([held, n]), len(both)).astype(np.int64)
            if len(grams) > WINDOW:
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(held)], ["gram", "n"])
                grams, held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(held)], ["gram", "n"])

    counts = _texts_of(texts, some).mapInArrow(frugal(spread), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = counts.filter("n > 1").orderBy(F.desc("n"), "gram").limit(GRAMS).toArrow()
    grams, n = found["gram"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def prefix_edges(texts: DataFrame, chosen: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges that connect the sets of ``chosen`` (``row_key``, ``set_id``) which share an n-gram of their prefixes.

    N-grams are ordered by how many sets of a sample hold them, then by hash. Any order that is the same for all sets keeps
    every linked pair; the sample only makes it a good one."""
    grams, held = frequent_grams(texts, chosen, width)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        for kept, sets in asked_sets(batches, width):
            yield kept.column(0).to_pylist(), sets

    def tiler():
        def find(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
            for own in sets:
                place = np.minimum(np.searchsorted(grams, own), max(len(grams) - 1, 0))
                often = np.where(grams[place] == own, held[place], 0) if len(grams) else np.zeros(len(own), np.int64)
                first = own[np.argsort(often, kind="stable")[:len(own) + (-percent * len(own)) // 100 + 1]]
                yield mixed(first)

        return find

    return star_edges(_texts_of(texts, chosen.select("row_key", "set_id")), tiler, sets_of)


def _tile(part: Column, chunk: Column, home: Column) -> Column:
    return F.struct(part.cast("int").alias("part"), chunk.cast("int").alias("chunk"), home.cast("boolean").alias("home"))


def _block(salt: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "set_id"), blocks).cast("int")


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with ``label``: the component that the links so far give."""
    nodes = components(found).select(F.col("node").alias("set_id"), F.col("root").alias("known"))
    return materialise(members.join(nodes, "set_id", "left").select(
        *members.columns, F.coalesce("known", "set_id").alias("label")), "labelled")


def all_links(texts: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that span each component among ``members`` (``root``, ``set_id``, ``row_key``, ``n_shingles``)."""
    fill = F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("n_shingles") / TILE_SHINGLES)).cast("int")

    def sized(rows: DataFrame) -> DataFrame:
        full = materialise(rows.groupBy("root").agg(fill.alias("blocks")).filter("blocks > 1"), "large-groups")
        return materialise(lookup_join(rows, full, ["root"], {"blocks": 1}, BROADCAST_BYTES), "sized-members")

    placed = sized(members)
    large = placed.filter("blocks > 1")
    if not large.isEmpty():
        cut = components(prefix_edges(texts, large, width, percent)).select(F.col("node").alias("set_id"), F.col("root").alias("cut"))
        parts = large.join(cut, "set_id").select(F.col("cut").alias("root"), "set_id", "row_key", "n_shingles")
        placed = sized(placed.filter("blocks = 1").select(*parts.columns).unionByName(parts))
        large = placed.filter("blocks > 1")

    def block(salt: str) -> Column:
        return _tile(_block(salt, F.col("blocks")), F.lit(0), F.lit(None))

    twice = F.when(F.col("blocks") > 1, F.array(block("first"), _tile(
        F.col("blocks") + _block("second", F.col("blocks")), F.lit(0), F.lit(None)))).otherwise(F.array(block("first")))
    found = links(texts, placed.select("row_key", "set_id", F.col("set_id").alias("label"), "root", "blocks"), twice, width, percent)
    if large.isEmpty():
        return found
    labelled = _labelled(large, found)
    counts = labelled.groupBy("root", "label").agg(F.count("*").alias("n"))
    largest = counts.groupBy("root").agg(F.max(F.struct("n", "label")).alias("most")).select("root", F.col("most.label").alias("largest"))
    placed = materialise(lookup_join(labelled, largest, ["root"], {"largest": None}).withColumn("guest", F.expr("label <> largest")), "guests")
    crowds = materialise(placed.filter("guest").groupBy("root").agg(fill.alias("chunks")), "crowds")
    if crowds.isEmpty():
        return found
    met = lookup_join(placed, crowds, ["root"], {"chunks": 0}).filter("chunks > 0")
    own = _block("first", F.col("blocks"))
    chunk = F.when(F.col("guest"), _block("guests", F.col("chunks")))  # every set is at home once, and guests go to other blocks
    rows = materialise(met.select("row_key", "set_id", "label", "root", "blocks", "chunks", own.alias("own"), chunk.alias("as_guest")), "met")
    at_home = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: _tile(F.col("own"), c, F.lit(True)))
    elsewhere = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda p: F.col("as_guest").isNotNull() & (p != F.col("own")))
    guests = F.transform(elsewhere, lambda p: _tile(p, F.col("as_guest"), F.lit(False)))
    return found.union(links(texts, rows, F.concat(at_home, guests), width, percent))


def copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``row_key``, ``n_shingles``, ``component_id`` and ``first_key`` of every row: the key of the row that names
    its component (null: a component of this row alone)."""
    texts = keyed(texts_of(docs, id_col, text_col))
    sets = materialise(signatures(texts, width), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("first")
    classes = materialise(sets.filter("set_id is not null").groupBy("set_id").agg(
        first, F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n")), "classes")
    joined = components(candidates(texts, width, percent))
    members = materialise(joined.join(classes, F.col("node") == F.col("set_id")).select(
        "root", "set_id", F.col("first.row_key").alias("row_key"), "n_shingles"), "members")
    roots = components(all_links(texts, members, width, percent))
    named = materialise(roots.join(classes, F.col("node") == F.col("set_id")).select("root", "set_id", "first"), "named")
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    heads = materialise(heads.select("root", F.col("head.doc_id").alias("head_id"), F.col("head.row_key").alias("head_key")), "heads")
    headed = lookup_join(named.select("root", "set_id"), heads, ["root"], {}).select("set_id", "head_id", "head_key")
    of_set = classes.join(headed, "set_id", "left").filter("n > 1 or head_key is not null").select(
        "set_id", F.when(F.col("head_key").isNull(), F.col("first.doc_id")).otherwise(F.col("head_id")).alias("component_id"),
        F.coalesce("head_key", "first.row_key").alias("first_key"))
    return lookup_join(sets, materialise(of_set, "components"), ["set_id"], {}, BROADCAST_BYTES).select(
        "doc_id", "row_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "first_key")


def keyed(texts: DataFrame) -> DataFrame:
    return texts.withColumn("row_key", F.xxhash64("doc_id", "text"))


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``."""
    return copies(docs, width, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``: of each component the row of the smallest id (null last), of its repetitions one."""
    found = materialise(copies(docs, width, percent, id_col, text_col).filter("first_key is not null"), "found-copies")
    gone = found.filter("row_key <> first_key").select("row_key").distinct().withColumn("state", F.lit(1))
    repeated = found.filter("row_key = first_key").groupBy("row_key").count().filter("count > 1").select("row_key", F.lit(2).alias("state"))
    states = materialise(gone.unionByName(repeated), "row-states")
    key = F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("row_key"))
    marked = lookup_join(rows, states, ["row_key"], {"state": 0}, BROADCAST_BYTES)
    once = marked.filter("state = 2").groupBy("row_key").agg(F.first("row").alias("row"))
    return marked.filter("state = 0").select("row.*").unionByName(once.select("row.*"))


@query("op9_near_copies")
def op9_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"), 3, 90)
