"""Content hashes, hash-derived uniform draws and sort keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Fixed values of 32-bit Murmur3 and of the sequence hash.
SEED = 0xDEADBEEF
MIX_FIRST, MIX_SECOND = 0xCC9E2D51, 0x1B873593
MIX_ADD = 0xE6546B64
ROTATE_ITEM, ROTATE_STATE = 15, 13
UNIT_MASK, UNIT_SHIFT, UNIT_MAX = 0x3FFFFF00, 8, 0x3FFFFF


def seq_hash(arr: Column, narrow: bool = False, seed: int = SEED) -> Column:
    """Signed 32-bit hash of an ``array<bigint>``, by Arrow batch; both halves of every element are mixed in.

    ``narrow`` promises that all elements are below 2**32 (dictionary ids always are): their high
    halves are zero words, which only stir the state.
    """
    from ..operators.cells import SequenceHash, by_batch

    made = SequenceHash(narrow, seed & 0xFFFFFFFF, MIX_FIRST, MIX_SECOND, (ROTATE_ITEM, ROTATE_STATE), MIX_ADD)
    return by_batch(made, "int", arr.cast("array<bigint>"))


def hash_unit(h: Column) -> Column:
    """Middle bits of a hash as a float in [0, 1]."""
    bits = F.shiftright(h.bitwiseAND(F.lit(UNIT_MASK)), UNIT_SHIFT)
    return (bits.cast("double") / F.lit(float(UNIT_MAX))).cast("float")


def zigzag_key(length: Column, h: Column, max_length: int) -> Column:
    """First sort key: short and long sentences meet from both ends, by the sign of the hash."""
    room = F.lit(max_length) - length
    return F.when(h < 0, room).otherwise(-room)


def draw_bits(seed: int, parts: list[Column], salt: str) -> Column:
    """128 repeatable random bits as 32 hex digits, keyed by the row's identity."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts], F.lit(salt)))


def unit_of(bits: Column, word: int = 0) -> Column:
    """The ``word``-th 32-bit word (0-3) of :func:`draw_bits` as a uniform draw in [0, 1)."""
    return F.conv(F.substring(bits, 1 + 8 * word, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def drawn_below(bits: Column, share: float) -> Column:
    """``unit_of(bits) < share`` for a share below 1, told by the order of hex digits: no number is made of them."""
    return bits < F.lit(f"{math.ceil(share * (1 << 32)):08x}")


def uniform(seed: int, parts: list[Column], salt: str) -> Column:
    return unit_of(draw_bits(seed, parts, salt))


def jitter_len(length: Column, draw: Column) -> Column:
    """Length moved by -3 .. 3, at least 4."""
    return F.greatest(F.lit(4), length + F.floor(draw * 7).cast("int") - 3)
