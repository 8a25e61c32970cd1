"""Text functions on codepoints."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Full-width forms are the ASCII codes shifted by 0xFEE0.
WIDTH_SHIFT = 0xFEE0
FULL_WIDTH_FIRST, FULL_WIDTH_LAST = 0xFF01, 0xFF5F
NARROW_FIRST, NARROW_LAST = 0x21, 0xF7

_NARROW = "".join(chr(c) for c in range(NARROW_FIRST, NARROW_LAST + 1))
_WIDE = "".join(chr(c + WIDTH_SHIFT) for c in range(NARROW_FIRST, NARROW_LAST + 1))


def codepoints(text: Column) -> Column:
    """One string per Unicode codepoint."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def codept_repr(ch: Column) -> Column:
    """``a`` -> ``a:61``."""
    return F.format_string("%s:%x", ch, F.ascii(ch))


def is_full_width(text: Column) -> Column:
    return text.rlike(f"^[{chr(FULL_WIDTH_FIRST)}-{chr(FULL_WIDTH_LAST)}]*\\z")


def zen2han(text: Column) -> Column:
    return F.translate(text, _WIDE, _NARROW)


def han2zen(text: Column) -> Column:
    """Inverse of :func:`zen2han` on printable ASCII; used to derive full-width input."""
    last = 0x7E - NARROW_FIRST + 1
    return F.translate(text, _NARROW[:last], _WIDE[:last])


def norm_variants(text: Column) -> Column:
    """Sort the ``?``-separated variants, unless the text has no ``?`` after its first character."""
    parts = F.filter(F.split(text, "\\?"), lambda p: p != "")
    return F.when(F.instr(text, "?") < 2, text).otherwise(F.array_join(F.array_sort(parts), "?"))


def is_viable(text: Column) -> Column:
    """Is a ``left/right`` entry worth keeping beyond the always-kept head of a vocabulary?"""
    left = F.substring_index(text, "/", 1)
    right = F.substr(text, F.instr(text, "/") + F.lit(1))
    return (
        (F.instr(text, "?") > 1)
        | (F.instr(text, "/") < 2)
        | (left != right)
        | left.rlike("[぀-ゟ]")
    )
