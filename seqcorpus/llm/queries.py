"""All queries of this package, by number, with their SQL."""

from __future__ import annotations

from .common import ORACLES, QUERIES
from . import (  # noqa: F401
    block_names, byte_bpe, exact_search, extraction, near_copies, near_search, packing, personal, quality, resampling, sharding,
    token_files, vector_codes,
)

__all__ = ["ORACLES", "QUERIES"]
