"""Registered queries over the driver tables, each next to its reference SQL."""

from __future__ import annotations

from .base import ORACLES, QUERIES
from . import corpus, encoding, evaluation, files, jobs, lexemes, placement, selection  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
