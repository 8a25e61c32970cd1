"""Dictionary job: dumps to character and tag dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.lattice import COUNT_FIELDS, parse_lattice, quarantine
from ..operators.vocab import build_char_dict, build_tag_dict, feature_counts, top_per_kind
from ..sources.dicts import write_dicts
from ..sources.records import read_records, resolve_inputs
from ..sources.scratch import materialise


def dictionaries(parsed: DataFrame, max_chars: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(characters by frequency, characters by code, tags) of parsed sentences.

    The corpus is counted once; everything after works on the counts, of the
    ``max_chars`` most frequent values of each kind if that is set.
    """
    counts = feature_counts(parsed)
    counts = materialise(counts if max_chars is None else top_per_kind(counts, max_chars), "counts")
    return build_char_dict(counts, "freq"), build_char_dict(counts, "code"), build_tag_dict(counts, max_chars)


def run(spark: SparkSession, list_file: str, output: str, max_chars: int | None = None) -> None:
    """Dictionaries of the listed dumps; sentences that do not parse go to ``output.rejected`` with their reason."""
    paths = resolve_inputs(spark, list_file, always_list=True)
    good, bad = quarantine(parse_lattice(read_records(spark, paths), fields=COUNT_FIELDS))
    write_dicts(*dictionaries(good, max_chars), output)
    bad.write.parquet(f"{output}.rejected")
